"""Numbers of the Zipf distribution: harmonic sums, table size estimate, inverse CDF."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys whose share of the distribution is kept as a number; those beyond are computed.
HEAD_KEYS = 1024
_UNIFORM_BITS = 52


def harmonic_sum(rank: Column, z: float) -> Column:
    """Aggregate: generalised harmonic number over a column of ranks 1..n."""
    return F.sum(F.pow(rank.cast("double"), F.lit(-float(z))))


def harmonic(spark: SparkSession, n: int, z: float) -> DataFrame:
    return spark.range(1, n + 1).agg(harmonic_sum(F.col("id"), z).alias("harmonic"))


def expected_table_size(theta: float, harmonic_number: Column, z: float) -> Column:
    """Number of keys expected above frequency ``theta`` under Zipf(z)."""
    return F.pow(F.lit(float(theta)) * harmonic_number, F.lit(-1.0 / z))


def uniform_integer(row: Column, seed: int) -> Column:
    """Deterministic 52-bit integer per row number, the same on every recomputation."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string")))
    return F.conv(F.substring(digest, 1, _UNIFORM_BITS // 4), 16, 10).cast("bigint")


def _integral(x, z: float, log, power):
    """Antiderivative of ``x ** -z``."""
    return log(x) if z == 1 else power(x, 1 - z) / (1 - z)


def _smooth_sum(x, z: float, log, power):
    """Sum of ``i ** -z`` up to ``x``, but for a constant; the next term is below ``z^3 x^(-z-3) / 720``."""
    return _integral(x, z, log, power) + power(x, -z) / 2 - power(x, -z - 1) * (z / 12)


@lru_cache(maxsize=16)
def _head(n: int, z: float) -> tuple[np.ndarray, float]:
    """Sums of the weights up to each of the first keys, and the sum over all ``n``."""
    sums = np.cumsum(np.arange(1, min(n, HEAD_KEYS) + 1, dtype=np.float64) ** -float(z))
    if n <= HEAD_KEYS:
        return sums, float(sums[-1])
    smooth = lambda x: _smooth_sum(float(x), z, math.log, math.pow)
    return sums, float(sums[-1] + smooth(n) - smooth(HEAD_KEYS))


def zipf_thresholds(n: int, z: float) -> np.ndarray:
    """Of each of the first keys the number above which a draw belongs to a later one."""
    sums, total = _head(n, float(z))
    return np.floor(sums / total * float(1 << _UNIFORM_BITS)).astype(np.int64)


def zipf_key(row: Column, n: int, z: float, seed: int) -> Column:
    """Key 1..n drawn by inverting the CDF at the row's uniform number, for any ``n``.

    The first keys are found by bisection in an array of their thresholds. Beyond, the sum of weights
    is a smooth function up to a term far below the spacing of draws; it is inverted and the result set right by
    one step either way. All of it is a Column expression whose size does not depend on ``n``.
    """
    z = float(z)
    if n < 1 or z <= 0:
        raise ValueError("n is 1 or more, z above 0")
    draw = uniform_integer(row, seed)
    bounds = F.array(*[F.lit(int(x)) for x in zipf_thresholds(n, z)])
    size = min(n, HEAD_KEYS)
    steps = [1 << i for i in reversed(range(size.bit_length()))]

    def bisect(found: Column, step: Column) -> Column:
        there = F.get(bounds, found + step - 1)
        return F.when(there <= draw, found + step).otherwise(found)

    head = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), bisect) + 1
    if n <= HEAD_KEYS:
        return F.least(head, F.lit(n)).cast("bigint")
    sums, total = _head(n, z)
    first = _smooth_sum(float(HEAD_KEYS), z, math.log, math.pow)
    # What the sum of weights beyond the head has to exceed.
    wanted = draw.cast("double") / F.lit(float(1 << _UNIFORM_BITS)) * F.lit(total) - F.lit(float(sums[-1]))
    power = lambda x, y: F.pow(x, F.lit(float(y)))
    beyond = lambda x: _smooth_sum(x, z, F.ln, power) - F.lit(first)
    middle = wanted + F.lit(_integral(HEAD_KEYS + 0.5, z, math.log, math.pow))
    # A sum up to j is about the integral up to j + 1/2.
    at = F.exp(middle) if z == 1 else power(middle * F.lit(1 - z), 1 / (1 - z))
    guess = F.least(F.greatest(F.ceil(at - 0.5), F.lit(HEAD_KEYS + 1)), F.lit(n)).cast("bigint")
    near = lambda j: beyond(j.cast("double")) > wanted
    tail = F.when(near(guess - 1), guess - 1).when(near(guess), guess).otherwise(guess + 1)
    tail = F.least(F.greatest(tail, F.lit(HEAD_KEYS + 1)), F.lit(n))
    return F.when(head <= HEAD_KEYS, head).otherwise(tail).cast("bigint")
