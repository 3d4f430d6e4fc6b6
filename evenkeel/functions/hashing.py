"""Hash functions over key columns, as plain Column arithmetic (no Python per row)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The modulus of the 2-universal family, its default (a, b) pairs in
# [1, p - 1), the seed of single murmur hashing, the first prime of the seed list.
PRIME = 10000019
COEFFICIENTS = ((3141593, 2718282), (5772157, 1618034), (1414214, 7320508), (2236068, 6931472))
MURMUR_SEED = 13
FIRST_SEED = 31


def cw_hash(col: Column, k: int, a: int, b: int, p: int = PRIME) -> Column:
    """Carter-Wegman hash ``((a*x + b) mod p) mod k``.

    ``x`` is reduced first, so the product stays below p*p and cannot overflow in ANSI
    mode; the result equals the unreduced form, and negative keys stay in range.
    """
    x = F.pmod(col.cast("bigint"), F.lit(p))
    return F.pmod(F.pmod(x * F.lit(a) + F.lit(b), F.lit(p)), F.lit(k)).cast("int")


def fold_crc32(col: Column) -> Column:
    """A string as a non-negative 32-bit integer: its CRC-32, one native call per row."""
    return F.crc32(col)


def fold_md5(col: Column) -> Column:
    """A string as the first eight hex digits of its MD5: better mixed, many times slower."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("bigint")


def fold_utf16(col: Column) -> Column:
    """A string as the absolute value of its 32-bit polynomial hash (base 31, UTF-16 units)."""
    units = F.hex(F.encode(col, "UTF-16BE"))
    unit = lambda i: F.conv(F.substr(units, (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("bigint")
    wrapped = F.aggregate(
        F.sequence(F.lit(0), (F.length(units) / 4).cast("int") - 1),
        F.lit(0).cast("bigint"),
        lambda h, i: F.pmod(h * 31 + unit(i), F.lit(1 << 32)),
    )
    signed = F.when(wrapped >= (1 << 31), wrapped - (1 << 32)).otherwise(wrapped)
    return F.when(F.length(units) == 0, F.lit(0).cast("bigint")).otherwise(F.abs(signed))


def cw_hash_str(
    col: Column, k: int, a: int, b: int, p: int = PRIME, fold=fold_crc32
) -> Column:
    """Carter-Wegman hash of a string, folded to an integer first."""
    return cw_hash(fold(col), k, a, b, p)


def murmur_hash(col: Column, k: int, seed: int = MURMUR_SEED) -> Column:
    """Seeded Murmur3 of any key type, as a worker number."""
    return F.pmod(F.hash(F.lit(seed), col), F.lit(k)).cast("int")


@dataclass(frozen=True)
class KeyHash:
    """A member of the hash family for one key type: call it on a column. A NULL key falls into bucket 0."""

    k: int
    a: int = COEFFICIENTS[0][0]
    b: int = COEFFICIENTS[0][1]
    p: int = PRIME
    strings: bool = False

    def __call__(self, col: Column | str) -> Column:
        col = F.col(col) if isinstance(col, str) else col
        make = cw_hash_str if self.strings else cw_hash
        return F.coalesce(make(col, self.k, self.a, self.b, self.p), F.lit(0))


def key_hash(df: DataFrame, k: int, key: str = "key", member: int = 0) -> KeyHash:
    """The hash that fits the type of ``df[key]``; ``member`` picks the (a, b) pair."""
    a, b = COEFFICIENTS[member]
    return KeyHash(k, a, b, strings=isinstance(df.schema[key].dataType, T.StringType))


def seed_primes(n: int, first: int = FIRST_SEED) -> list[int]:
    """The first ``n`` primes from ``first`` on, used as hash seeds."""
    primes: list[int] = []
    x = first
    while len(primes) < n:
        if x > 1 and all(x % d for d in range(2, int(x**0.5) + 1)):
            primes.append(x)
        x += 1
    return primes


def candidates(df: DataFrame, k: int, key: str = "key", choices: int = 2) -> Column:
    """Array of ``choices`` independently hashed workers for the key."""
    return F.array(*[key_hash(df, k, key, member)(key) for member in range(choices)])


def murmur_candidates(col: Column, k: int, choices: int = 2) -> Column:
    """Candidates by Murmur3 of the key, seeded with successive primes."""
    return F.array(*[murmur_hash(col, k, seed) for seed in seed_primes(choices)])
