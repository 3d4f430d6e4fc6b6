"""Maximal periodic runs of words, found in tiles of each octave of periods.

A run is a stretch of words with smallest period ``q`` and at least ``max(least, times * q)`` words that
no neighbouring word extends. Periods from ``L`` to ``2L - 1``, ``L`` a power of two, are one octave. In it
a cut stands at every ``L``-th word, so a run has one within its first ``L`` words.

* :func:`tiled` numbers a text's words and explodes it into overlapping tiles for each octave: a range
  of cuts with the words around them that an octave needs. A cut is kept only if the few words from it
  on that a run must repeat (:func:`gram_size`) seem to return within the octave, and a tile only if it has such a cut.
* Tiles are shuffled, so those of a long text are solved side by side. At each cut a Z-function of
  the words after it gives for every period how far it holds to the right and whether its root
  is a power of a shorter one; a Z-function of the reversed words gives how far it holds to the left.
  Both see a bounded window and yield fragments, clipped there and merged within the tile.
* Fragments are shuffled by document and period. Those that share ``q`` words or more belong to
  one run, as two different runs of period ``q`` share less, and are stitched together.
* Text is written again for documents with tiles only, to take repeats out and hash what is left.

Defined cases: a null or wordless text has no runs; null and repeated ids are rows like any other, told
apart by a row key; extra columns are ignored; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.ascii_words import byte_columns, pieces
from evenkeel.llm.shared import per_process
from evenkeel.scratch import pin

LEAST = 24
TIMES = 3
TILE_WORDS = 1 << 14
PIECE_BYTES = 1 << 20
# Words of tiles that one task solves, about.
TASK_WORDS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def numbered(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a text, and the number of each word in order."""
    code: dict[bytes, int] = {}
    parts = [np.zeros(0, np.int32)]
    for piece in pieces(text, PIECE_BYTES):
        words = piece.split()
        for w in dict.fromkeys(words):
            code.setdefault(w, len(code))
        parts.append(np.fromiter(map(code.__getitem__, words), np.int32, len(words)))
    return list(code), np.concatenate(parts)


def joined_sha256(words: list[bytes], ids: np.ndarray) -> str:
    """SHA-256 of words joined by a space."""
    digest = hashlib.sha256()
    for a in range(0, len(ids), 1 << 16):
        digest.update((b" " if a else b"") + b" ".join(map(words.__getitem__, ids[a : a + (1 << 16)].tolist())))
    return digest.hexdigest()


def gram_size(least: int, times: int) -> int:
    """Words from its first cut on that surely return one period later in a run of any octave."""
    if times < 3 or least < 1:
        raise ValueError("runs have three periods or more, and a word at least")
    octaves = [1 << i for i in range(least.bit_length())]
    return min(max(least, times * q) - q - octave + 1 for octave in octaves for q in range(octave, 2 * octave))


def gram_hashes(ids: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` words from each word on. Equal hashes of unequal words cost time alone."""
    n = len(ids) - gram + 1
    wide = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    wide ^= wide >> np.uint64(29)
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(gram if n > 0 else 0):
        out = out * _MIX + wide[i : i + n]
    return out


def tiles_of(ids: np.ndarray, least: int, times: int, tile_words: int, gram: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(octave, first word, cuts, words)`` of each tile that may hold a fragment."""
    n = len(ids)
    if n < least:
        return
    grams = gram_hashes(ids, gram)
    octave = 1
    while times * octave <= n:
        step = max(tile_words, octave)
        for low in range(0, len(grams) - octave, step):
            cuts = np.arange(low, min(low + step, len(grams) - octave), octave)
            # Row by row, the grams one octave further on.
            ahead = grams[low + octave : low + octave * (len(cuts) + 1)]
            missing = len(cuts) * octave - len(ahead)
            if missing:
                ahead = np.concatenate([ahead, np.zeros(missing, np.uint64)])
            found = ahead.reshape(-1, octave) == grams[low : low + step : octave][: len(cuts), None]
            cuts = cuts[found.any(axis=1)]
            if len(cuts):
                first = max(int(cuts[0]) - octave, 0)
                yield octave, first, cuts, ids[first : int(cuts[-1]) + 4 * octave + gram]
        octave *= 2


def z_function(x: list[int]) -> list[int]:
    """For each place, how many items from there on equal those from the start on."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    low = high = 0
    for i in range(1, n):
        k = min(high - i, z[i - low]) if i < high else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def primes_of(n: int) -> tuple[int, ...]:
    """The prime divisors of a number."""
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return (*out, n) if n > 1 else tuple(out)


def is_primitive(z: list[int], q: int) -> bool:
    """Whether the first ``q`` items are no power of fewer, by the Z-function from there on."""
    known = per_process(("prime divisors",), dict)
    if q not in known:
        known[q] = primes_of(q)
    return not any(z[q // p] >= q - q // p for p in known[q])


def fragments_at(words: list[int], cut: int, octave: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """``(period, start, end)`` of what has a period of the octave around a cut, within the window."""
    z = z_function(words[cut : cut + 4 * octave + gram])
    held = [q for q in range(octave, min(2 * octave, len(z))) if z[q] >= gram and is_primitive(z, q)]
    if held:
        stop = min(cut + 2 * octave, len(words))
        before = words[max(cut - octave, 0) : cut][::-1]
        back = z_function([*before, -1, *words[max(cut - octave, 0) : stop][::-1]])
        for q in held:
            left = min(back[len(before) + 1 + stop - cut - q], len(before))
            yield q, cut - left, cut + q + z[q]


def merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fragments of one text, those that share a period's length of words as one."""
    out: list[tuple[int, int, int]] = []
    for q, start, end in sorted(found):
        if out and out[-1][0] == q and start <= out[-1][2] - q:
            out[-1] = (q, out[-1][1], max(out[-1][2], end))
        else:
            out.append((q, start, end))
    return out


_PARTS = "key long, doc_id long, n_words long, sha256 string, words binary, octave int, first long, cuts array<long>, ids array<int>"
_PARTS_ARROW = pa.schema(
    [("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha256", pa.string()), ("words", pa.binary()),
     ("octave", pa.int32()), ("first", pa.int64()), ("cuts", pa.list_(pa.int64())), ("ids", pa.list_(pa.int32()))]
)

Prepare = Callable[[int | None, np.ndarray], np.ndarray]


def tiled(
    docs: DataFrame,
    prepare: Prepare | None = None,
    least: int = LEAST,
    times: int = TIMES,
    tile_words: int = TILE_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each document, and after it one for each of its tiles (those have an ``octave``).

    ``prepare`` may change a document's word numbers first. Documents with tiles keep their words.
    """

    gram = gram_size(least, times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, held = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                key += 1
                words, ids = numbered(text.as_py())
                if prepare:
                    ids = prepare(doc_id, ids)
                tiles = list(tiles_of(ids, least, times, tile_words, gram))
                kept = b" ".join(map(words.__getitem__, ids.tolist())) if tiles else None
                rows.append({"key": key, "doc_id": doc_id, "n_words": len(ids), "sha256": joined_sha256(words, ids), "words": kept})
                rows += [{"key": key, "octave": o, "first": f, "cuts": c, "ids": i} for o, f, c, i in tiles]
                held += 100 + len(kept or b"") + sum(8 * len(c) + 4 * len(i) for _, _, c, i in tiles)
                if held >= PIECE_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PARTS_ARROW)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=_PARTS_ARROW)

    return byte_columns(docs, id_col, text_col).mapInArrow(run, _PARTS)


def solved(tiles: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Fragments ``(key, period, start, end)`` of tiles, each solved on its own."""
    gram = gram_size(least, times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, octave, first = (batch.column(c)[row].as_py() for c in ("key", "octave", "first"))
                words = batch.column("ids")[row].as_py()
                found = merged([f for cut in batch.column("cuts")[row].as_py() for f in fragments_at(words, cut - first, octave, gram)])
                # A window shows one octave of words to the left and more to the right; what is shorter ended within it.
                keep = [(key, q, first + a, first + b) for q, a, b in found if b - a >= min(max(least, times * q), octave + q)]
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*keep)], names=["key", "period", "start", "end"])

    return tiles.select("key", "octave", "first", "cuts", "ids").mapInArrow(run, "key long, period long, start long, end long")


def stitched(fragments: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Runs ``(key, start, length, period)`` from the fragments of all tiles."""
    ordered = Window.partitionBy("key", "period").orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") <= reach - F.col("period"), 0).otherwise(1)
    return (
        fragments.withColumn("_opens", opens)
        .withColumn("_run", F.sum("_opens").over(ordered))
        .groupBy("key", "period", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select("key", "start", (F.col("end") - F.col("start")).alias("length"), "period")
        .where((F.col("length") >= least) & (F.col("length") >= times * F.col("period")))
    )


def periodic_runs(docs: DataFrame, prepare: Prepare | None = None, least: int = LEAST, times: int = TIMES, tile_words: int = TILE_WORDS, **columns: str) -> tuple[DataFrame, DataFrame]:
    """A written table of documents and the runs of all of them, joined by ``key``.

    Documents: ``(key, doc_id, n_words, sha256, words)``, ``words`` being null where there can't be a run;
    runs: ``(key, start, length, period)``.
    """
    parts = pin(tiled(docs, prepare, least, times, tile_words, **columns), "tiles")
    tiles = parts.where(F.col("octave").isNotNull())
    size = int(tiles.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0])
    # A number of its own, as tiles are small by bytes but not by work.
    tasks = max(size // TASK_WORDS, docs.sparkSession.sparkContext.defaultParallelism)
    spread = tiles.repartition(tasks, "key", "octave", "first")
    runs = pin(stitched(solved(spread, least, times), least, times), "runs")
    return parts.where(F.col("octave").isNull()).select("key", "doc_id", "n_words", "sha256", "words"), runs


def collapsed(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents with their runs as an array, and their text and its hash without repeats.

    Of each run the first period stays. ``collapsed`` is null where there can't be a run.
    """
    lists = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    none = F.expr("CAST(array() AS array<struct<start:bigint,period:bigint,length:bigint>>)")
    # Only documents with tiles keep their words, and only they can have runs.
    plain = documents.where(F.col("words").isNull()).select("doc_id", "n_words", none.alias("runs"), F.col("words").alias("collapsed"), "sha256")
    some = documents.where(F.col("words").isNotNull()).join(lists, "key", "left")
    some = some.select("doc_id", "n_words", F.coalesce("runs", none).alias("runs"), "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = batch.column("words")[row].as_py().split(b" ")
                keep = np.ones(len(words), bool)
                for r in batch.column("runs")[row].as_py():
                    keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
                text = b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(row, 1) for c in ("doc_id", "n_words", "runs")), pa.array([text], pa.binary()), pa.array([hashlib.sha256(text).hexdigest()])],
                    names=["doc_id", "n_words", "runs", "collapsed", "sha256"],
                )

    schema = "doc_id long, n_words long, runs array<struct<start:bigint,period:bigint,length:bigint>>, collapsed binary, sha256 string"
    return plain.unionByName(some.mapInArrow(run, schema))


def run_report(found: DataFrame) -> DataFrame:
    """Number of runs, the one with the greatest exponent, and digests of runs and collapsed text.

    Exponents are compared as doubles: correctly rounded, two different ones of a text of less than 2^26
    words are different doubles.
    """
    best = F.array_min(
        F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("down"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.col("sha256").alias("collapsed_sha256"),
    )


def with_planted_tail(doc_id: int | None, ids: np.ndarray) -> np.ndarray:
    """The words that the registered query looks at: one document in ten, by its id, ends in repeats."""
    h, n = (1, 0) if doc_id is None else (zlib.crc32(str(doc_id).encode()), len(ids))
    g = h // 10
    if h % 10 or not n:
        return ids
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.r_[ids[:a], ids[a + np.arange(n - a) % p]]


SQL = r"""
WITH docw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, hex(encode(CAST(doc_id AS VARCHAR))) AS x FROM documents),
bytetab AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS tab
  FROM (SELECT CAST(i AS BIGINT) AS i FROM range(256) AS r(i))),
hashed AS (SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c // 256)), 4294967295) AS h FROM docw, bytetab),
tail AS (SELECT doc_id, w, n, h, (h // 10) % greatest(n, 1) AS a, 3 + (h // 10) % 8 AS f FROM hashed),
word AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // f) END]) ELSE w END AS w FROM tail),
gram AS MATERIALIZED (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 8], ' ') AS s FROM (SELECT doc_id, n, w, unnest(range(n - 7)) AS i FROM word)),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM gram x JOIN gram y ON x.doc_id = y.doc_id AND x.s = y.s AND y.i > x.i AND (y.i - x.i) * 3 <= x.n),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same),
found AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 8 + q AS length FROM island GROUP BY doc_id, q, g),
run AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM found WHERE length >= 24 AND length >= 3 * q GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM word) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first({'start': start, 'length': length, 'period': period} ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS best FROM run GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
  1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM docw LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
