"""Near-duplicates by SimHash: fingerprints compared by bit planes, linked into components.

A fingerprint has a bit for each of 64 places, set if the hashes of over half the shingles have
it. Two texts are near if their fingerprints differ in at most ``radius`` bits.

* **Candidates.** The 64 bits are cut into ``radius + 2`` blocks. Two fingerprints within the
  radius agree on two blocks at least, so every pair of blocks is a table, keyed by their bits,
  and each distinct fingerprint goes into all tables. No near pair is missed.
* **Comparison.** A bucket's fingerprints are stored as 64 bit planes, a plane being one bit of
  all of them. A query fingerprint turns each plane into the plane of its differences, which
  are added into bitwise carry-save counters; when every lane has passed the radius, the rest
  of the planes are abandoned.
* **Output.** A bucket gives a star over each of its local components, never its pairs.
* **Large buckets.** Above ``chunk`` fingerprints a bucket is cut into chunks, and every two
  chunks are one unit of work, so no task holds a bucket. The cut is by count alone and changes
  no result.

Defined cases: a null text is an empty one; texts without words have fingerprint zero and link
like others; rows with a null id, and rows that repeat an id, are fingerprinted each; a
component's id is its least id that is not null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.components import connected_components
from evenkeel.llm.shared import chosen_columns, give_back, within
from evenkeel.scratch import pin

BITS = 64
SEED = 42
# A-Z only, as the fingerprint is defined on ASCII letters.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, width: int) -> int:
    """SimHash of the text's ``width``-word shingles, repeats counted; zero without words."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    spans = max(len(words) - width + 1, 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, spans, 1 << 14):
        n = min(spans - at, 1 << 14)
        parts = zip(*(words[at + k : at + k + n] for k in range(min(width, len(words)))))
        h = np.fromiter((digest(b" ".join(p), SEED) for p in parts), "<u8", n)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > spans, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text at a time becomes a Python string, however many a batch has.
            fp = np.fromiter((fingerprint(t.as_py() or "", width) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
        give_back()

    return chosen_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows, row ``b`` holding bit ``b`` of all fingerprints, 64 of them to a word."""
    lanes = -len(fps) % 64
    padded = np.concatenate([fps, np.zeros(lanes, np.uint64)])
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def near(planes: np.ndarray, n: int, query: int, radius: int) -> np.ndarray:
    """Places of the fingerprints, among the first ``n``, within ``radius`` bits of ``query``."""
    width = (radius + 1).bit_length()
    counters = [np.zeros(planes.shape[1], np.uint64) for _ in range(width)]
    past = np.zeros(planes.shape[1], np.uint64)
    # Lanes start at such a count that passing the radius carries out of the counters.
    for k in range(width):
        if ((1 << width) - radius - 1) >> k & 1:
            counters[k] = ~counters[k]
    full = ~np.uint64(0)
    for b in range(BITS):
        carry = planes[b] ^ (full if query >> b & 1 else np.uint64(0))
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        past |= carry
        if b >= radius and b % 4 == 3 and (past == full).all():
            return np.zeros(0, np.int64)
    lanes = np.unpackbits((~past).view(np.uint8), bitorder="little")
    return np.flatnonzero(lanes[:n])


def stars(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that tie together whatever is near within ``left``, or between ``left`` and ``right``."""
    other = left if right is None else right
    if right is None and len(left) == 2:
        return [(0, 1)] if int(left[0] ^ left[1]).bit_count() <= radius else []
    planes = bit_planes(other)
    shift = 0 if right is None else len(left)
    root = list(range(len(left) + (0 if right is None else len(right))))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, q in enumerate(left.tolist()):
        for j in near(planes, len(other), q, radius).tolist():
            a, b = find(i), find(j + shift)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(find(i), i) for i in range(len(root)) if find(i) != i]


def _tables(radius: int) -> list[int]:
    """A mask for every two of ``radius + 2`` blocks of bits."""
    edges = [round(k * BITS / (radius + 2)) for k in range(radius + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def near_links(fps: DataFrame, radius: int = 3, chunk: int = 4096) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints of column ``fp`` that join all near ones."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(_tables(radius))])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    large = pin(rows.groupBy("t", "key").count().where(F.col("count") > chunk), "large-buckets")
    sized = rows.join(large, ["t", "key"], "left") if large.take(1) else rows.withColumn("count", F.lit(None).cast("bigint"))
    # Units of work: a whole bucket, or one or two chunks of a large one.
    parts = F.ceil(F.col("count") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    units = F.when(
        F.col("count").isNotNull(),
        F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j"), (mine > o).alias("right"))),
    ).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("right"))))
    work = rows if "count" not in sized.columns else sized
    work = work.select("t", "key", "fp", F.explode(units).alias("u")).select("t", "key", "u.i", "u.j", "u.right", "fp")
    names = ["t", "key", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_groups(batches, names, ["right", "fp"]):
            group, right, fp = cols
            fp = fp.view(np.uint64)
            links = [np.zeros((0, 2), np.uint64)]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            ends = np.r_[starts[1:], len(group)]
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                f, r = fp[s:e], right[s:e]
                if r.any():
                    found = stars(f[~r], f[r], radius)
                    f = np.concatenate([f[~r], f[r]])
                else:
                    found = stars(f, None, radius)
                if found:
                    links.append(f[np.array(found)])
            out = np.concatenate(links).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])
        give_back()

    dealt = work.repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], values: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Sorted batches regrouped so that no group spans two: group numbers, then the value columns."""
    rest: pa.Table | None = None

    def numbered(table: pa.Table) -> tuple[np.ndarray, pa.Table]:
        keys = [table[n].to_numpy() for n in names]
        change = np.zeros(len(table), bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        return np.cumsum(change), table

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not len(table):
            continue
        group, table = numbered(table)
        whole = int(np.searchsorted(group, group[-1]))
        rest = table.slice(whole)
        if whole:
            yield (group[:whole], *(table[v].slice(0, whole).to_numpy() for v in values))
    if rest is not None and len(rest):
        yield (numbered(rest)[0], *(rest[v].to_numpy() for v in values))


def simhash_groups(
    docs: DataFrame, width: int = 3, radius: int = 3, chunk: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``."""
    marked = pin(fingerprints(docs, width, id_col, text_col), "fingerprints")
    # Copies meet here with a map-side part; what follows sees each fingerprint once.
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(near_links(distinct.select("fp"), radius, chunk), "a", "b")
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = pin(placed, "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    component = placed.join(least, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return marked.join(component, "fp").select("doc_id", digits, "component_id")


def keep_first(docs: DataFrame, width: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group the document with the least id stays, all columns kept.

    Rows that repeat an id are one document and stay or go together; rows without an id stay, as
    do texts without words, which are no copies of each other.
    """
    groups = simhash_groups(docs, width, radius, id_col=id_col, text_col=text_col)
    later = groups.where(F.col("component_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") != F.col("component_id"))))
    later = later.where(F.col("fingerprint") != "0" * 16).select("doc_id").where("doc_id IS NOT NULL").distinct()
    later = within(pin(later.withColumnRenamed("doc_id", "_later_id"), "later-copies"), 40)
    return docs.join(later, docs[id_col].cast("bigint") == later["_later_id"], "left_anti")
