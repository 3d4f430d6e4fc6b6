"""Near-duplicates by shingles: texts that share ``share`` of their five-word shingles or more.

SimHash links texts whose fingerprints differ in few bits, which is most copies, but misses many texts at a
similarity of 0.8, and may link short texts that share less. Here its links are candidates, and the
similarity itself is what counts.

* **Texts.** Words are as in :mod:`evenkeel.llm.simhash`. Equal texts meet by a hash of 64 bits, and
  what follows sees each distinct text once. A shingle is a hash of 64 bits.
* **SimHash.** Each text has a fingerprint of its set of shingles; the operator of :mod:`evenkeel.llm.simhash`
  links equal ones and those within ``RADIUS`` bits by their bit planes.
* **Candidates.** Besides these, a MinHash signature of ``BANDS`` bands of ``ROWS`` lowest hashes each; texts that
  agree on a whole band share its bucket. A pair of similarity ``s`` shares one at least with
  probability ``1 - (1 - s^ROWS)^BANDS``: 0.99978 at 0.8.
* **Bins.** Each text carries which of 1,024 ranges of hashes its set touches. A range that one text touches and the
  other does not holds a shingle that they do not share, which bounds what two texts can share. Only pairs that
  may have the share by that bound move on; none that has it is lost.
* **Verification.** Shingle sets of both texts are compared in full; only pairs that have the share
  are links.
* **Large buckets.** Up to ``SMALL`` texts all pairs are compared. In a larger one some texts, drawn
  by hash, ``DRAWN`` at first and ``GROWTH`` times as many each round, are compared with all that are not yet in
  their component, until what is left to compare lies in one component. No pair is left out that could join two.
  A round links components, not texts, so its graph is as small as what it found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.components import connected_components
from evenkeel.llm.shared import give_back, within
from evenkeel.llm.simhash import LOWER, SEED, near_links
from evenkeel.scratch import pin

WIDTH, SHARE = 5, 0.8
BANDS, ROWS = 16, 4
RADIUS = 3
SMALL = 32
DRAWN, GROWTH = 4, 16
BINS = 1 << 10
_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_BLOCK = 1 << 12


def shingles(text: str, width: int) -> tuple[int, np.ndarray]:
    """Hash of the text's words, and the set of its shingles' hashes; empty without words."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    digest = xxhash.xxh64_intdigest
    spans = max(len(words) - width + 1, 1) if words else 0
    sets = [np.zeros(0, np.uint64)]
    for at in range(0, spans, 1 << 14):
        n = min(spans - at, 1 << 14)
        parts = zip(*(words[at + k : at + k + n] for k in range(min(width, len(words)))))
        sets.append(np.fromiter((digest(b" ".join(p), SEED) for p in parts), np.uint64, n))
    return digest(b" ".join(words)), np.unique(np.concatenate(sets))


def signature(found: np.ndarray) -> np.ndarray:
    """A hash for each band, of the lowest values that its functions take over the set."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), _BLOCK):
        # High bits of products are well mixed; they are what decides which is lowest.
        low = np.minimum(low, (found[at : at + _BLOCK, None] * _FACTORS + _ADDED).min(0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(low.reshape(BANDS, ROWS))], np.uint64)


def majority(found: np.ndarray) -> int:
    """SimHash of a set: a bit for each place that over half the hashes have set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), _BLOCK):
        part = found[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found), bitorder="little").tobytes(), "little")


def touched(found: np.ndarray) -> np.ndarray:
    """A bit for each range of hashes, by their high bits, that the set touches."""
    bins = np.zeros(BINS, bool)
    bins[(found >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(bins, bitorder="little").view("<u8")


def _may_share(million: int) -> Column:
    """Whether ``a`` and ``b`` may have the share, by sizes ``na``, ``nb`` and bins ``sa``, ``sb``."""
    alone = lambda x, y: sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(BINS // 64)), F.lit(0))
    most = F.least(F.col("na") - alone("sa", "sb"), F.col("nb") - alone("sb", "sa"))
    return most * 1_000_000 >= (F.col("na") + F.col("nb") - most) * million


def _simhash_pairs(signed: DataFrame, radius: int) -> DataFrame:
    """``(a, na, b, nb)``: texts that SimHash links. Of each fingerprint the least text stands for the others."""
    texts = pin(signed.select("fp", "t", "n").distinct(), "text-fingerprints")
    first = texts.groupBy("fp").agg(F.min(F.struct("t", "n")).alias("first"))
    equal = texts.join(first, "fp").where(F.col("t") != F.col("first.t")).select(F.col("first.t").alias("a"), F.col("first.n").alias("na"), F.col("t").alias("b"), F.col("n").alias("nb"))
    close = near_links(first.select("fp"), radius)
    ends = [first.select(F.col("fp").alias(e), F.col("first.t").alias(f"t_{e}"), F.col("first.n").alias(f"n{e}")) for e in ("a", "b")]
    close = close.join(ends[0], "a").join(ends[1], "b").select(F.col("t_a").alias("a"), "na", F.col("t_b").alias("b"), "nb")
    return pin(equal.unionByName(close), "simhash-pairs")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


def _signed(rows: DataFrame, width: int) -> DataFrame:
    """``(doc_id, version, t, n, fp, bands, bins)`` of texts with words; ``t`` stands for the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, n, fp, bands, bins = (np.zeros(batch.num_rows, k) for k in (np.uint64, np.int64, np.uint64, f"({BANDS},)u8", f"({BINS // 64},)u8"))
            for i, text in enumerate(batch.column("text")):
                t[i], found = shingles(text.as_py(), width)
                n[i] = len(found)
                if len(found):
                    bands[i], fp[i], bins[i] = signature(found), majority(found), touched(found)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1).view(np.int64)), x.shape[1]).cast(pa.list_(pa.int64())) for x in (bands, bins)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array(t.view(np.int64)), pa.array(n), pa.array(fp.view(np.int64)), *lists],
                names=["doc_id", "version", "t", "n", "fp", "bands", "bins"],
            )
        give_back()

    return rows.mapInArrow(run, "doc_id long, version long, t long, n long, fp long, bands array<long>, bins array<long>").where("n > 0")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """``(t, hs)``: the shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                t, found = shingles(text.as_py(), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array([t], np.uint64).view(np.int64)), pa.array([found.view(np.int64)], pa.list_(pa.int64()))], names=["t", "hs"]
                )
        give_back()

    return rows.select("text").mapInArrow(run, "t long, hs array<long>")


def _links(pairs: DataFrame, sets: DataFrame, million: int, *ends: str) -> DataFrame:
    """Those of the pairs ``(a, na, b, nb)`` that have the share, as ``(a, b)``, with the ``ends`` that belong to a pair."""
    # Sets whose sizes lie further apart than the share cannot have it.
    fit = pairs.where(F.least("na", "nb") * 1_000_000 >= F.greatest("na", "nb") * million)
    fit = fit.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *ends).distinct()
    met = fit.join(sets.select(F.col("t").alias("a"), F.col("hs").alias("ha")), "a").join(sets.select(F.col("t").alias("b"), F.col("hs").alias("hb")), "b")
    size = lambda c: F.size(c).cast("bigint")
    both = size(F.array_intersect("ha", "hb"))
    return pin(met.where(both * 1_000_000 >= (size("ha") + size("hb") - both) * million).select("a", "b", *ends), "verified")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after links between components, ``(low, high)`` being two roots each."""
    new = pin(connected_components(links, "low", "high"), "joined-roots")
    every = roots.unionByName(new.select("node", F.col("node").alias("root"))).distinct()
    moved = new.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return pin(every.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")


def near_texts(rows: DataFrame, width: int = WIDTH, share: float = SHARE, small: int = SMALL, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, version, t)`` of rows with words, and ``(t, root)`` of texts that are near another."""
    signed = pin(_signed(rows, width), "signed")
    one = signed.select("t", "n", F.posexplode("bands").alias("band", "key")).distinct()
    sizes = one.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = pin(one.join(sizes, ["band", "key"]), "members")
    linked = _simhash_pairs(signed, radius)
    near = members.select("t").unionByName(linked.select(F.explode(F.array("a", "b")).alias("t"))).distinct()
    wanted = signed.join(near, "t", "left_semi").groupBy("t").agg(F.min("version").alias("version"), F.first("bins").alias("bins"))
    wanted = pin(wanted, "wanted-texts")
    texts = rows.join(within(wanted.select("version"), 40), "version", "left_semi").dropDuplicates(["version"])
    sets = pin(_sets(texts, width), "shingle-sets")

    # Where a text stands among those that are drawn, from 0 to 1.
    place = F.pmod(F.xxhash64("t"), F.lit(1 << 40)) / float(1 << 40)
    members = pin(members.join(wanted.select("t", "bins"), "t").withColumn("place", place), "placed-members")
    million = round(share * 1_000_000)
    end = lambda df, x, *more: df.select("band", "key", F.col("t").alias(x), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"s{x}"), *more)
    # All pairs of small buckets; of large ones those with the texts that are drawn first.
    leads = members.where((F.col("size") <= small) | (F.col("place") < F.lit(float(DRAWN)) / F.col("size")))
    banded = end(leads, "a").join(end(members, "b", "size"), ["band", "key"]).where(F.expr(f"a < b OR a > b AND size > {small}") & _may_share(million))
    links = _links(banded.select("a", "na", "b", "nb").unionByName(linked), sets, million)
    roots = pin(connected_components(links, "a", "b"), "roots")

    many = members.where(F.col("size") > small)
    placed = signed.select("doc_id", "version", "t")
    if not many.take(1):
        return placed, roots
    drawn = DRAWN
    while True:
        now = many.join(roots.withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t"))
        now = pin(now, "bucket-roots")
        waiting = F.col("place") >= F.lit(float(drawn)) / F.col("size")
        # A text drawn before has met all others; what waits has to be in two components at least.
        unsure = now.where(waiting).groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band", "key")
        unsure = pin(unsure, "unsure")
        if not unsure.take(1):
            return placed, roots
        then = GROWTH * drawn
        open_now = now.join(within(unsure, 48), ["band", "key"], "left_semi")
        leads = open_now.where(waiting & (F.col("place") < F.lit(float(then)) / F.col("size")))
        leads = end(leads, "a", F.col("root").alias("root_a"))
        others = end(open_now, "b", F.col("root").alias("root_b"))
        pairs = others.join(within(pin(leads, "leads"), 256), ["band", "key"]).where((F.col("root_a") != F.col("root_b")) & _may_share(million))
        pairs = pairs.select("a", "na", "b", "nb", F.least("root_a", "root_b").alias("low"), F.greatest("root_a", "root_b").alias("high"))
        roots = _joined(roots, _links(pairs, sets, million, "low", "high"))
        drawn = then


def keep_first(docs: DataFrame, width: int = WIDTH, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """Of each group of near texts the document with the least id stays, all columns kept.

    A document is its id and text: rows that repeat both stay or go together, rows that repeat an id
    with other texts are judged by their texts. A null id comes after all others. Texts without
    words stay, as they are no copies of each other.
    """
    placed, roots = near_texts(_rows(docs, id_col, text_col), width, share, small)
    placed = placed.join(roots.withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t"))
    placed = pin(placed.select("root", F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "version").alias("place")), "placed")
    first = placed.groupBy("root").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").select("root", "first")
    later = placed.join(first, "root").where("place <> first").select(F.col("place.doc_id").alias("_later_id"), F.col("place.version").alias("_later_version")).distinct()
    later = within(pin(later, "later-copies"), 48)
    version = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    same = docs[id_col].cast("bigint").eqNullSafe(later["_later_id"]) & (version == later["_later_version"])
    return docs.join(later, same, "left_anti")
