"""Importance resampling towards a target text collection (Xie et al. 2023), by word dictionaries.

Features are runs of 1 to ``max_words`` words, hashed to ``buckets`` by CRC-32. A document's weight
is the mean log ratio of its buckets between target and corpus, and documents are drawn without
replacement by adding Gumbel noise that hangs on seed and id alone.

* The distinct words of a block of texts form an Aho-Corasick dictionary. A word stands in it
  between two spaces, so it is found only as a whole, and carries its CRC and length. One scan
  emits the payloads of a text's words in order.
* The CRC of neighbouring words together follows from their payloads: the CRC of the first is
  moved on by the length of the rest, a linear map, and added to it.
* Buckets are written once and read twice, by the counts and by the scores. Each task adds up
  its buckets before they are shuffled; what reaches the driver has ``buckets`` rows.
* Ranks come from range partitions and one offset for each, over documents above a coarse cut.

Defined cases: a null or wordless text has no features, weight 0, and is not eligible; a null id
draws as an empty one and ranks before others of its score; rows that repeat an id share their noise
and rank by features, weight and row; equal rows are ranked apart; extra columns are ignored; an empty
target or table counts no feature, which is no special case; a table without rows gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.ascii_words import byte_columns, pieces, spaced
from evenkeel.llm.shared import per_process
from evenkeel.operators.shape import running_offset
from evenkeel.scratch import pin

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
DRAW = (10, 100)
BLOCK_BYTES = 4 << 20
# Longer words stand in the dictionary under a short name, so its size follows their number.
LONG_WORD = 64
# Width of the bins, in score units, that a first cut is read from.
BIN = 100
_LOW = 0xFFFFFFFF


def _moved(bit: int) -> np.ndarray:
    """Four tables, one for each byte of a CRC, that move it on by ``2**bit`` zero bytes; made once for each process."""
    return per_process(("crc", bit), lambda: _made(bit))


def _made(bit: int) -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    parts = np.stack([value << np.uint32(8 * place) for place in range(4)])
    if bit == 0:
        step = lambda c: zlib.crc32(b"\0", int(c) ^ _LOW) ^ _LOW
        return np.vectorize(step, otypes=[np.uint32])(parts)
    half = _moved(bit - 1)
    return _through(half, _through(half, parts))


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0][crc & np.uint32(255)]
    for place in range(1, 4):
        out = out ^ tables[place][(crc >> np.uint32(8 * place)) & np.uint32(255)]
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of two byte strings in a row, from their CRCs and the length of the second."""
    moved = np.broadcast_to(first, second.shape).astype(np.uint32)
    for bit in range(int(length.max(initial=0)).bit_length()):
        on = (length >> bit & 1).astype(bool)
        moved = np.where(on, _through(_moved(bit), moved), moved)
    return moved ^ second


class WordDictionary:
    """Automaton over the distinct words of some texts; each carries its CRC and its length in bytes."""

    def __init__(self, words: set[bytes]):
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        # No text holds byte 1 between words, so short names meet no word.
        self.names = {w: b"\x01%d" % i for i, w in enumerate(w for w in words if len(w) > LONG_WORD)}
        for w in words:
            name = self.names.get(w, w)
            self.found.add_word(f" {name.decode('latin-1')} ", len(w) << 32 | zlib.crc32(w))
        if words:
            self.found.make_automaton()

    def payloads(self, words: list[bytes]) -> np.ndarray:
        """Payload of every word, in order; neighbours share the space between them."""
        if not words:
            return np.zeros(0, np.int64)
        if self.names:
            words = [self.names.get(w, w) for w in words]
        text = f" {b' '.join(words).decode('latin-1')} "
        return np.fromiter((payload for _, payload in self.found.iter(text)), np.int64)


def features(payload: np.ndarray, max_words: int, buckets: int) -> np.ndarray:
    """Buckets of all runs of 1 to ``max_words`` neighbouring words."""
    crc, length = (payload & _LOW).astype(np.uint32), payload >> 32
    # The CRC of a word with the space before it.
    after = joined_crc(np.uint32(zlib.crc32(b" ")), crc, length)
    out, run = [crc], crc
    for n in range(2, min(max_words, len(crc)) + 1):
        run = joined_crc(run[:-1], after[n - 1 :], length[n - 1 :] + 1)
        out.append(run)
    return (np.concatenate(out) % np.uint32(buckets)).astype(np.int32)


def _blocks(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Number and piece of neighbouring texts, about a block of bytes at a time."""
    block, size = [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text, BLOCK_BYTES):
            block.append((i, piece))
            size += len(piece)
            if size >= BLOCK_BYTES:
                yield block
                block, size = [], 0
    yield block


def bucketed(docs: DataFrame, max_words: int, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, n_words, buckets)``, one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                found: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
                for block in _blocks([spaced(t) for t in batch.column("text").to_pylist()]):
                    cut = [(i, piece.split()) for i, piece in block]
                    dictionary = WordDictionary({w for _, words in cut for w in words})
                    for i, words in cut:
                        found[i].append(dictionary.payloads(words))
                payload = [np.concatenate([*f, np.zeros(0, np.int64)]) for f in found]
                hits = [features(p, max_words, buckets) for p in payload]
                at = np.cumsum([0, *map(len, hits)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*hits, np.zeros(0, np.int32)])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_hash"), pa.array(map(len, payload), pa.int64()), lists],
                    names=["doc_id", "text_hash", "n_words", "buckets"],
                )

    rows = byte_columns(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_words long, buckets array<int>")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows of :func:`bucketed`: ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("buckets").flatten().to_numpy(), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    table = rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths, floored, with one feature more counted in each bucket."""
    buckets = len(corpus)
    ratio = (target + 1.0) * (corpus.sum() + float(buckets)) / ((corpus + 1.0) * (target.sum() + float(buckets)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """``(doc_id, text_hash, n_words, n_features, weight)``; the floored mean gain of a document."""
    sent = rows.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            n = lists.value_lengths().to_numpy().astype(np.int64)
            sums = np.r_[0, np.cumsum(sent.value[lists.flatten().to_numpy()])]
            at = np.r_[0, np.cumsum(n)]
            weight = (sums[at[1:]] - sums[at[:-1]]) // np.maximum(n, 1)
            columns = [*(batch.column(c) for c in ("doc_id", "text_hash", "n_words")), pa.array(n), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise in thousandths, floored, from the first 32 bits of a SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(uniform)))


def resample_ranks(
    docs: DataFrame,
    target: DataFrame,
    max_words: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
    min_words: int = MIN_WORDS,
    draw: tuple[int, int] = DRAW,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_id: str = "item_id",
    target_text: str = "text",
) -> DataFrame:
    """Every document as ``(doc_id, text_hash, n_words, n_features, weight, score, rank)``.

    Of the ``N`` documents with ``min_words`` words or more, ``floor(N * draw[0] / draw[1])`` with
    the highest scores have a rank, from 1; all others have none.
    """
    rows = pin(bucketed(docs, max_words, buckets, id_col, text_col), "buckets")
    goal = bucketed(target, max_words, buckets, target_id, target_text)
    gains = gains_of(bucket_counts(rows, buckets), bucket_counts(goal, buckets))
    scored = weighed(rows, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = pin(scored, "scored")
    may = scored.where(F.col("n_words") >= min_words)
    # Scores lie within some 60 units of log ratio and noise, whatever the input: hundreds of bins.
    bins = may.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.count("*").alias("n")).collect()
    drawn = sum(b.n for b in bins) * draw[0] // draw[1]
    cut, above = None, 0
    for b in sorted(bins, key=lambda b: -b.bin):
        if above < drawn:
            cut, above = b.bin * BIN, above + b.n
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    near = (F.col("n_words") >= min_words) & (F.col("score") >= cut)
    order = ["_down", "doc_id", "n_features", "weight", "text_hash", "_row"]
    placed = scored.where(near).withColumns({"_down": -F.col("score"), "_row": F.monotonically_increasing_id()})
    ranked = running_offset(placed, order, name="_before").drop("_down", "_row")
    ranked = ranked.withColumn("rank", F.when(F.col("_before") < drawn, F.col("_before") + 1)).drop("_before")
    return ranked.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("bigint")))


def drawn_documents(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that have a rank, with all their columns; rows equal in id and text go together."""
    keys = ranks.where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn_id"), F.col("text_hash").alias("_drawn_hash"))
    text = F.coalesce(docs[text_col].cast("string").cast("binary"), F.lit(b""))
    same = docs[id_col].cast("bigint").eqNullSafe(F.col("_drawn_id")) & (F.xxhash64(text) == F.col("_drawn_hash"))
    return docs.join(keys, same, "left_semi")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM dw) GROUP BY ALL),
tf AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM iw) GROUP BY ALL),
bytetab AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS tab
  FROM (SELECT CAST(i AS BIGINT) AS i FROM range(256) AS r(i))),
bytesof AS (SELECT word, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)) AS b
  FROM (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM df UNION SELECT word FROM tf))),
hashed AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
    lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c // 256)), 4294967295) % {BUCKETS} AS bucket FROM bytesof, bytetab),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM tf JOIN hashed USING (word) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS})::DOUBLE
    / ((s + 1)::DOUBLE * (t_all + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), total),
summed AS (SELECT doc_id, sum(n * gain) AS gained FROM df JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
weights AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features,
    CASE WHEN len(w) = 0 THEN 0 ELSE CAST(floor(gained::DOUBLE / len(w)) AS BIGINT) END AS weight,
    CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) AS h FROM dw LEFT JOIN summed USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight,
    weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weights),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {DRAW[0]} * n // {DRAW[1]} THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
