"""Language-model scores by stupid backoff (Brants et al. 2007), computed by joins.

The score of a word after another is ``c(a b) / c(a)`` if the pair occurs ``least`` times or
more in all documents, else ``alpha * c(b) / N``; a document's score is the mean of its words'
logarithms. Words are lower-cased; a word stands for itself by 64 bits of xxHash, a pair by
64 bits mixed from both. Words and pairs are counted without bound.

* **Blocks.** Neighbouring documents of some megabytes are one row: their words by number, and the hashes
  of the words that occur. They are written once.
* **Questions.** Each block makes its words and its pairs distinct, with how often it has them, and sends
  them to tables dealt out by hash. A packed row holds all keys that go from one block to one
  part of a table, sorted, as differences in planes of bytes, so a key takes about five bytes.
* **Counts.** A part of a table adds up what all blocks sent. Parts follow the number of words, so each
  has about a million; a key stands there once for a block, however frequent it is.
* **Answers.** Pairs that reach ``least``, and all words, go back to the blocks that asked, by place and
  total. A block then scores its words in place, and what it found is summed per document.

Defined cases: a null or blank text has no words and score null; rows that repeat an id are one
document, as are all rows with a null id; extra columns are ignored; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.ascii_words import byte_columns, pieces
from evenkeel.llm.shared import give_back
from evenkeel.scratch import pin

ALPHA = 0.4
LEAST = 2
BLOCK_BYTES = 16 << 20
# Words of the corpus for one part of a table.
PART_WORDS = 1 << 20
# Words of a block whose pairs are hashed at once.
SOME_WORDS = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def planes(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, all lowest bytes first: high planes of small numbers are zeros."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits that stand for two words in this order."""
    h = (a * _ODD[0]) ^ (b + (a >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(32))) * _ODD[1]
    h = (h ^ (h >> np.uint64(29))) * _ODD[0]
    return h ^ (h >> np.uint64(32))


class Block:
    """Words of some documents: hashes of the distinct ones, the number of each word, where documents end."""

    def __init__(self, vocabulary: np.ndarray, codes: np.ndarray, ends: np.ndarray):
        self.vocabulary, self.codes, self.ends = vocabulary, codes, ends

    def pairs(self) -> np.ndarray:
        """Hashes of all neighbouring words of a document, in order; made some at a time, as each step makes an array."""
        joined = self.joined()
        parts = [np.zeros(0, np.uint64)]
        for a in range(0, len(joined), SOME_WORDS):
            hashes = self.vocabulary[self.codes[a : a + SOME_WORDS + 1]]
            parts.append(pair_hashes(hashes[:-1], hashes[1:])[joined[a : a + SOME_WORDS]])
        return np.concatenate(parts)

    def counted(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words (0) or pairs (1) in ascending order, and how often each occurs."""
        if kind:
            return np.unique(self.pairs(), return_counts=True)
        keys, place = np.unique(self.vocabulary, return_inverse=True)
        each = np.bincount(self.codes, minlength=len(self.vocabulary))
        return keys, np.bincount(place, each, len(keys)).astype(np.int64)

    def places(self, kind: int) -> tuple[int, np.ndarray]:
        """The number of distinct words or pairs, and the place of each occurrence among them."""
        hashes = self.pairs() if kind else self.vocabulary
        keys, at = np.unique(hashes, return_inverse=True)
        at = at.astype(np.uint32)
        return len(keys), at if kind else at[self.codes]

    def joined(self) -> np.ndarray:
        """Whether each word but the first stands after one of its own document."""
        out = np.ones(max(len(self.codes) - 1, 0), bool)
        cuts = self.ends[(self.ends > 0) & (self.ends < len(self.codes))]
        out[cuts - 1] = False
        return out


def _numbered(texts: list[tuple[int | None, bytes]]) -> tuple[list[int | None], Block]:
    number: dict[bytes, int] = {}
    parts, ends, total = [np.zeros(0, np.uint32)], [], 0
    for _, text in texts:
        for piece in pieces(text, 1 << 20):
            words = piece.split()
            for w in dict.fromkeys(words):
                number.setdefault(w, len(number))
            parts.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
            total += len(words)
        ends.append(total)
    codes = np.concatenate(parts)
    # Frequent words get small numbers.
    order = np.argsort(-np.bincount(codes, minlength=len(number)), kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    return [doc_id for doc_id, _ in texts], Block(hashes[order], place[codes], np.asarray(ends, np.int64))


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(block, ids, ends, vocabulary, codes, n_words)``: neighbouring documents, one row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32

        def row(texts):
            ids, b = _numbered(texts)
            codes = b.codes.astype(np.uint32)
            values = [[name], [ids], [b.ends], [planes(b.vocabulary)], [planes(codes)], [len(codes)]]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64())
            names = ["block", "ids", "ends", "vocabulary", "codes", "n_words"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

        texts, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                texts.append((doc_id, text.as_py()))
                size += len(texts[-1][1])
                if size >= block_bytes:
                    yield row(texts)
                    name, texts, size = name + 1, [], 0
        if texts:
            yield row(texts)
        give_back()

    return docs.mapInArrow(run, "block long, ids array<long>, ends array<long>, vocabulary binary, codes binary, n_words long")


def _block(batch, row: int = 0) -> Block:
    value = lambda c: batch.column(c)[row].as_py()
    return Block(from_planes(value("vocabulary"), np.uint64), from_planes(value("codes"), np.uint32), np.asarray(value("ends"), np.int64))


def _questions(blocks: DataFrame, bits: int) -> DataFrame:
    """``(kind, part, block, first, keys, n)``: a block's keys for one part of a table; ``first`` is the place of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, name = _block(batch, row), batch.column("block")[row].as_py()
                for kind in (0, 1):
                    keys, n = block.counted(kind)
                    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
                    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
                    for some in np.array_split(np.arange(len(starts)), max(len(starts) // 256, 1)):
                        rows = [(a, b) for a, b in zip(starts[some], np.r_[starts, len(keys)][some + 1])] if len(some) else []
                        if rows:
                            columns = [
                                pa.array([kind] * len(rows), pa.int32()),
                                pa.array([part[a] for a, _ in rows], pa.int64()),
                                pa.array([name] * len(rows), pa.int64()),
                                pa.array([a for a, _ in rows], pa.int64()),
                                pa.array([planes(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in rows], pa.binary()),
                                pa.array([planes(n[a:b].astype(np.uint32)) for a, b in rows], pa.binary()),
                            ]
                            yield pa.RecordBatch.from_arrays(columns, names=["kind", "part", "block", "first", "keys", "n"])
        give_back()

    return blocks.select("block", "ends", "vocabulary", "codes").mapInArrow(run, "kind int, part long, block long, first long, keys binary, n binary")


def _answers(questions: DataFrame, least: int) -> DataFrame:
    """``(block, kind, at, n)``: places of a block's keys and their totals, of pairs only those that reach ``least``."""

    def count(table: pa.Table) -> pa.Table:
        kind, names, first = table.column("kind")[0].as_py(), table.column("block"), table.column("first").to_pylist()
        keys = [np.cumsum(from_planes(k.as_py(), np.uint64), dtype=np.uint64) for k in table.column("keys")]
        n = np.concatenate([from_planes(x.as_py(), np.uint32) for x in table.column("n")]).astype(np.int64)
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, n)[which].astype(np.int64)
        at, totals, start = [], [], 0
        for a, k in zip(first, keys):
            mine = total[start : start + len(k)]
            kept = np.flatnonzero(mine >= (least if kind else 1))
            at.append(planes((a + kept).astype(np.uint32)))
            totals.append(planes(mine[kept]))
            start += len(k)
        kinds = pa.array([kind] * table.num_rows, pa.int32())
        return pa.table({"block": names, "kind": kinds, "at": pa.array(at, pa.binary()), "n": pa.array(totals, pa.binary())})

    return questions.groupBy("kind", "part").applyInArrow(count, "block long, kind int, at binary, n binary")


def lm_scores(
    docs: DataFrame,
    alpha: float = ALPHA,
    least: int = LEAST,
    block_bytes: int = BLOCK_BYTES,
    part_words: int = PART_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_words, n_backoff, score)``, ``score`` being the mean natural logarithm."""
    lowered = docs.select(docs[id_col].alias("doc_id"), F.lower(docs[text_col].cast("string")).alias("text"))
    blocks = pin(blocks_of(byte_columns(lowered, "doc_id", "text"), block_bytes), "blocks")
    total = int(blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0])
    bits = max((total // part_words).bit_length(), 4)
    answers = _answers(_questions(blocks, bits), least)
    start = float(np.log(alpha) - np.log(max(total, 1)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(k.as_py(), from_planes(a.as_py(), np.uint32), from_planes(n.as_py(), np.int64)) for k, a, n in zip(*(right.column(c) for c in ("kind", "at", "n")))]
        block, ids = _block(left), left.column("ids")[0].as_py()
        logs, places = [], []
        for kind in (0, 1):
            size, at = block.places(kind)
            # Zero for a pair that is too rare; a word always has a count.
            counts = np.zeros(size, np.int64)
            for k, where, n in found:
                if k == kind:
                    counts[where] = n
            places.append(counts[at] > 0)
            logs.append(np.log(np.maximum(counts, 1))[at])
        n = len(block.codes)
        value, backed = logs[0] + start, np.ones(n, bool)
        pairs = np.flatnonzero(block.joined())[places[1]]
        value[pairs + 1] = logs[1][places[1]] - logs[0][pairs]
        backed[pairs + 1] = False
        sizes = np.diff(block.ends, prepend=0)
        text = np.repeat(np.arange(len(ids), dtype=np.uint32), sizes)
        per_doc = lambda x: np.bincount(text, x, minlength=len(ids))
        columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(per_doc(backed).astype(np.int64)), pa.array(per_doc(value).astype(np.float64))]
        return pa.table(columns, names=["doc_id", "n_words", "n_backoff", "value"])

    asked = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    rows = asked.applyInArrow(score, "doc_id long, n_words long, n_backoff long, value double")
    rows = rows.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_backoff", "value")))
    mean = F.col("value") / F.when(F.col("n_words") > 0, F.col("n_words"))
    return rows.select("doc_id", "n_words", "n_backoff", F.round(mean, 6).alias("score"))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS MATERIALIZED (SELECT doc_id, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
one AS (SELECT b AS word, count(*) AS n FROM t GROUP BY b),
two AS (SELECT a, b, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
scored AS (SELECT doc_id, two.n IS NULL AS backed, CASE WHEN two.n IS NULL
    THEN ln(CAST({ALPHA} AS DOUBLE) * cb.n / (SELECT count(*) FROM t)) ELSE ln(two.n::DOUBLE / ca.n) END AS value
  FROM t JOIN one cb ON cb.word = t.b LEFT JOIN two ON two.a = t.a AND two.b = t.b LEFT JOIN one ca ON ca.word = t.a),
summed AS (SELECT doc_id, count(*) FILTER (backed) AS n_backoff, avg(value) AS mean FROM scored GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(mean, 6) AS score
FROM d LEFT JOIN summed USING (doc_id)
"""
