"""Language identification: averaged embeddings of hashed subwords and a linear softmax.

A text is the average of the embeddings of its subwords (runs of three and of four bytes of its
lower-cased letters, other characters being blanks), hashed into ``BUCKETS`` rows. A linear
layer gives a score to each language. Both are trained by stochastic gradient descent in numpy
on a bounded sample; the confidence is calibrated by a temperature on rows set aside, and a
prediction less sure than a calibrated bound is marked ``rejected``.

Since averaging and layer are linear, prediction needs one table of scores per bucket.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a null id belongs
to no fold and is not learned from; repeated rows are predicted each; extra columns are
ignored; with no labelled rows everything is ``und`` with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.shared import fold_of, utf8_of, with_sample
from evenkeel.scratch import pin

BUCKETS = 1 << 16
WIDTHS = (3, 4)
BLOCK = 1 << 21
_BLANK = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def buckets(data: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """The bucket of the subword that starts at each byte; ``BUCKETS`` where it would pass its text's end."""
    n = len(data)
    out = np.full(n, BUCKETS, np.int32)
    if n < width:
        return out
    h = np.zeros(n - width + 1, np.uint32)
    for k in range(width):
        h = h * np.uint32(0x01000193) ^ data[k : n - width + 1 + k]
    h *= np.uint32(0x9E3779B1)
    out[: n - width + 1] = h >> np.uint32(16)
    for k in range(1, width):
        at = ends - k
        out[at[at >= 0]] = BUCKETS
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, share = [], []
        for t in batch.column("text").to_pylist():
            data = _BLANK[np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)]
            ends = np.array([len(data)])
            count = sum(np.bincount(buckets(data, ends, w), minlength=BUCKETS + 1)[:BUCKETS] for w in WIDTHS)
            hit = np.flatnonzero(count)
            at.append(hit.astype(np.int32))
            share.append((count[hit] / max(count.sum(), 1)).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))],
            names=["doc_id", "lang", "at", "share"],
        )


class Model:
    """Embeddings, softmax layer, temperature and bound, fitted on sparse subword shares."""

    def __init__(self, at: list[np.ndarray], share: list[np.ndarray], lang: list[str], dim: int = 16, epochs: int = 12, sure: float = 0.995, seed: int = 3):
        self.langs = sorted(set(lang))
        y = np.array([self.langs.index(x) for x in lang])
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, train = order[: len(y) // 5], order[len(y) // 5 :]
        # Rare languages are shown as often as others, and all of them longer if there are many.
        shown = np.bincount(y[train], minlength=len(self.langs))
        often = np.round(shown.max(initial=0) / np.maximum(shown, 1)).astype(np.int64)
        train = np.repeat(train, np.clip(often[y[train]], 1, 8))
        epochs = round(epochs * max(1.0, len(self.langs) / 16))
        emb = rng.normal(0, 1, (BUCKETS, dim)).astype(np.float32)
        layer = np.zeros((dim, len(self.langs)), np.float32)
        rate = 0.5
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(train), max(len(train) // 32, 1)):
                if not len(rows):
                    continue
                flat, weight = np.concatenate([at[i] for i in rows]), np.concatenate([share[i] for i in rows])
                owner = np.repeat(np.arange(len(rows)), [len(at[i]) for i in rows])
                starts = np.r_[0, np.cumsum([len(at[i]) for i in rows])[:-1]]
                mean = np.add.reduceat(np.r_[emb[flat] * weight[:, None], np.zeros((1, dim), np.float32)], starts, axis=0)
                mean[np.array([len(at[i]) for i in rows]) == 0] = 0
                error = self._softmax(mean @ layer)
                error[np.arange(len(rows)), y[rows]] -= 1
                step = rate * (1 - epoch / epochs) / len(rows)
                back = error @ layer.T
                layer -= step * (mean.T @ error)
                np.subtract.at(emb, flat, (step * 100) * back[owner] * weight[:, None])
        self.table = np.vstack([emb @ layer, np.zeros((1, len(self.langs)), np.float32)]).astype(np.float32)
        self.temperature, self.bound = 1.0, 0.0
        if len(held):
            z = np.array([(self.table[at[i]] * share[i][:, None]).sum(0) for i in held])
            grid = np.geomspace(0.02, 5, 40)
            loss = [-np.log(self._softmax(z / t)[np.arange(len(held)), y[held]] + 1e-9).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
            p = self._softmax(z / self.temperature)
            best, right = p.max(1), p.argmax(1) == y[held]
            for b in np.r_[0.0, np.sort(best)]:
                self.bound = float(b)
                if right[best >= b].mean() >= sure:
                    break

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probabilities for each text of a byte buffer, a block of bytes at a time."""
        total, number = np.zeros((len(at) - 1, len(self.langs))), np.zeros(len(at) - 1)
        for first in range(0, len(data), BLOCK):
            last = min(first + BLOCK, len(data))
            # Subwords that start here may reach past the block; the texts' ends bound them.
            part = _BLANK[data[first : min(last + max(WIDTHS), len(data))]]
            a, b = np.searchsorted(at, first, "right") - 1, np.searchsorted(at, last, "left")
            starts = np.maximum(at[a:b], first) - first
            filled = np.flatnonzero(np.diff(np.r_[starts, last - first]) > 0)
            ends = at[a + 1 : b + 1] - first
            for w in WIDTHS:
                h = buckets(part, ends[ends <= len(part)], w)[: last - first]
                total[a + filled] += np.add.reduceat(self.table[h], starts[filled], axis=0)
                number[a + filled] += np.add.reduceat((h < BUCKETS).astype(np.int64), starts[filled])
        return self._softmax(total / np.maximum(number, 1)[:, None] / self.temperature)


def fit(docs: DataFrame, per_lang: int = 500, most: int = 2000, least: int = 8) -> Model | None:
    """A model from the rows of each language whose ids hash lowest, ``per_lang`` at most.

    If languages are many each has ``most`` divided by their number, but ``least`` at any rate, so none is
    lost: the sample has at most ``most`` rows, or ``least`` for each language if that is more. ``docs`` has
    ``doc_id``, ``text`` and ``lang``; rows without an id or language are left out.
    """
    known = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang")
    sizes = pin(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    per = min(per_lang, max(most // max(sizes.count(), 1), least))
    # The hash as a number from 0 to 1 against twice the share that is wanted, and some more; of those the lowest.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    picked = known.join(F.broadcast(sizes), "lang").withColumn("place", place).where(F.col("place") * F.col("n") < 2 * per + 50)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    picked = pin(picked.withColumn("rank", rank).where(F.col("rank") <= per).select("doc_id", "lang").distinct(), "sample")
    rows = with_sample(docs, picked.withColumnRenamed("lang", "_lang")).where("lang = _lang").select("doc_id", "lang", "text")
    found = rows.mapInArrow(_features, "doc_id long, lang string, at array<int>, share array<float>")
    bound = per * max(sizes.count(), 1)
    pdf = found.orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(bound).toPandas()
    if not len(pdf):
        return None
    return Model([np.asarray(x, np.int64) for x in pdf["at"]], [np.asarray(x, np.float32) for x in pdf["share"]], list(pdf["lang"]))


def _prepared(docs: DataFrame, lang: Column) -> DataFrame:
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.lower(docs["text"].cast("string")).alias("text"), lang.alias("lang"))


def identify(docs: DataFrame, folds: int = 5, **params) -> DataFrame:
    """Per row: ``doc_id, held_out, lang_pred, score, rejected``, learned outside the held-out fold.

    The fold held out is that of remainder 0. One bounded job for the model, one pass over the
    texts without a shuffle.
    """
    fold = fold_of(F.col("doc_id"), folds)
    rows = _prepared(docs, docs["lang"].cast("string"))
    model = fit(rows.where(fold != 0), **params)
    shown = rows.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            lang, score, rejected = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
            if model and n:
                p = model.predict(*utf8_of(batch.column("text")))
                best = p.max(1)
                lang = np.where(lettered, np.array(model.langs, object)[p.argmax(1)], "und")
                score = np.where(lettered, best, 0.0)
                rejected = ~lettered | (best < model.bound)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return shown.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
