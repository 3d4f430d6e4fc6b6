"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

Labels are known for documents only. A sentence's probability comes from a logistic model over
its words, hashed whole and by their first letters; a document's is the noisy-or of its
sentences, ``1 - prod(1 - p)``. The likelihood of the document labels is maximised by gradient
steps in numpy on a bounded sample, which leaves the weight on the sentences that explain them.
On rows set aside a logistic curve then maps the noisy-or to the score.

Defined cases: a null or empty text has no sentence and gets the score of a noisy-or of zero; a
null id belongs to no fold and is not learned from; repeated rows are scored each; extra columns
are ignored; without labels of both kinds every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.shared import chosen_columns, fold_of, grouped_by_size, sample_rows, with_sample

BUCKETS = 1 << 18
PREFIXES = (4, 6)
BLOCK_CHARS = 2 << 20
# Classes of bytes: 1 in a word, 2 ends a sentence, 0 other.
_CLASS = np.array([1 if 97 <= b <= 122 or b >= 128 or b == 39 else 2 if b in b".!?\n" else 0 for b in range(256)], np.uint8)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(46)).astype(np.int64)


def sentence_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: features (one row for each word), the sentence of each word counted
    from 0, the text of each sentence, and where the sentences' first words start in the block."""
    data = np.frombuffer("\n".join([*texts, ""]).encode("utf-8", "surrogatepass"), np.uint8)
    kind = _CLASS[data]
    word = kind == 1
    edge = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(PREFIXES)), np.int64), empty, empty, empty
    letters = data[word].astype(np.uint64)
    first = np.r_[0, np.cumsum(lengths)[:-1]]
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), 0x100000001B3, np.uint64)
    powers[0] = 1
    terms = letters * np.cumprod(powers)[place]
    features = [_mix(np.add.reduceat(terms, first), 0)]
    for size in PREFIXES:
        head = _mix(np.add.reduceat(np.where(place < size, terms, np.uint64(0)), first), size)
        features.append(np.where(lengths >= size, head, features[0]))
    sentence = np.cumsum(kind == 2)[starts]
    number, begin, inverse = np.unique(sentence, return_index=True, return_inverse=True)
    # A text ends with its own line end; count line ends of texts before each sentence.
    ends = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])
    return np.stack(features, 1), inverse, np.searchsorted(ends, starts[begin], "right"), starts[begin]


class Model:
    """Sentence weights and the curve from noisy-or to score."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, int]], y: np.ndarray, steps: int = 150, rate: float = 0.3, l1: float = 1e-4, min_df: int = 3, seed: int = 5):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, train = order[: len(y) // 4], order[len(y) // 4 :]
        self.weights, self.bias = np.zeros(BUCKETS), -5.0
        features, sentence, owner = self._stack([parts[i] for i in train])
        toxic = y[train] > 0
        balance = np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1)) * len(toxic)
        # Only features of several documents can be told from chance, and only upwards: a word
        # is evidence of toxicity or none, so clean sentences all have the bias's probability.
        used, column = np.unique(features, return_inverse=True)
        column = column.reshape(features.shape).astype(np.int32)
        once = np.unique(np.repeat(owner[sentence], features.shape[1]) * np.int64(len(used)) + column.ravel())
        open_ = np.bincount(once % max(len(used), 1), minlength=len(used)) >= min_df
        del once, features
        w, flat, wide = np.zeros(len(used)), column.ravel(), column.shape[1]
        m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
        for t in range(1, steps + 1):
            z = np.bincount(sentence, w[column].sum(1), minlength=len(owner)) + self.bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 12)))
            none = np.bincount(owner, np.log1p(-p), minlength=len(toxic))
            odds = np.exp(none) / np.maximum(-np.expm1(none), 1e-9)
            slope = np.where(toxic[owner], -p * odds[owner], p) * balance[owner] / len(toxic)
            g = np.where(open_, np.bincount(flat, np.repeat(slope[sentence], wide), minlength=len(used)) + l1, 0.0)
            gb = slope.sum()
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            scale = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
            w = np.maximum(w - scale * m / (np.sqrt(v) + 1e-5), 0.0)
            self.bias -= 0.3 * scale * mb / (np.sqrt(vb) + 1e-5)
        self.weights[used] = w
        self.slope, self.shift = 1.0, 0.0
        truth = y[held] > 0
        if truth.any() and not truth.all():
            features, sentence, owner = self._stack([parts[i] for i in held])
            p = self._sentences(features, sentence, len(owner))
            self._curve(np.bincount(owner, np.log1p(-p), minlength=len(held)), truth)

    @staticmethod
    def _stack(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = [n for _, _, n in parts]
        before = np.r_[0, np.cumsum(counts)[:-1]]
        return (
            np.concatenate([f for f, _, _ in parts]),
            np.concatenate([s + np.int32(b) for (_, s, _), b in zip(parts, before)]),
            np.repeat(np.arange(len(parts)), counts),
        )

    def _sentences(self, features: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(sentence, self.weights[features].sum(1), minlength=n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 12)))

    def _curve(self, none: np.ndarray, truth: np.ndarray) -> None:
        """Logistic regression of the truth on the log odds of the noisy-or, by Newton steps."""
        x = self._log_odds(none)
        a, b = 1.0, 0.0
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = q * (1 - q) + 1e-4
            ga, gb = ((q - truth) * x).sum() + 0.1 * (a - 1), (q - truth).sum() + 0.1 * b
            haa, hab, hbb = (w * x * x).sum() + 0.1, (w * x).sum(), w.sum() + 0.1
            det = haa * hbb - hab * hab
            a, b = a - 0.7 * (hbb * ga - hab * gb) / det, b - 0.7 * (haa * gb - hab * ga) / det
        if np.isfinite(a) and a > 0:
            self.slope, self.shift = float(a), float(b)

    @staticmethod
    def _log_odds(none: np.ndarray) -> np.ndarray:
        return np.clip(np.log(np.maximum(-np.expm1(none), 1e-12)) - none, -25, 25)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of texts; the most toxic sentence's place (byte in its text, -1 without one) and probability."""
        features, sentence, owner, begin = sentence_words(texts)
        p = self._sentences(features, sentence, len(owner)) if len(owner) else np.zeros(0)
        none = np.bincount(owner, np.log1p(-p), minlength=len(texts)) if len(owner) else np.zeros(len(texts))
        worst, at = np.zeros(len(texts)), np.full(len(texts), -1)
        if len(owner):
            np.maximum.at(worst, owner, p)
            base = np.r_[0, np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])]
            hit = np.flatnonzero(p == worst[owner])[::-1]
            at[owner[hit]] = begin[hit] - base[owner[hit]]
        x = self._log_odds(np.minimum(none, -1e-12))
        return 1 / (1 + np.exp(-(self.slope * x + self.shift))), at, worst


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [sentence_words([t or ""]) for t in batch.column("text").to_pylist()]
        cols = [[r[0].ravel().astype(np.int32) for r in rows], [r[1].astype(np.int32) for r in rows]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), *(pa.array(c, pa.list_(pa.int32())) for c in cols), pa.array([len(r[2]) for r in rows], pa.int32())],
            names=["doc_id", "label", "features", "sentence", "n"],
        )


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1200) -> Model | None:
    """A model from at most ``per_label`` rows of each label, those whose id hashes lowest."""
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", (F.col("label").cast("int") > 0).cast("int").alias("label"))
    kinds = [sample_rows(known.where(F.col("label") == k), per_label) for k in (0, 1)]
    rows = with_sample(docs, kinds[0].union(kinds[1]).distinct())
    found = rows.mapInArrow(_features, "doc_id long, label int, features array<int>, sentence array<int>, n int")
    pdf = found.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(2 * per_label).toPandas()
    if pdf["label"].nunique() < 2:
        return None
    wide = 1 + len(PREFIXES)
    parts = [(np.asarray(f, np.int32).reshape(-1, wide), np.asarray(s, np.int32), n) for f, s, n in zip(pdf["features"], pdf["sentence"], pdf["n"])]
    return Model(parts, pdf["label"].to_numpy())


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, bound: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``, the worst sentence's ``sentence_byte`` (place in
    the lower-cased text) and ``sentence_score``. ``labels`` has ``doc_id`` and ``label``; rows of
    remainder ``held`` are not learned from. A bounded job for the model, one pass over the texts."""
    docs = chosen_columns(docs, id_col, text_col).withColumn("text", F.lower("text"))
    model = fit(docs, labels.where(fold_of(F.col("doc_id"), folds) != held), **params)
    shown = docs.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in grouped_by_size(texts, BLOCK_CHARS):
                if model:
                    score, at, worst = model.score(texts[a:b])
                else:
                    score, at, worst = np.zeros(b - a), np.full(b - a, -1), np.zeros(b - a)
                cols = [pa.array(score), pa.array((score >= bound).astype(np.int32)), pa.array(at.astype(np.int64)), pa.array(worst)]
                ids = [batch.column(c).slice(a, b - a) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*ids, *cols], names=["doc_id", "held_out", "score", "predicted", "sentence_byte", "sentence_score"])

    return shown.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, sentence_byte long, sentence_score double")
