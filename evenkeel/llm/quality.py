"""Quality rules: an isolation forest over rule statistics, its cut calibrated from labels.

Each document is described by statistics that rules of thumb use (symbols, repeated words and
lines, capitals, table bars, word lengths). Random trees split such rows until
rows stand alone; an unusual document stands alone after few splits. How few is too few is
read off labelled rows, so that at most ``max_false`` of the good ones are lost. On top stand
two fixed rules, too few words and too many repeated ones.

All labelled rows take part: each tree draws its rows from all good ones, as the method has it, the box is that
of all rows, and the cut is read off the scores of all. They stay in tables; what reaches the driver is the rows that
trees drew, or all good ones while they are no more than trees could draw, whatever the number of labels.

Defined cases: a null or blank text has no words and fails the fixed rule; a null id is scored
like any other; repeated rows are scored each; extra columns are ignored; without labels of
both kinds the forest rejects nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm.shared import BROADCAST_BYTES, SPACES, chosen_columns, give_back
from evenkeel.operators import shape
from evenkeel.scratch import pin

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbols", "bars", "marks", "capitals", "runs", "equal_lines", "repeats", "word_length"]

# Trees of a forest, and good rows that each is grown over. So many good rows in all may reach the driver.
TREES, TREE_ROWS = 100, 256
HELD_ROWS = TREES * TREE_ROWS


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """How many words lie in a window of ``width`` (a power of two) that occurs twice or more.

    Equal windows get equal numbers, doubling their width each round, so equality is exact.
    """
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    span = 1
    while span < width:
        pair = code[:-span] * (int(code.max()) + 1) + code[span:]
        _, code, counts = np.unique(pair, return_inverse=True, return_counts=True)
        span *= 2
        if len(counts) == len(code):
            return 0
    twice = np.flatnonzero(counts[code] > 1)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + width, -1)
    return int(np.count_nonzero(np.cumsum(change[:-1])))


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts of a text, and the forest's features."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(text) - int(sum(hist[ord(c)] for c in SPACES))
    symbols = int(sum(hist[ord(c)] for c in SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    lower, upper = int(hist[97:123].sum()), int(hist[65:91].sum())
    per = max(n, 1)
    features = [
        symbols / per,
        int(hist[ord("|")]) / per,
        int(hist[ord("!")] + hist[ord("?")]) / per,
        upper / max(lower + upper, 1),
        sum(a == b for a, b in zip(words, words[1:])) / per,
        dup / max(len(lines), 1),
        repeat / per,
        chars / per,
    ]
    return [n, chars, symbols, dup, repeat], features


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < 20) | (100 * n_repeat > 30 * n_words)


class Forest:
    """Isolation forest (Liu, Ting, Zhou 2008): ``trees`` trees over ``rows`` good rows each.

    Cuts are drawn over the box that a node covers, which at the root spans good and bad rows
    alike, so a tree also parts off the empty space around the good rows: what falls there
    stands alone after few splits, however many bad rows resemble each other. A leaf holds the
    depth at which it stands plus the mean further depth that its rows would need.
    """

    def __init__(
        self, good: np.ndarray, box: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, limit: int = 20, seed: int = 7,
        drawn: list[np.ndarray] | None = None,
    ):
        """``drawn`` has the numbers of each tree's rows, where ``good`` has only those; else they are drawn as trees grow."""
        rng = np.random.default_rng(seed)
        self.rows, self.limit = min(rows, len(good)), limit
        self.low, self.high = box.min(0), box.max(0)
        draw = lambda tree: rng.choice(len(good), self.rows, replace=False) if drawn is None else drawn[tree]
        self.trees = [self._grow(good[draw(tree)], rng) for tree in range(trees)]

    @staticmethod
    def draws(n: int, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> list[np.ndarray]:
        """The numbers of each tree's rows among ``n`` good ones, drawn before any is looked at."""
        rng = np.random.default_rng([seed, 1])
        return [rng.choice(n, min(rows, n), replace=False) for _ in range(trees)]

    @staticmethod
    def further(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else 1.0

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, depth = [], [], [], [], []
        wide = np.flatnonzero(self.high > self.low)

        def node(part: np.ndarray, low: np.ndarray, high: np.ndarray, at: int) -> int:
            me = len(feature)
            for column, value in ((feature, -1), (cut, 0.0), (left, me), (right, me), (depth, at + self.further(len(part)))):
                column.append(value)
            if len(part) > 1 and at < self.limit and len(wide):
                k = int(rng.choice(wide))
                c = float(rng.uniform(low[k], high[k]))
                below = part[:, k] <= c
                feature[me], cut[me] = k, c
                left[me] = node(part[below], low, np.where(np.arange(len(high)) == k, c, high), at + 1)
                right[me] = node(part[~below], np.where(np.arange(len(low)) == k, c, low), high, at + 1)
            return me

        node(x, self.low, self.high, 0)
        return tuple(np.asarray(c) for c in (feature, cut, left, right, depth))

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the higher, the fewer splits part a row from the good ones."""
        x = np.clip(x, self.low, self.high)
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for feature, cut, left, right, depth in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.limit):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[row, f] <= cut[at], left[at], right[at]))
            total += depth[at]
        return 2.0 ** (-total / len(self.trees) / self.limit)


def calibrated(scores: DataFrame, max_false: float) -> float:
    """The lowest cut that loses at most ``max_false`` of the good rows and lies between two rows, from ``(good, score)``.

    Good rows are ranked by their distinct scores, so equal ones do not gather in one task.
    """
    good, bad = scores.where("good"), scores.where("NOT good")
    n = good.count()
    if not n or bad.isEmpty():
        return np.inf
    place = min(int(max_false * n), n - 1)
    counted = good.groupBy("score").agg(F.count("*").alias("rows")).withColumn("least", -F.col("score"))
    ranked = shape.running_offset(counted, ["least"], {"before": F.col("rows")})
    cut = ranked.where((F.col("before") <= place) & (F.col("before") + F.col("rows") > place)).first()["score"]
    above = bad.where(F.col("score") > cut).agg(F.min("score")).first()[0]
    return np.inf if above is None else (cut + above) / 2


_STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def described(docs: DataFrame) -> DataFrame:
    """Id, base counts, ``base_failed`` and features of ``(doc_id, text)``: the one pass over texts that Python makes."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            base, failed, x = _found(batch.column("text").to_pylist())
            cols = [batch.column("doc_id"), *map(pa.array, base.T), pa.array(failed), *map(pa.array, x.T)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *BASE, "base_failed", *FEATURES])
        give_back()

    schema = f"{_STATS}, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select("doc_id", "text").mapInArrow(describe, schema)


def _found(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, whether the fixed rules fail, and features."""
    found = [statistics(t or "") for t in texts]
    base, x = np.asarray([f[0] for f in found], np.int64), np.asarray([f[1] for f in found])
    return base, base_failed(base[:, 0], base[:, 4]), x


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy() for f in FEATURES])


def _known(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", F.col("label").cast("int"))


def fit(found: DataFrame, labels: DataFrame, max_false: float = 0.0005) -> tuple[Forest | None, float]:
    """Forest and cut, from all labelled rows of a written table of :func:`described`.

    Rows that fail the fixed rules are left out, as their verdict stands. ``labels`` has ``doc_id`` and ``label``, true for good rows.
    Good rows are numbered in the order of their hashed ids, so trees draw the same ones on every run.
    """
    given = found.where("NOT base_failed").join(_known(labels), "doc_id")
    rows = pin(given.select("doc_id", "label", (F.col("label") > 0).alias("good"), *FEATURES), "labelled")
    corners = [f(c) for f in (F.min, F.max) for c in FEATURES]
    n, *box = rows.agg(F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)), *corners).first()
    if not n:
        return None, np.inf
    order = ["hashed", "doc_id", "label", *FEATURES]
    numbered = shape.dense_seq(rows.where("good").withColumn("hashed", F.xxhash64("doc_id")).select(*order), order)
    drawn = None
    if n > HELD_ROWS:
        draws = Forest.draws(n)
        places = np.unique(np.concatenate(draws))
        wanted = rows.sparkSession.createDataFrame([(p,) for p in places.tolist()], "seq long")
        numbered, drawn = numbered.join(F.broadcast(wanted), "seq"), [np.searchsorted(places, at) for at in draws]
    good = numbered.orderBy("seq").select(*FEATURES).toPandas().to_numpy()
    forest = Forest(good, np.asarray(box, np.float64).reshape(2, -1), drawn=drawn)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(forest.score(_features(batch)))], names=["good", "score"])

    return forest, calibrated(pin(rows.mapInArrow(scored, "good boolean, score double"), "scores"), max_false)


def _judged(forest: Forest | None, cut: float, failed: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anomaly, and the verdict."""
    odd = forest.score(x) if forest else np.zeros(len(x))
    return odd, ~failed & (odd < cut)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """Per document: id, base counts, ``base_failed``, ``anomaly`` (0 to 1) and ``kept``.

    One pass over the texts without a shuffle; its numbers are written, and the model and the verdicts come from them.
    """
    found = pin(described(chosen_columns(docs, id_col, text_col)), "described")
    forest, cut = fit(found, labels, **params)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            odd, kept = _judged(forest, cut, failed, _features(batch))
            names = ["doc_id", *BASE, "base_failed"]
            cols = [*map(batch.column, names), pa.array(odd), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "anomaly", "kept"])
        give_back()

    return found.mapInArrow(judge, f"{_STATS}, anomaly double, kept boolean")


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a label where their ids are few enough to send, else all: texts do not shuffle."""
    ids = pin(_known(labels).select("doc_id").distinct(), "ids")
    return docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() * 16 <= BROADCAST_BYTES else docs


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, all their columns, in a pass of their own."""
    found = pin(described(_labelled(chosen_columns(docs, id_col, text_col), labels)), "described")
    forest, cut = fit(found, labels, **params)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, failed, x = _found(batch.column(text_col).to_pylist())
                yield batch.filter(pa.array(_judged(forest, cut, failed, x)[1]))
        give_back()

    return docs.mapInArrow(keep, docs.schema)


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
