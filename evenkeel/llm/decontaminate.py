"""Benchmark decontamination: which documents hold which test items.

An item is its set of shingles (``width`` words in a row); a document holds it if it has at
least ``share`` of them. An item of fewer words is one shingle, of all its words, and is searched
among runs of as many words. Documents are long and items short, so the search is by containment:

* **Size partitions.** Items are put into classes by their number of shingles, doubling. A class
  whose largest item has ``n`` needs a MinHash sketch of the ``n - ceil(share * n) + 1`` lowest
  hashes: a document with the share wanted lacks fewer than that, so it has one of them. The
  sketch loses no item, and only a fifth of its shingles are looked up.
* **Search.** Every shingle hash of every document is looked up among all sketches.
* **Verification.** For the candidates found, whole shingles are compared, as text.

All of it is Columns and joins. Items are sent to the executors only below a bound on their
counted sketch; beyond it the lookup is a shuffled join.

Defined cases: words are runs of letters and digits, lower-cased; an item without words is never
found; null texts are empty; :func:`contaminated` names documents and items by their ids, so
rows without one are left out and rows that repeat one are one document (or item) with the shingles of all
of them, each row at its own width; :func:`without_contaminated` judges each row by its own text,
whatever its id; extra columns are ignored; a table without rows, or no items, give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.shared import chosen_columns, within
from evenkeel.scratch import pin

WORDS = r"[^\p{L}\p{N}]+"
WIDTH = 5
SHARE = 0.8


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORDS), lambda w: w != "")


def _spans(words: Column, width: int, make) -> Column:
    """``make`` of every run of ``width`` elements; an empty array if there are fewer."""
    last = F.greatest(F.size(words) - width + 1, F.lit(0))
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), make)).otherwise(F.array())


def shingle_hashes(hashes: Column, width: int) -> Column:
    """Of an array of word hashes, the hash of each run of ``width``."""
    return _spans(hashes, width, lambda i: F.xxhash64(*[F.element_at(hashes, i.cast("int") + k) for k in range(width)]))


def shingle_texts(words: Column, width: int) -> Column:
    return _spans(words, width, lambda i: F.array_join(F.slice(words, i.cast("int"), width), " "))


def hashed(rows: DataFrame, key: str, width: int) -> DataFrame:
    """``(key, h)``: a row for every shingle of every text."""
    words = rows.select(key, F.transform(word_list(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))
    return words.select(key, F.explode(shingle_hashes(F.col("words"), width)).alias("h"))


def spoken(rows: DataFrame, key: str, width: int) -> DataFrame:
    """``(key, shingle)``: the same with the words themselves. Texts are split once, as a column."""
    words = rows.select(key, word_list(F.col("text")).alias("words"))
    return words.select(key, F.explode(shingle_texts(F.col("words"), width)).alias("shingle"))


def sketches(items: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """``(item_id, h)``: of each item the lowest hashes that its size class asks for."""
    sets = hashed(items, "item_id", width).groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    size = F.size("hs")
    # The class of sizes 2^(k-1) < n <= 2^k; each item keeps the sketch of the class's largest.
    top = F.pow(F.lit(2), F.ceil(F.log2(size)))
    length = (top - F.ceil(top * share) + 1).cast("int")
    return sets.select("item_id", F.explode(F.slice("hs", 1, F.least(length, size))).alias("h"))


def contaminated(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item, containment)`` for every document that holds an item."""
    return _holding(chosen_columns(docs, id_col, text_col).where("doc_id IS NOT NULL"), items, width, share)


def _holding(docs: DataFrame, items: DataFrame, width: int, share: float) -> DataFrame:
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id IS NOT NULL")
    items = pin(items.withColumn("width", F.least(F.size(word_list(F.col("text"))), F.lit(width))).where("width > 0"), "items")
    # Items of fewer words than usual have few widths, each searched by itself.
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    found = [_holding_width(docs, items.where(F.col("width") == w).drop("width"), w, share) for w in widths or [width]]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    # An id may have rows of several widths.
    sums = out.groupBy("doc_id", "item_id").agg(F.sum("n_shared").alias("n_shared"), F.sum("n_item").alias("n_item")) if len(found) > 1 else out
    return sums.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


def _holding_width(docs: DataFrame, items: DataFrame, width: int, share: float) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item)`` of items that have ``width`` words or more."""
    sketch = pin(sketches(items, width, share), "sketches")
    found = hashed(docs, "doc_id", width).join(within(sketch, 48), "h")
    pairs = pin(found.select("doc_id", "item_id").distinct(), "candidates")
    # Whole shingles, as text, of the candidates alone.
    held = docs.join(within(pin(pairs.select("doc_id").distinct(), "candidate-ids"), 40), "doc_id")
    theirs = spoken(held, "doc_id", width)
    asked = spoken(items, "item_id", width).distinct()
    asked = pin(asked, "item-shingles")
    sizes = asked.groupBy("item_id").agg(F.count("*").alias("n_item"))
    shared = theirs.join(within(asked, 200), "shingle").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    rows = shared.join(pairs, ["doc_id", "item_id"], "left_semi").join(sizes, "item_id")
    enough = F.col("n_shared") * 1_000_000 >= F.col("n_item") * round(share * 1_000_000)
    return rows.where(enough).select("doc_id", "item_id", "n_shared", "n_item")


def without_contaminated(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows of ``docs`` whose text holds no item, all columns kept; ids do not matter here."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    # A text is known by its hash, under the name that documents have in the search.
    bad = _holding(docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text")), items, width, share)
    bad = within(pin(bad.select(F.col("doc_id").alias("_leaking")).distinct(), "contaminated"), 40)
    return docs.join(bad, F.xxhash64(text) == bad["_leaking"], "left_anti").select(docs.columns)


SQL = rf"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
ws AS (SELECT DISTINCT least(len(w), {WIDTH}) AS k FROM iw WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ws)),
ish AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM
  (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(len(w), {WIDTH}) AS k FROM iw WHERE len(w) > 0))),
n AS (SELECT item_id, count(*) AS n_item FROM ish GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN ish USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment
FROM m JOIN n USING (item_id) WHERE n_shared * 1000000 >= n_item * {round(SHARE * 1_000_000)}
"""
