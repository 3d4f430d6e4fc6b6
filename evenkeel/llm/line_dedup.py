"""Line dedup: a line goes if an earlier one is equal or within one word of it.

A line is its words; the distance of two lines is the edit distance over words (one word put
in, left out or exchanged), bound 1. Lines of fewer than ``min_words`` words, which recur by
chance, stay. A line goes if there is a line within the bound that is earlier, by document and
place, whether or not that one stays itself.

* **Equal lines** meet in one aggregation, which keeps the earliest place of each line.
* **Deletion neighbourhood.** Each distinct line emits, as hashed keys, itself and every variant
  with one word left out. Equal keys join. Two lines with a word exchanged share the variant
  without that word at the same place; a line with a word more has the other among its variants.
  A key's earliest line is the only one that matters to the others, so a key of any size gives
  one candidate per line, never its pairs.
* **Verification.** The words of line and candidate are compared. Keys have 64 bits; should two
  different ones ever be equal, a line may be hidden from another, never taken for it.

A line can only have a neighbour if it shares its first or its last half (to the word) with
another, so before variants are made lines whose halves are nobody else's are put aside.

* **Short lines in context**, on request. A short line goes with its neighbour: if the nearest
  long line before or after it repeats an earlier one that has the same short line on the same side.
  A long line counts here as itself and as each earlier line found within its bound, so the short
  lines of a near copy meet those of the original too.

All of it is Columns and joins. Defined cases: null texts are empty and have no line; a null
id is earlier than all others; rows that repeat id and text are one document, and rows that
repeat an id with other text are told apart by their text; extra columns are kept, whatever their
names; a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.shared import within
from evenkeel.scratch import pin

MIN_WORDS = 8
_KEY = ["h1", "h2"]


def line_words(line: Column) -> Column:
    return F.array_remove(F.split(F.translate(line, "\t\v\f\r", "    "), " "), "")


def _hash_pair(*parts: Column) -> list[Column]:
    """128 bits, so that equal keys are equal sequences."""
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(0x5BD1E995), *parts).alias("h2")]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


def _lines(rows: DataFrame) -> DataFrame:
    exploded = rows.select("doc_id", "version", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return exploded.select("doc_id", "version", "line_no", line_words(F.col("line")).alias("words"))


def _place() -> Column:
    """Order of lines: nulls first, then id, place; the text's hash parts rows of one id."""
    return F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "line_no", "version")


def _half_keys() -> Column:
    """Hashes of a line's first and last words, by its own length and by one word less.

    Lines within the bound have lengths that differ by one at most and differ in one spot only,
    so one of the two halves that leave the spot out is equal, cut by the shorter length.
    """
    n, words = F.size("words"), F.col("words")
    halves = []
    for short in (0, 1):
        half = F.floor((n - 1 - short) / 2).cast("int")
        halves += [(F.lit(0), half, F.slice(words, 1, half)), (F.lit(1), half, F.slice(words, n - half + 1, half))]
    return F.array_distinct(F.array(*[F.xxhash64(side, half, part) for side, half, part in halves]))


def duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, version, line_no)`` of every line that goes; ``version`` is its text's hash."""
    return _found(_documents(docs, id_col, text_col), min_words)[0]


def _found(rows: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """The long lines that go, and ``(h1, h2, n1, n2)``: keys of lines and of an earlier one near each."""
    lines = _lines(rows).where(F.size("words") >= min_words)
    placed = pin(lines.select(*_hash_pair(F.col("words")), _place().alias("place"), _half_keys().alias("halves")), "lines")

    # Halves of two different lines at least; copies of one line do not count.
    by_half = placed.select(*_KEY, "place", F.explode("halves").alias("half"))
    shared = by_half.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half")
    close = by_half.join(within(pin(shared, "shared-halves"), 40), "half", "left_semi").groupBy(*_KEY).agg(F.min("place").alias("first"))
    # Ranges of first places in ascending order, so that a row's number is its place in that
    # order; written with it, as reading deals files out anew.
    ranged = close.repartitionByRange("first").sortWithinPartitions("first")
    close = pin(ranged.select(*_KEY, F.monotonically_increasing_id().alias("id"), "first.doc_id", "first.version", "first.line_no"), "close-lines")
    pairs = _shadowed(rows, close)
    near = pin(pairs.select(*_KEY, F.lit(True).alias("shadowed")).distinct(), "shadowed")

    # Only lines that occur again or have an earlier neighbour are looked at further.
    again = placed.groupBy(*_KEY).agg(F.min("place").alias("first"), F.count("*").alias("n")).join(within(near, 64), _KEY, "left")
    again = again.where("n > 1 OR shadowed").select(*_KEY, "first", F.coalesce("shadowed", F.lit(False)).alias("shadowed"))
    looked = placed.select(*_KEY, "place").join(within(pin(again, "repeated-lines"), 96), _KEY)
    return looked.where(F.col("shadowed") | (F.col("place") != F.col("first"))).select("place.doc_id", "place.version", "place.line_no"), pairs


def _in_context(rows: DataFrame, pairs: DataFrame, min_words: int) -> DataFrame:
    """``(doc_id, version, line_no)`` of short lines that go with a long neighbour."""
    spoken = _lines(rows).where(F.size("words") > 0)
    # Hashes alone are dealt out. A document's lines are as many as it has.
    lines = spoken.select("doc_id", "version", "line_no", (F.size("words") >= min_words).alias("long"), *_hash_pair(F.col("words")))
    own = F.when(F.col("long"), F.struct(*_KEY, "line_no"))
    order = Window.partitionBy("doc_id", "version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    around = lines.select(
        "*",
        F.last(own, ignorenulls=True).over(order.orderBy("line_no")).alias("before"),
        F.last(own, ignorenulls=True).over(order.orderBy(F.desc("line_no"))).alias("after"),
    ).where("NOT long")
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("long")) for k, c in enumerate(("before", "after"))])
    beside = around.select("doc_id", "version", "line_no", F.struct(*_KEY).alias("short"), F.explode(sides).alias("s")).where("s.long IS NOT NULL")
    beside = beside.select("doc_id", "version", "line_no", "short", "s.side", F.col("s.long.line_no").alias("at"), F.col("s.long.h1").alias("h1"), F.col("s.long.h2").alias("h2"))
    like = pairs.groupBy(*_KEY).agg(F.collect_set(F.struct(F.col("n1").alias("h1"), F.col("n2").alias("h2"))).alias("like"))
    like = within(pin(like, "near-lines"), 256)
    met = beside.join(like, _KEY, "left").withColumn("own", F.array(F.struct(*_KEY)))
    met = met.withColumn("to", F.explode(F.concat("own", F.coalesce("like", F.array().cast("array<struct<h1:bigint,h2:bigint>>")))))
    # The place of the long line counts: short lines beside one and the same do not repeat each other.
    long = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.col("at").alias("line_no"), "version").alias("place")
    keyed = met.select("doc_id", "version", "line_no", long, *[h.alias(f"k{i}") for i, h in enumerate(_hash_pair(F.col("short"), F.col("side"), F.col("to")))])
    keyed = pin(keyed, "short-lines")
    first = keyed.groupBy("k0", "k1").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last")
    again = keyed.join(within(pin(first.select("k0", "k1", "first"), "short-firsts"), 96), ["k0", "k1"])
    return again.where("place <> first").select("doc_id", "version", "line_no").distinct()


def _shadowed(rows: DataFrame, close: DataFrame) -> DataFrame:
    """``(h1, h2, n1, n2)`` of distinct lines with an earlier line within one word, and of such a line."""
    # Their words, from the place where each occurs first.
    named = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.version") == F.col(f"{b}.version"))
    wanted = within(pin(close.select("doc_id", "version").distinct(), "wanted-docs"), 56)
    texts = rows.alias("r").join(wanted.alias("d"), named("r", "d"), "left_semi")
    spoken, m = _lines(texts).alias("l"), within(close, 96).alias("m")
    found = spoken.join(m, named("l", "m") & (F.col("l.line_no") == F.col("m.line_no"))).select("m.id", "l.words")
    lines = pin(found.dropDuplicates(["id"]), "close-words")

    n, words = F.size("words"), F.col("words")
    left_out = lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.slice(w, 1, F.greatest(i - 1, F.lit(0))), F.slice(w, i + 1, F.greatest(F.size(w) - i, F.lit(0)))))
    spread = lines.select("id", "words", F.explode(F.sequence(F.lit(0), n)).alias("at"))
    variants = pin(spread.select("id", "at", F.xxhash64(left_out(words, F.col("at"))).alias("v")), "variants")

    # The earliest line of each key. A key of one line has nothing to say.
    by_place = variants.groupBy("v", "at").agg(F.min("id").alias("best"), F.max("id").alias("last"))
    by_place = pin(by_place, "variant-places")
    exchanged = by_place.where("at > 0 AND best < last").select("v", "at", "best")
    # A whole line against the variants of lines with one word more, and the other way round.
    cut = by_place.where("at > 0").groupBy("v").agg(F.min(F.struct("best", "at")).alias("cut"))
    across = cut.join(by_place.where("at = 0").select("v", F.col("best").alias("whole")), "v")
    same = variants.join(within(pin(exchanged, "exchanged"), 48), ["v", "at"]).where("best < id").select("id", "at", "best", F.col("at").alias("best_at"))
    moved = variants.join(within(pin(across, "across"), 64), "v")
    shorter = moved.where("at > 0 AND whole < id").select("id", "at", F.col("whole").alias("best"), F.lit(0).alias("best_at"))
    longer = moved.where("at = 0 AND cut.best < id").select("id", "at", F.col("cut.best").alias("best"), F.col("cut.at").alias("best_at"))
    pairs = same.unionByName(shorter).unionByName(longer).distinct()

    theirs = lines.select(F.col("id").alias("best"), F.col("words").alias("others"))
    checked = pairs.join(lines, "id").join(theirs, "best")
    equal = left_out(words, F.col("at")) == left_out(F.col("others"), F.col("best_at"))
    late = pin(checked.where(equal).select("id", "best").distinct(), "near-pairs")
    theirs = close.select(F.col("id").alias("best"), F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    return pin(close.join(late, "id").join(theirs, "best").select(*_KEY, "n1", "n2"), "near-keys")


def dedup_lines(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    context: bool = False,
    counts: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """All columns of ``docs``, the text without the lines that go, and how many lines it had and lost.

    The two numbers are named by ``counts``, and take the place of columns that have these names.
    Null texts stay null. With ``context`` short lines go with their long neighbours.
    """
    rows = _documents(docs, id_col, text_col)
    gone, pairs = _found(rows, min_words)
    if context:
        gone = gone.unionByName(_in_context(rows, pairs, min_words))
    lists = pin(gone.groupBy("doc_id", "version").agg(F.collect_set("line_no").alias("gone")), "gone-lines")
    # A document's own line numbers: as large as the document at most. Sized as they are written.
    size = lists.agg(F.coalesce(F.sum(F.size("gone") * 4 + 48), F.lit(0))).first()[0]
    lists = lists.select(F.col("doc_id").alias("_gone_id"), F.col("version").alias("_gone_version"), F.col("gone").alias("_gone"))
    lists = F.broadcast(lists) if size <= 24 << 20 else lists
    text = docs[text_col].cast("string")
    version = F.xxhash64(F.coalesce(text, F.lit("")))
    same = docs[id_col].cast("bigint").eqNullSafe(lists["_gone_id"]) & (version == lists["_gone_version"])
    joined = docs.join(lists, same, "left")
    numbers, lines = lists["_gone"], F.split(text, "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(numbers, i)), "\n")
    kept = F.when(numbers.isNull(), text).otherwise(left)
    out = [kept.alias(c) if c == text_col else docs[c] for c in docs.columns if c not in counts]
    return joined.select(*out, F.coalesce(F.size(lines), F.lit(0)).alias(counts[0]), F.coalesce(F.size(numbers), F.lit(0)).alias(counts[1]))


SQL = rf"""
WITH l AS (SELECT doc_id, line_no, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents)),
long AS (SELECT doc_id, line_no, w, array_to_string(w, ' ') AS s FROM l WHERE len(w) >= {MIN_WORDS}),
one AS (SELECT s, any_value(w) AS w, min((doc_id, line_no)) AS first FROM long GROUP BY s),
var AS (SELECT s, first, i, CASE WHEN i = 0 THEN s ELSE array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') END AS v
  FROM (SELECT s, w, first, unnest(range(0, len(w) + 1)) AS i FROM one)),
ex AS (SELECT v, i, min(first) AS best FROM var WHERE i > 0 GROUP BY ALL),
cut AS (SELECT v, min(first) AS best FROM var WHERE i > 0 GROUP BY v),
whole AS (SELECT v, min(first) AS best FROM var WHERE i = 0 GROUP BY v),
shadow AS (SELECT s FROM var JOIN ex USING (v, i) WHERE ex.best < first
  UNION SELECT s FROM var JOIN cut USING (v) WHERE i = 0 AND cut.best < first
  UNION SELECT s FROM var JOIN whole USING (v) WHERE i > 0 AND whole.best < first),
gone AS (SELECT doc_id, line_no FROM long JOIN one USING (s) WHERE (doc_id, line_no) <> first OR s IN (SELECT s FROM shadow)),
kept AS (SELECT d.doc_id, d.text, list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(coalesce(g.g, []), i - 1)) AS lines, coalesce(len(g.g), 0) AS n_removed
  FROM documents d LEFT JOIN (SELECT doc_id, list(DISTINCT line_no) AS g FROM gone GROUP BY doc_id) g USING (doc_id))
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, n_removed, CASE WHEN text IS NULL THEN NULL ELSE sha256(array_to_string(lines, chr(10))) END AS text_sha256 FROM kept
"""
