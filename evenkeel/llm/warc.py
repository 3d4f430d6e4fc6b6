"""WARC archives: written with revisits for equal payloads, read by verifying chains of records.

**Writing.** A record is one line of Spark's text writer whose line end is the blank line that
ends a WARC record, so files are plain WARC on any file system and appear once. Of equal
payloads that of the least id is a ``response``; the others are ``revisit`` records without a
block, which name it. A record id is made of page id and payload digest, so pages that repeat an id have
different ones; rows equal in both are equal records.

**Reading.** The archives are split as Spark splits text, at every occurrence of the version
line. Each occurrence is only a candidate: payloads may hold the same bytes. A task parses each
candidate's header, whose length names the successor. Within a split successors form trees,
which are numbered so that "on the way from here" is an interval test; across splits, pointers
to where a way leaves its split are jumped in doubling steps from the start of each file. What
is not reached is no record.

Defined cases: a null payload is an empty one; rows with the least id among equal payloads are
responses all, if ids repeat; a null id sorts before all others; an empty table gives empty
archives; extra columns are ignored; bytes after a broken header are not read as records.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.llm.shared import within
from evenkeel.scratch import pin

MAGIC = b"WARC/1.1\r\n"
GAP = b"\r\n\r\n"
# Fixed value: the profile of revisits whose payload is the same.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Where payloads of several pieces are gathered, file ranges are matched in bins of so many bytes.
BIN = 1 << 20


def base32(digits: Column) -> Column:
    """Upper-case base 32 of 40 hex digits: five of them become four."""
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    # Spark writes 0-9A-V, the digests' alphabet is A-Z2-7.
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``page_id, payload, digest, refers_to``; ``refers_to`` is null for responses."""
    rows = pages.select(
        pages[id_col].cast("bigint").alias("page_id"),
        F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("payload"),
        (pages["url"].cast("string") if "url" in pages.columns else F.lit("")).alias("url"),
    )
    rows = rows.withColumn("digest", base32(F.sha1("payload")))
    long = rows.where(F.octet_length("payload") >= least_bytes)
    # Only payloads that occur more than once are needed, each as one small row.
    order = F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id").alias("id"))
    first = long.groupBy("digest").agg(F.min(order).alias("o"), F.count("*").alias("n")).where("n > 1")
    first = pin(first.select("digest", F.col("o.id").alias("first")), "first-pages").withColumn("copied", F.lit(True))
    joined = rows.join(within(first, 80), "digest", "left")
    again = F.coalesce("copied", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= least_bytes)
    return joined.select("page_id", "url", "payload", "digest", again.alias("again"), F.when(again, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, date: str | None = None, **params) -> None:
    """Write archives; ``date`` (UTC, ``2024-01-31T12:00:00Z``) stands in every record, the time of writing unless given."""
    rows = with_revisits(pages, **params)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    # A revisit has another page id than its response, so page id and digest tell records apart.
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(">"))
    body = F.when(F.col("again"), "").otherwise(F.col("payload"))
    head = F.concat_ws(
        "\r\n",
        F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), named("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("again"), F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), named("refers_to"))),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    )
    rows.select(F.concat(head, F.lit("\r\n\r\n"), body).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


_FIELD = {k: re.compile(rb"(?:^|\r\n)" + k.encode() + rb":[ \t]*([^\r\n]*)", re.I) for k in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Payload-Digest", "Content-Length")}


def parse(line: bytes) -> tuple[dict[str, str], int, int] | None:
    """Fields of a header, where the block starts after it, and the block's length; null if it is none."""
    end = line.find(GAP)
    if end < 0:
        return None
    found = {k: m.group(1).decode("utf-8", "replace").strip() for k, r in _FIELD.items() if (m := r.search(line, 0, end))}
    length = found.get("Content-Length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 16):
        return None
    return found, end + len(GAP), int(length)


_CANDIDATES = (
    "file string, split long, at long, size long, candidate boolean, succ long, leaves long, tin int, tout int, "
    "kind string, id string, refers string, digest string, length long, sha1 binary"
)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list]]:
    """Lines of each split in order, reduced to what is kept of them: place, size and header."""
    now, rows, at = None, [], 0
    for batch in batches:
        for file, split, line in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("value")):
            if (file, split) != now:
                if now:
                    yield (*now, rows)
                now, rows, at = (file, split), [], 0
            data = line.as_py() or b""
            candidate = split > 0 or bool(rows)
            head = parse(data) if candidate else None
            whole = None
            if head and head[1] + head[2] + len(GAP) == len(data):
                whole = hashlib.sha1(memoryview(data)[head[1] : head[1] + head[2]]).digest()
            rows.append((at, len(data), candidate, head, whole))
            at += len(data) + len(MAGIC)
    if now:
        yield (*now, rows)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, split, rows in _splits(batches):
        place = {r[0] - len(MAGIC): i for i, r in enumerate(rows) if r[2]}
        n = len(rows)
        succ: list[int | None] = [r[0] + r[3][1] + r[3][2] + len(GAP) if r[3] else None for r in rows]
        parent = [place.get(s, -1) if s is not None else -1 for s in succ]
        under, leaves = [1] * n, list(succ)
        for i in range(n):  # a successor lies after its record, so children come first
            if parent[i] >= 0:
                under[parent[i]] += under[i]
        tin, free, top = [0] * n, [0] * n, 0
        for i in reversed(range(n)):
            p = parent[i]
            if p >= 0:
                leaves[i] = leaves[p]
                tin[i], free[p] = free[p], free[p] + under[i]
            else:
                tin[i], top = top, top + under[i]
            free[i] = tin[i] + 1
        field = lambda name: [r[3][0].get(name) if r[3] else None for r in rows]
        columns = [
            [file] * n, [split] * n, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], succ, leaves, tin,
            [a + b for a, b in zip(tin, under)], field("WARC-Type"), field("WARC-Record-ID"), field("WARC-Refers-To"),
            field("WARC-Payload-Digest"), [r[3][2] if r[3] else None for r in rows], [r[4] for r in rows],
        ]
        i32, i64, s = pa.int32(), pa.int64(), pa.string()
        kinds = [s, i64, i64, i64, pa.bool_(), i64, i64, i32, i32, s, s, s, s, i64, pa.binary()]
        names = [c.split()[0] for c in _CANDIDATES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value")
    )


def candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Every occurrence of the version line with its place in its file, and each split's base."""
    found = pin(_lines(spark, path).mapInArrow(_chains, _CANDIDATES), "candidates")
    ends = found.groupBy("file", "split").agg(F.max(F.col("at") + F.col("size") + len(MAGIC)).alias("bytes"))
    order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = pin(ends.select("file", "split", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("base")), "bases")
    placed = found.join(within(bases, 160), ["file", "split"])
    places = {c: (F.col(c) + F.col("base")).alias(c) for c in ("succ", "leaves")}
    begin = (F.col("at") + F.col("base") - len(MAGIC)).alias("begin")
    return placed.where("candidate AND succ IS NOT NULL").select(begin, *[places.get(c, F.col(c)) for c in found.columns if c != "at"]), bases


def reachable(nodes: DataFrame) -> DataFrame:
    """The rows of :func:`candidates` that a chain from the start of their file reaches."""
    nodes = pin(nodes, "nodes")
    ends = nodes.select("file", F.col("leaves").alias("begin")).distinct()
    doors = nodes.join(ends, ["file", "begin"], "left_semi").unionByName(nodes.where("begin = 0")).distinct()
    state = pin(doors.select("file", "split", "begin", "tin", F.col("leaves").alias("jump"), (F.col("begin") == 0).alias("reached")), "doors")
    before = -1
    while (now := state.where("reached").count()) != before:
        before = now
        hit = state.where("reached").select("file", F.col("jump").alias("begin")).distinct().withColumn("hit", F.lit(True))
        ahead = state.select("file", F.col("begin").alias("jump"), F.col("jump").alias("next"))
        step = state.join(hit, ["file", "begin"], "left").join(ahead, ["file", "jump"], "left")
        state = pin(step.select("file", "split", "begin", "tin", F.col("next").alias("jump"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")), "doors")
    # A way enters a split once; within it, what lies on the way has the door in its interval.
    door = state.where("reached").select("file", "split", F.col("tin").alias("door"))
    return nodes.join(within(pin(door, "entries"), 160), ["file", "split"]).where("tin <= door AND door < tout").drop("door")


def _assembled(spark: SparkSession, path: str, records: DataFrame, bases: DataFrame) -> DataFrame:
    """``(file, begin, sha1)`` for records whose payload holds the version line itself."""
    magic = F.lit(MAGIC)
    raw = _lines(spark, path).mapInArrow(_numbered, "file string, split long, at long, value binary")
    pieces = raw.join(within(bases, 160), ["file", "split"]).select("file", (F.col("at") + F.col("base") - len(MAGIC)).alias("place"), F.concat(magic, "value").alias("piece"))
    wide = records.select("file", "begin", "succ", F.explode(F.sequence(F.expr(f"begin div {BIN}"), F.expr(f"succ div {BIN}"))).alias("bin"))
    parts = pieces.withColumn("bin", F.expr(f"place div {BIN}")).join(within(pin(wide, "bins"), 180), ["file", "bin"]).where("place >= begin AND place < succ")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(pdf.sort_values("place")["piece"])[len(MAGIC) :]
        _, start, length = parse(data)
        return pd.DataFrame({"file": pdf["file"][:1], "begin": pdf["begin"][:1], "sha1": [hashlib.sha1(data[start : start + length]).digest()]})

    return parts.groupBy("file", "begin").applyInPandas(whole, "file string, begin long, sha1 binary")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, at = None, 0
    for batch in batches:
        places = []
        for file, split, line in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("value")):
            if (file, split) != now:
                now, at = (file, split), 0
            places.append(at)
            at += len(line.as_buffer() or b"") + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("split"), pa.array(places, pa.int64()), batch.column("value")], names=["file", "split", "at", "value"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per record: ``file, begin, page_id, payload_bytes, payload_digest, record_type, refers_to, intact``.

    Bytes and digest of a revisit are those of its response. ``intact`` tells whether the stored
    digest is that of the bytes found.
    """
    nodes, bases = candidates(spark, path)
    records = pin(reachable(nodes), "records")
    broken = records.where("sha1 IS NULL")
    if broken.take(1):
        found = pin(_assembled(spark, path, broken, bases), "assembled")
        records = records.join(within(found.withColumnRenamed("sha1", "whole"), 200), ["file", "begin"], "left").withColumn("sha1", F.coalesce("sha1", "whole"))
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)[:>]", 1)
    rows = records.select(
        "file", "begin", F.when(number("id") != "", number("id").cast("bigint")).alias("page_id"), F.col("kind").alias("record_type"),
        F.when(number("refers") != "", number("refers").cast("bigint")).alias("refers_to"),
        F.regexp_replace("digest", "^sha1:", "").alias("stored"), "length", base32(F.hex("sha1")).alias("found"),
    )
    # Responses by digest, one row each; a payload with very many revisits is a skewed join key.
    full = rows.where("record_type = 'response'").groupBy(F.col("found").alias("stored")).agg(F.max("length").alias("full"))
    joined = rows.join(full, "stored", "left")
    again = F.col("record_type") == "revisit"
    return joined.select(
        "file", "begin", "page_id", F.when(again, F.col("full")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(again, F.col("stored")).otherwise(F.col("found")).alias("payload_digest"), "record_type", "refers_to",
        (again & F.col("full").isNotNull() | (F.col("stored") == F.col("found"))).alias("intact"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, html, hex, list_aggregate([lpad_5 FOR lpad_5 IN list_transform(range(0, 8),
    lambda g: list_aggregate(list_transform(range(0, 4), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hex, 1 + 5 * g, 5))::BIGINT // (32768 // (1 << (5 * k)))) % 32 + 1)::BIGINT, 1)), 'string_agg', ''))], 'string_agg', '') AS payload_digest FROM p),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, strlen(html) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d JOIN f USING (hex)
"""
