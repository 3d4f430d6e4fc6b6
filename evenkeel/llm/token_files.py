"""Token ids as files: each document compressed on its own, with one dictionary for all.

``write_token_files`` encodes whole texts and writes, through Spark's own writer (so that the
files appear once, whatever tasks are repeated, on any file system it reaches):

``shards``      blocks of documents in ascending order of id: ids and token counts of the
                documents, ``offsets`` of their frames in ``payload``, the first token's place
                within its range ``part``, and the hash of the dictionary
``dictionary``  the zstandard dictionary, trained on serialized ids of a bounded sample
``ranges``      the first token's place of each range

A document is read by slicing its frame out of one block. Ids are little-endian, two bytes each
if the vocabulary allows it.

Defined cases: a null text is an empty one and holds the end id alone; null ids come first;
rows that repeat an id stand next to each other, ordered by text; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from evenkeel.llm.bpe import byte_letters
from evenkeel.llm.shared import batches_of, chosen_columns, give_back, grouped, per_process, sample_rows, with_sample

BLOCK_BYTES = 2 << 20
# Rows that go to a Python worker at once: Spark's default, 10,000, is a whole task's texts, in the JVM and in the worker.
BATCH_ROWS = 500
CACHED = 400_000
# Words that the tokenizer is given as one.
TOGETHER = 64
# A blank at the start or two next to each other, in Python's sense, which includes the tokenizer's.
_BLANK = "[" + "".join(rf"\x{{{i:x}}}" for i in range(1 << 16) if chr(i).isspace()) + "]"
_BLANKS = rf"\A{_BLANK}|{_BLANK}{_BLANK}"
_MARKS = ".,;:!?&#*$%"
# From here on versions of Unicode may differ on what a letter is; the tokenizer is asked.
_OTHER = "\u0530"


class CachedEncoder:
    """A tokenizer of the byte-level kind, asked once for each piece of text between blanks.

    Its splitting rule ends a token before every space that another sort of character follows,
    and before and after a lone line break, so the pieces between are encoded independently of
    their neighbours. A piece is kept under a key: what follows a space without that space, what
    follows a line break with it, anything else in a tuple.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[str | tuple[str], bytes] = {}
        self.latest: list[str | tuple[str]] = []
        # A break in front makes a text's first word like any other line's.
        self.broken = np.array(self.tokenizer.encode("\n", add_special_tokens=False).ids, self.dtype).tobytes()
        self.front = len(self.broken)
        self.model, self.code = self.tokenizer.model, "H" if self.dtype.itemsize == 2 else "I"
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        # The model alone, for words that are split already.
        self.bare = Tokenizer(self.model)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        # Where no token joins a letter to a space after it, words of letters that stand together are encoded apart.
        byte_of = {c: b for b, c in enumerate(letters)}
        inner = [t for t in vocabulary if "Ġ" in t[1:]]
        apart = all(bytes(byte_of.get(c, 0) for c in t).decode("utf-8", "replace").isspace() for t in inner)
        by_word = not isinstance(self.model, BPE) or self.model.ignore_merges or self.model.continuing_subword_prefix or self.model.end_of_word_suffix
        self.together = TOGETHER if apart and not by_word else 1

    @staticmethod
    def pieces(text: str) -> list[str | tuple[str]]:
        """Keys of a text with a line break put before it."""
        parts = text.split(" ")
        out = [parts[0]]
        for p in parts[1:]:
            # Joined again where no other character follows the space.
            if p and not p[0].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return ["\n", *(p[1:] if p[:1] == " " and p[1:2] != "\n" else (p,) for p in out)]

    @staticmethod
    def common(texts: pa.Array) -> pa.Array:
        """Keys of texts without blanks next to each other, a line break put before each: lists of them."""
        breaks = pc.replace_substring(texts, "\n", " \n")
        return pc.split_pattern(pc.binary_join_element_wise("\n", breaks, ""), " ")

    def _word(self, word: str) -> bytes:
        """Ids of letters alone, which the splitting rule keeps together."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _words(self, words: list[str]) -> None:
        """Put the ids of words of letters alone, each after a space, into the cache."""
        n = self.together
        for at in range(0, len(words), 64 * n):
            part = words[at : at + 64 * n]
            shown = [" " + " ".join(part[i : i + n]) for i in range(0, len(part), n)]
            shown = [x.replace(" ", "Ġ") if x.isascii() else x.encode().decode("latin-1").translate(self.letters) for x in shown]
            ids = np.array([i for e in self.bare.encode_batch_fast(shown, add_special_tokens=False) for i in e.ids], self.dtype)
            ends = (np.append(np.flatnonzero(self.opens[ids])[1:], len(ids)) * self.dtype.itemsize).tolist()
            if len(ends) != len(part):
                raise ValueError(f"{len(part)} words, of which the tokenizer makes {len(ends)}")
            data, start = ids.tobytes(), 0
            for k, end in zip(part, ends):
                self.cache[k] = data[start:end]
                start = end

    def _ask(self, keys: list[str | tuple[str]]) -> None:
        """Put what the tokenizer makes of any keys into the cache."""
        for at in range(0, len(keys), 20_000):
            part = keys[at : at + 20_000]
            words = [k[0] if type(k) is tuple else k if k[:1] == "\n" else " " + k for k in part]
            found = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
            owner = np.array(found.word_ids, np.int64)
            ends = np.cumsum(np.bincount(owner, minlength=len(part))).tolist()
            data, width, start = np.array(found.ids, self.dtype).tobytes(), self.dtype.itemsize, 0
            for k, end in zip(part, ends):
                self.cache[k] = data[start * width : end * width]
                start = end

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Serialized ids of each text; the words of a text that repeat become Python's once for all texts."""
        blanks = pc.match_substring_regex(texts, _BLANKS)
        lists = self.common(texts.filter(pc.invert(blanks)))
        words = lists.flatten().dictionary_encode()
        # As one text they are Python's sooner; they hold no space.
        together = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary)
        keys = pc.binary_join(together, " ")[0].as_py().split(" ") if len(words.dictionary) else []
        rare = [self.pieces(t) for t in texts.filter(blanks).to_pylist()]
        self.latest = [*keys, *set().union(*rare).difference(keys)] if rare else keys
        if len(self.cache) > CACHED:
            self.forget()
        self._learn()
        cache = self.cache
        joined = pa.array([cache[k] for k in keys], pa.large_binary()).take(words.indices)
        at = np.r_[0, np.cumsum(pc.binary_length(joined).to_numpy())]
        data, ends = memoryview(joined.buffers()[2] or b""), at[lists.offsets.to_numpy()].tolist()
        found = (bytes(data[i + self.front : j]) for i, j in zip(ends, ends[1:]))
        others = (b"".join([cache[k] for k in c])[self.front :] for c in rare)
        return [next(others if b else found) for b in blanks.to_pylist()]

    def _learn(self) -> None:
        """Put what the cache lacks of the latest keys into it."""
        cache = self.cache
        ascii_words, words, odd, marked = [], [], set(), []
        for k in [k for k in self.latest if k not in cache]:
            if type(k) is tuple:
                odd.add(k)
                continue
            if k.isalpha():
                if k.isascii():
                    ascii_words.append(k)
                    continue
                if max(k) < _OTHER:
                    words.append(k)
                    continue
            head = k.rstrip(_MARKS)
            word = head[1:] if head[:1] == "\n" else head
            if word.isalpha() and (word.isascii() or max(word) < _OTHER):
                if head not in cache:
                    if word is not head:
                        cache[head] = self.broken + self._word(word)
                    elif word.isascii():
                        ascii_words.append(word)
                    else:
                        words.append(word)
            # Marks after a letter are tokens of their own.
            elif len(head) < len(k) and head[-1:].isalpha() and "<|" not in k:
                odd.add(head)
            else:
                odd.add(k)
                continue
            if len(head) < len(k):
                marked.append(k)
        self._words(ascii_words)
        self._words(words)
        tails = {k[len(k.rstrip(_MARKS)) :] for k in marked}
        self._ask([k for k in {*odd, *((t,) for t in tails)} if k not in cache])
        ids_of = {t: cache[t,] for t in tails}
        for k in marked:
            head = k.rstrip(_MARKS)
            cache[k] = cache[head] + ids_of[k[len(head) :]]

    def forget(self) -> None:
        """Give up pieces that the last texts do not have."""
        self.cache = {k: self.cache[k] for k in self.latest if k in self.cache}


def _encoder(path: str) -> CachedEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return per_process(("encoder", path), lambda: CachedEncoder(path))


def train_dictionary(docs: DataFrame, tokenizer: str, docs_used: int = 1000, ids_used: int = 4096, size: int = 1 << 16) -> bytes:
    """A dictionary from at most ``docs_used`` documents and ``ids_used`` ids of each.

    It changes how small the frames are, never what they hold. Empty if there is no document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            found = encoder.encode(batch.column("text"))
            used = pa.array([x[: ids_used * encoder.dtype.itemsize] for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), used], names=["doc_id", "ids"])

    sample = sample_rows(docs.select("doc_id").where("doc_id IS NOT NULL"), docs_used)
    rows = with_sample(docs, sample.distinct()).mapInArrow(run, "doc_id long, ids binary")
    samples = [bytes(r["ids"]) for r in rows.orderBy(F.xxhash64("doc_id"), "ids").limit(docs_used).collect() if r["ids"]]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on
        return b"".join(samples)[:size] if sum(map(len, samples)) >= 8 else b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def dictionary_hash(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()


_SHARDS = (
    "part int, block int, first long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary, dictionary string"
)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of neighbouring rows, of about ``BLOCK_BYTES`` of text each time, whatever the size of batches."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.binary_length(batch.column("text")).to_pylist()
        for a, b in grouped(lengths, BLOCK_BYTES):
            held.append(batch.slice(a, b - a))
            size += sum(lengths[a:b])
            if size >= BLOCK_BYTES:
                yield tuple(pa.concat_arrays([x.column(c) for x in held]) for c in ("doc_id", "text"))
                held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays([x.column(c) for x in held]) for c in ("doc_id", "text"))


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, level: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """One shuffle, of the texts by range of id; they are encoded in order as they are written."""
    spark = docs.sparkSession
    docs = chosen_columns(docs, id_col, text_col)
    data = train_dictionary(docs, tokenizer)
    mark = dictionary_hash(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        pack = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(data)).compress
        part, block, first = TaskContext.get().partitionId(), 0, 0
        for doc_ids, texts in _filled(batches):
            found = [x + end for x in encoder.encode(texts)]
            frames = [pack(x) for x in found]
            counts = [len(x) // encoder.dtype.itemsize for x in found]
            offsets = np.cumsum([0, *map(len, frames)]).tolist()
            row = [[part], [block], [first], [doc_ids.to_pylist()], [counts], [offsets], [b"".join(frames)], [mark]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row, kinds)],
                names=["part", "block", "first", "doc_ids", "n_tokens", "offsets", "payload", "dictionary"],
            )
            block, first = block + 1, first + sum(counts)
        # The worker process may wait idle while other stages need its executor's memory.
        encoder.forget()
        give_back()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    with batches_of(spark, BATCH_ROWS):
        ordered.mapInArrow(run, _SHARDS).write.parquet(f"{path}/shards")
    one = spark.createDataFrame([(mark, data, np.dtype(CachedEncoder(tokenizer).dtype).itemsize)], "dictionary string, data binary, id_bytes int")
    one.coalesce(1).write.parquet(f"{path}/dictionary")
    # A row for each range, that is each task: their running sum is a small window.
    totals = spark.read.parquet(f"{path}/shards").groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals.select("part", F.coalesce(before, F.lit(0)).alias("base")).coalesce(1).write.parquet(f"{path}/ranges")


def _open(spark: SparkSession, path: str) -> tuple[str, bytes, np.dtype]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row["dictionary"], bytes(row["data"]), np.dtype("<u2" if row["id_bytes"] == 2 else "<u4")


def _blocks(spark: SparkSession, path: str, only: DataFrame | None) -> DataFrame:
    """Written blocks, each with the place ``start`` of its first token and the documents ``wanted`` of it (null: all)."""
    shards = spark.read.parquet(f"{path}/shards").join(spark.read.parquet(f"{path}/ranges"), "part")
    frames = shards.select(
        "dictionary", "payload", "doc_ids", "n_tokens", "offsets", (F.col("first") + F.col("base")).alias("start"),
        *([F.lit(None).cast("array<long>").alias("wanted")] if only is None else []),
    )
    if only is None:
        return frames
    held = frames.withColumn("block_id", F.struct("start", F.hash("doc_ids")))
    asked = held.select("block_id", F.explode("doc_ids").alias("doc_id")).join(only.select("doc_id").distinct(), "doc_id")
    return held.join(asked.groupBy("block_id").agg(F.collect_set("doc_id").alias("wanted")), "block_id").drop("block_id")


def _unpacked(batches: Iterator[pa.RecordBatch], mark: str, data: bytes, dtype: np.dtype) -> Iterator[tuple[list, list[int], Iterator[np.ndarray]]]:
    """Of each block the ids of its wanted documents, where they start, and their tokens, unpacked as they are asked for."""
    unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(data)).decompress
    for batch in batches:
        for i in range(batch.num_rows):
            (r,) = batch.slice(i, 1).to_pylist()
            if r["dictionary"] != mark:
                raise ValueError(f"block packed with dictionary {r['dictionary']}, not {mark}")
            places = np.cumsum([r["start"], *r["n_tokens"]]).tolist()
            wanted = None if r["wanted"] is None else set(r["wanted"])
            at = [i for i, d in enumerate(r["doc_ids"]) if wanted is None or d in wanted]
            o, p = r["offsets"], memoryview(r["payload"])
            tokens = (np.frombuffer(unpack(p[o[i] : o[i + 1]]), dtype) for i in at)
            yield [r["doc_ids"][i] for i in at], [places[i] for i in at], tokens


def read_token_files(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """``(doc_id, start, ids)``, ``start`` being the number of ids of all documents before.

    With ``only``, a table of ``doc_id``, just the frames of those documents are unpacked.
    """
    opened = _open(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, starts, tokens in _unpacked(batches, *opened):
            arrays = [x.astype(np.int32) for x in tokens]
            lengths = np.cumsum([0, *map(len, arrays)])
            values = pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32))
            ids = pa.LargeListArray.from_arrays(pa.array(lengths, pa.int64()), values).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), ids], names=["doc_id", "start", "ids"])

    return _blocks(spark, path, only).mapInArrow(run, "doc_id long, start long, ids array<int>")


_SUMS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _sums(doc_ids: list, starts: list[int], tokens: Iterator[np.ndarray]) -> pa.RecordBatch:
    found = [(len(x), zlib.crc32(x.astype("<u4"))) for x in tokens]
    columns = [doc_ids, starts, [n for n, _ in found], [crc for _, crc in found]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(rows: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of what was read back, crc32 over 4-byte ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, at = ids.flatten().to_numpy(), np.r_[0, np.cumsum(ids.value_lengths().to_numpy())].tolist()
            yield _sums(batch.column("doc_id").to_pylist(), batch.column("start").to_pylist(), (flat[a:b] for a, b in zip(at, at[1:])))

    return rows.mapInArrow(run, _SUMS)


def read_checksums(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """What :func:`checksums` tells of :func:`read_token_files`, in one pass and one process for each task.

    Ids of a document are unpacked one document at a time and do not leave the process.
    """
    opened = _open(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _unpacked(batches, *opened):
            yield _sums(*block)
        give_back()

    return _blocks(spark, path, only).mapInArrow(run, _SUMS)
