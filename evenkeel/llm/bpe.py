"""Byte-pair encoding by a trie of distinct words, and decoding.

The distinct words of a block of texts are walked in sorted order, which is a depth-first walk
of their trie: the path from the root is a stack, and a word keeps the part of it that it
shares with the word before. A node's state is the last token of the encoding of its path. It
is found among the tokens that end at the node: exactly one of them stands next to the last
token before it without a merge across the border. So a prefix that words share is encoded
once, and a word's ids are read back along the states.

Defined cases: a null text is an empty one and has no ids; null and repeated ids are rows like
any other; extra columns are ignored; a table without rows gives none.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evenkeel.llm.shared import chosen_columns, give_back, grouped_by_size, per_process

# What a worker holds at once: a block of texts, pieces of texts with their ids, pairs of tokens.
BLOCK_CHARS = 2 << 20
CACHED = 250_000
CACHED_PAIRS = 1 << 19
# Rows of an Arrow batch that become Python texts at once.
SOME_ROWS = 500
END = "</w>"
# The tokenizer file's splitting pattern; it must equal the file's.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class TrieEncoder:
    """Encoder for a vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, path: str, cached: int = CACHED):
        self.cached = cached
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = _tokens(path)
        size = len(self.tokens)
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault(x << 20 | y, r)
            if self.born[z] < 0:
                self.left[z], self.right[z], self.born[z] = x, y, r
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.beside: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.letters = byte_letters()
        self.path = path
        self.is_special = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")
        self.pieces: dict[str, bytes] = {"": b""}
        self.told: dict[str, tuple[int, str, str]] = {"": (0, "", "")}
        self.words: dict[str, list[int]] = {}

    @cached_property
    def library(self) -> Tokenizer:
        """The tokenizer itself; few texts ask for it."""
        return Tokenizer.from_file(self.path)

    def stays_apart(self, x: int, y: int, until: int | None = None) -> bool:
        """Whether no merge crosses the border of ``x`` and ``y`` (before merge ``until``).

        Backwards in time, the token next to the border that was formed last is taken apart; at
        each step the two at the border existed together until the earlier of them was used up.
        A merge of those two within that time would have come first. On equal rank the one
        further left comes first.
        """
        used_x = used_y = 1 << 40 if until is None else until
        first = until is not None
        while True:
            m = self.rank.get(x << 20 | y)
            if m is not None and m < used_x and m <= used_y and not (first and m == until):
                return False
            first = False
            if self.born[x] > self.born[y]:
                used_x, x = self.born[x], self.right[x]
            elif self.born[y] >= 0:
                used_y, y = self.born[y], self.left[y]
            else:
                return True

    def is_whole(self, t: int) -> bool:
        """Whether the token's own letters are encoded as this one token."""
        got = self.whole.get(t)
        if got is None:
            x, y, r = self.left[t], self.right[t], self.born[t]
            got = self.whole[t] = r < 0 or (self.is_whole(x) and self.is_whole(y) and self.stays_apart(x, y, r))
        return got

    def _last(self, text: str, end: int, mark: str, state: list[int]) -> int:
        """The last token of the encoding of ``text[:end]``, given those of shorter prefixes."""
        vocab, beside = self.vocab, self.beside
        for size in range(1, min(end, self.longest) + 1):
            t = vocab.get(text[end - size : end] + mark)
            if t is None:
                continue
            if size == end:
                if self.is_whole(t):
                    return t
                continue
            key = state[end - size] << 20 | t
            ok = beside.get(key)
            if ok is None:
                ok = beside[key] = self.is_whole(t) and self.stays_apart(state[end - size], t)
            if ok:
                return t
        raise ValueError(f"no token ends at {text[:end]!r}")

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each distinct word, words being given as byte letters."""
        out: dict[str, list[int]] = {}
        state: list[int] = [-1]
        tokens, before = self.tokens, ""
        for word in sorted(words):
            n = len(word)
            keep, most = 0, min(len(state) - 1, n - 1)
            while keep < most and before[keep] == word[keep]:
                keep += 1
            del state[keep + 1 :]
            for end in range(keep + 1, n):
                state.append(self._last(word, end, "", state))
            t = self._last(word, n, END, state)
            ids, at = [t], n - len(tokens[t]) + len(END)
            while at:
                t = state[at]
                ids.append(t)
                at -= len(tokens[t])
            out[word] = ids[::-1]
            before = word
        if len(self.beside) > CACHED_PAIRS:
            self.beside.clear()
        return out

    def split(self, piece: str) -> list[str]:
        """Words of a piece of text without blanks, in byte letters, as the tokenizer splits it.

        Beyond the common alphabets the tokenizer's own normaliser and splitter are asked, as
        they may know another version of Unicode than this process.
        """
        if piece.isascii() and piece.isalpha():
            return [piece.lower()]
        if piece and max(piece) >= "\u0530":
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
            return [w for w, _ in found]
        found = WORD.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())
        return [w if w.isascii() and w.isprintable() else self._lettered(w) for w in found]

    def _lettered(self, word: str) -> str:
        letters = self.letters
        return "".join([letters[b] for b in word.encode("utf-8", "surrogatepass")])

    def _parts(self, piece: str) -> list[str | int]:
        """Words of a piece, and ids of special tokens that it spells out."""
        if "<|" not in piece:
            return self.split(piece)
        out, at = [], 0
        for m in self.is_special.finditer(piece):
            out += [*self.split(piece[at : m.start()]), self.special[m.group()]]
            at = m.end()
        return [*out, *self.split(piece[at:])]

    def forget(self) -> None:
        """Give up what was kept of earlier texts; the vocabulary stays."""
        self.pieces = {"": b""}
        self.told = {"": (0, "", "")}
        self.words.clear()
        self.beside.clear()

    def _fresh(self, cut: list[list[str]], known: dict) -> Iterator[tuple[str, list[int]]]:
        """Ids of the pieces that are not known yet."""
        fresh = {p: self._parts(p) for p in {p for c in cut for p in c} - known.keys()}
        if len(self.words) > self.cached:
            self.words.clear()
        # The same word stands in pieces with and without marks.
        found = self.words
        found.update(self.encode_words([*{w for parts in fresh.values() for w in parts if isinstance(w, str)} - found.keys()]))
        for p, parts in fresh.items():
            yield p, [i for w in parts for i in (found[w] if isinstance(w, str) else (w,))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 4-byte integers."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.pieces) > self.cached:
            self.pieces = {"": b""}
        pieces = self.pieces
        for p, ids in self._fresh(cut, pieces):
            pieces[p] = array("i", ids).tobytes()
        return [b"".join(map(pieces.__getitem__, c)) for c in cut]

    def tell(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of its ids, the ids, and what they decode to, as texts with spaces between."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.told) > self.cached:
            self.told = {"": (0, "", "")}
        told, tokens = self.told, self.tokens
        for p, ids in self._fresh(cut, told):
            told[p] = (len(ids), " ".join(map(str, ids)), " ".join([tokens[i] for i in ids]))
        for c in cut:
            parts = [t for t in map(told.__getitem__, c) if t[0]]
            yield sum([t[0] for t in parts]), " ".join([t[1] for t in parts]), " ".join([t[2] for t in parts])


def _encoder(path: str, cached: int = CACHED) -> TrieEncoder:
    return per_process(("trie", path, cached), lambda: TrieEncoder(path, cached))


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for each row. One pass over the texts without a shuffle; words are made
    distinct and put into a trie within a block of texts, so memory is bounded by the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in grouped_by_size(texts, BLOCK_CHARS):
                found = encoder.encode(texts[a:b])
                at = np.cumsum([0, *(len(x) // 4 for x in found)])
                values = pa.array(np.frombuffer(b"".join(found), "<i4"))
                ids = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), values).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), ids], names=["doc_id", "ids"])
        # The worker process may wait idle while other stages need its executor's memory.
        encoder.forget()
        give_back()

    return chosen_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def _tokens(path: str) -> list[str]:
    """The vocabulary's tokens by id; decoding needs no more."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max(ids.values()) + 1)
    for t, i in ids.items():
        tokens[i] = t
    return tokens


def bpe_decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: the tokens of the ids with a space between, special ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = per_process(("tokens", tokenizer), lambda: _tokens(tokenizer))
        for whole in batches:
            # Ids become Python numbers one document at a time, and text leaves some hundred at a time.
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                ids = batch.column("ids").fill_null([])
                flat = ids.flatten().to_numpy()
                at = np.r_[0, np.cumsum(ids.value_lengths().to_numpy())].tolist()
                text = [" ".join(map(tokens.__getitem__, flat[a:b].tolist())) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(text, pa.string())], names=["doc_id", "ids", "decoded"])
        give_back()

    return encoded.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED) -> DataFrame:
    """What :func:`digests` tells of encoded and decoded documents, in one pass and one process for each task.

    Ids and decoded text of a document exist one at a time and do not leave the process. ``cached`` pieces of text, or
    a block's more, are kept with their ids: fewer take less memory and more time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, cached)
        for whole in batches:
            for first in range(0, whole.num_rows, SOME_ROWS):
                batch = whole.slice(first, SOME_ROWS)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                rows = [
                    (n, sha256(ids.encode()).hexdigest(), sha256(decoded.encode()).hexdigest())
                    for a, b in grouped_by_size(texts, BLOCK_CHARS)
                    for n, ids, decoded in encoder.tell(texts[a:b])
                ]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        encoder.forget()
        give_back()

    return chosen_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digests(decoded: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
