"""Words of letters and digits over UTF-8 bytes: A-Z in lower case, all beyond ASCII kept as it is."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pattern these words follow, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def spaced(text: bytes) -> bytes:
    """The text's words with spaces in place of everything else; as long as the text."""
    return text.translate(_TABLE)


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of about ``size`` bytes that never cut a word; words stand between ASCII blanks."""
    at = 0
    while at < len(text):
        end = at + size
        # The end moves on to the next blank; a longer word stays whole.
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end]
        at = end


def byte_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc_id`` (long) and the text's bytes (none for null) as ``text``; other columns cannot clash."""
    text = F.coalesce(docs[text_col].cast("string").cast("binary"), F.lit(b""))
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), text.alias("text"))
