"""Unicode normalisation and kana, which Spark lacks, on Arrow arrays."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(c: Column) -> Column:
    """The text NFKC-folded, on Arrow batches. (Arrow's own kernel leaves voicing marks
    of half-width katakana apart, so the standard library folds.)"""

    @F.arrow_udf("string")
    def folded(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in x.to_pylist()], pa.string())

    return folded(c)


def keep_piece(piece: str) -> bool:
    """Whether a vocabulary piece is of use for Japanese and ASCII text: ASCII, kana,
    kanji, full and half width forms, punctuation, symbols, separators."""
    ranges = ((0x3000, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF))
    return all(c.isascii() or any(lo <= ord(c) <= hi for lo, hi in ranges) or unicodedata.category(c)[0] in "PSZ" for c in piece if c != "▁")
