"""Words and their hashes, and the array helpers that the text operators share.

Words: after lower-casing, each character U+4E00-U+9FFF alone, else each longest run of other letters and digits.
They are split and hashed by built-in expressions, so Python sees 64-bit numbers only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[一-鿿]|[\p{L}\p{N}&&[^一-鿿]]+"


def words(text: Column) -> Column:
    """The words of a text; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (from 0) of a list column; null lists are empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return column.flatten().to_numpy(zero_copy_only=False), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(values: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of `width` values that lie in one list, and the list of each."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    starts = np.arange(int(counts.sum())) - first[owner] + offsets[:-1][owner]
    return starts, owner


def shingles(values: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of `width` values."""
    values = values.astype(np.int64, copy=False).view(np.uint64)
    out = np.zeros(len(starts), dtype=np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[starts + i])
    return out
