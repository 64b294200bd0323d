"""What the operators of this subpackage share: tables written between stages, null-safe id joins,
and numpy views of Arrow text columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchora.plans.tables import shared_dir, written

__all__ = ["shared_dir", "written"]

#: ASCII white space that separates words in every operator.
SPACE = "\t\n\x0b\x0c\r "


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def semi_by_id(docs: DataFrame, ids: DataFrame, anti: bool = False) -> DataFrame:
    """Rows of ``docs`` whose doc_id is (or is not) in ``ids``; null equals null."""
    ids = ids.select(F.col("doc_id").alias("_wanted")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_wanted"]), "left_anti" if anti else "left_semi")


def words_of(text: Column) -> Column:
    """The words of a text as a native array; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{_CLASS}]+"))


_CLASS = r"\x20\x09-\x0D"

# numpy over Arrow text ------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240607)
#: A random 64-bit value for each byte, and an odd multiplier with its inverse modulo 2**64.
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
MULT = np.uint64(0x9E3779B97F4A7C15)
MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Rolling:
    """Hashes of any byte ranges of one buffer: prefix sums of byte values times powers of MULT, modulo 2**64."""

    def __init__(self, buf: np.ndarray):
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[buf] * powers(MULT, len(buf)), out=self.sums[1:])
        self.inverse = powers(MULT_INV, len(buf) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def text_parts(column, max_bytes: int = 2 << 20):
    """Cut an Arrow string array into runs of whole texts of about ``max_bytes`` (one longer text stands alone).

    Yields (first row, offsets relative to the buffer, uint8 buffer). A null is an empty text."""
    import pyarrow as pa

    if len(column) == 0:
        return
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1)
        last = min(last, len(column))
        yield first, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


#: Whether a byte is ASCII white space.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_ranges(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word of the texts in ``buf``; words never cross a text's bounds."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = ~SPACES[buf]
    cut = np.zeros(len(buf) + 1, bool)  # before which byte a text starts
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
