"""Visual hashes, their distance, and the hash that splits samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gradient_hash(pixels: Column, columns: int, rows: int = 8) -> Column:
    """Hex of one bit for each pixel that is brighter than the one left of it, row by row; pixels: rows * columns numbers."""
    at = F.filter(F.sequence(F.lit(0), F.lit(rows * columns - 1)), lambda i: i % columns != columns - 1)
    bits = F.array_join(F.transform(at, lambda i: F.when(F.get(pixels, i + 1) > F.get(pixels, i), "1").otherwise("0")), "")
    return F.lower(F.lpad(F.conv(bits, 2, 16), rows * (columns - 1) // 4, "0"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes in hex; a thousand million if they can't be compared."""
    hexes = a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$") & (F.length(a) == F.length(b))
    number = lambda x: F.conv(x, 16, -10).cast("long")
    return F.when(hexes, F.bit_count(number(F.when(hexes, a)).bitwiseXOR(number(F.when(hexes, b))))).otherwise(F.lit(10**9)).cast("long")


def in_validation(key: Column, ts: Column, ratio: float) -> Column:
    """Whether a (video, time) belongs to the validation share: by hash, so the same in every run."""
    if ratio <= 0 or ratio >= 1:
        return F.lit(ratio >= 1)
    part = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.rint(ts).cast("long").cast("string"))), 1, 8), 16, 10).cast("double")
    return part / F.lit(4294967295.0) < ratio
