"""What a shell shows of keys, sizes and shares, as expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def preview(value: Column, length: int = 24) -> Column:
    """The value in quotes, backslashes and quotes escaped; longer ones cut with an ellipsis behind."""
    shown = F.regexp_replace(F.left(value, F.lit(length)), r'(["\\])', r"\\$1")
    return F.concat(F.lit('"'), shown, F.when(F.length(value) > length, '"…').otherwise('"'))


def size(n: Column) -> Column:
    """Bytes as B, KB or MB, the latter with one decimal, halves to the even one."""
    scaled = lambda unit, name: F.format_string(f"%.1f {name}", F.bround(n / unit, 1))
    return F.when(n >= 1 << 20, scaled(1 << 20, "MB")).when(n >= 1 << 10, scaled(1 << 10, "KB")).otherwise(F.format_string("%d B", n.cast("long")))


def bar(share: Column, width: int = 30) -> Column:
    """A share between 0 and 1, others moved there, as a bar of `width` signs."""
    full = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))
