"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024 * 1024


def file_size(n: Column) -> Column:
    return F.when(n < MIB, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.2f MB", n / float(MIB)))


def number_groups(n: Column) -> Column:
    """Whole part in groups of three digits, parted by spaces."""
    return F.replace(F.format_number(F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("bigint"), 0), F.lit(","), F.lit(" "))


def count(n: Column) -> Column:
    return F.format_number(n, 0)


def duration(ms: Column) -> Column:
    """Seconds with two digits, rounded as the double ms / 1000 stands: 1005 ms is a little under 1.005 s and gives 1.00s.

    Whole milliseconds of 0 and more; a tie of the decimal form is decided by comparing the double with it, scaled to
    whole numbers; real ties go up. Null stays null.
    """
    whole = F.floor(ms).cast("bigint")
    x = whole / F.lit(1000.0)
    scale = F.pow(F.lit(2.0), 52 - F.floor(F.log2(F.greatest(x, F.lit(0.001))))).cast("bigint")
    up = (x * scale).cast("bigint") * 1000 >= whole * scale
    hundredths = F.floor(whole / 10).cast("bigint") + F.when(whole % 10 > 5, 1).when((whole % 10 == 5) & up, 1).otherwise(0)
    return F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit("s"))


def clock(ms: Column) -> Column:
    s = F.floor(ms / 1000.0 + 0.5)
    return F.when(ms.isNotNull(), F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), (s % 60).cast("int")))


def chapter_label(number: Column, total: Column) -> Column:
    width = F.greatest(F.lit(2), F.length(total.cast("string")))
    text = number.cast("string")
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.length(text))), text, F.lit("."))


def timeout_ms(c: Column, default: int = 600_000) -> Column:
    ok = c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))
    return F.when(ok, F.floor(c)).otherwise(F.lit(default)).cast("bigint")
