"""How values are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PENDING = "Pending"


def format_size(size: Column) -> Column:
    """``1.50 GB``; bytes without decimals; null as zero."""
    value = F.coalesce(size, F.lit(0)).cast("double")
    out = F.concat(F.replace(F.format_number(value / float(1024**4), 2), F.lit(","), F.lit("")), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        shown = F.concat(F.replace(F.format_number(value / float(1024**power), 2), F.lit(","), F.lit("")), F.lit(f" {unit}"))
        out = F.when(value < float(1024 ** (power + 1)), shown).otherwise(out)
    return F.when(value < 1024, F.concat(value.cast("bigint").cast("string"), F.lit(" B"))).otherwise(out)


def format_duration(seconds: Column) -> Column:
    """``1h 2m 3s`` without parts that are zero; ``0s`` for zero; null stays null."""
    s = seconds.cast("bigint")
    parts = [F.when(n > 0, F.concat(n.cast("string"), F.lit(u))) for n, u in ((F.floor(s / 3600), "h"), (F.floor(s % 3600 / 60), "m"), (s % 60, "s"))]
    return F.when(s.isNotNull(), F.coalesce(F.when(s > 0, F.concat_ws(" ", *parts)), F.lit("0s")))


def format_date(when: Column) -> Column:
    return F.coalesce(F.date_format(when, "yyyy-MM-dd"), F.lit(PENDING))


def format_time(when: Column) -> Column:
    return F.coalesce(F.date_format(when, "yyyy-MM-dd HH:mm:ss"), F.lit(PENDING))


def format_number(value: Column) -> Column:
    return F.coalesce(F.format_number(value, 0), F.lit("0"))


def shown(text: Column, default: str) -> Column:
    """The text, or a default where it is null or empty."""
    return F.coalesce(F.when(text != "", text), F.lit(default))
