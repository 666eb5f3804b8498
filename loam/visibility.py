"""Which nodes a read may see; the clock is always a parameter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def live() -> Column:
    return F.col("deleted_at").isNull()


def tier(include_extracted: bool = False) -> Column:
    return F.lit(True) if include_extracted else F.col("origin") == "curated"


def fresh(now: str, include_expired: bool = False) -> Column:
    return F.lit(True) if include_expired else F.col("valid_until").isNull() | (F.col("valid_until") >= moment(now))


def content() -> Column:
    return F.col("type") != "category"


def not_auto() -> Column:
    return ~F.col("path").contains("/auto/")


def visible(now: str, include_extracted: bool = False, include_expired: bool = False, categories: bool = True, auto: bool = True) -> Column:
    parts = [live(), tier(include_extracted), fresh(now, include_expired)]
    return reduce(Column.__and__, parts + ([] if categories else [content()]) + ([] if auto else [not_auto()]))


def importance() -> Column:
    """As double; null and 0 count as one half."""
    i = F.col("importance").cast("double")
    return F.when(i.isNull() | (i == 0), 0.5).otherwise(i)


def days_since(column: str, now: str) -> Column:
    """Whole and part days before now, never negative; 365 where there is no time."""
    seconds = F.unix_micros(F.to_timestamp(moment(now)).cast("timestamp")) - F.unix_micros(F.col(column).cast("timestamp"))
    return F.when(seconds.isNull(), 365.0).otherwise(F.greatest(seconds / F.lit(86_400_000_000.0), F.lit(0.0)))
