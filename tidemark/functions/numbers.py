"""Arithmetic whose order of operations is part of the result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct_return(value: Column, previous: Column) -> Column:
    return (value / previous - 1) * 100


def turnover(volume: Column, shares: Column) -> Column:
    return F.when(shares > 0, volume / shares * 100)


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def share_change(now: Column, before: Column) -> Column:
    return F.when(before > 0, F.abs(now - before) / before * 100)


def parse_number(*aliases: Column) -> Column:
    """The first alias that isn't blank decides, even if it is no number; thousands commas are dropped."""
    first = F.coalesce(*[F.nullif(F.trim(a), F.lit("")) for a in aliases])
    return F.regexp_replace(first, ",", "").try_cast("double")
