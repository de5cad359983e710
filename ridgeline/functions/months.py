"""Months as YYYYMM text: they compare as text, arithmetic goes through a month index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index(month: Column) -> Column:
    """Months since year 0, from YYYYMM text."""
    return month.substr(1, 4).cast("int") * 12 + month.substr(5, 2).cast("int") - 1


def text(idx: Column) -> Column:
    return F.concat(F.lpad(F.floor(idx / 12).cast("string"), 4, "0"), F.lpad((idx % 12 + 1).cast("string"), 2, "0"))


def add(month: Column, n: int | Column) -> Column:
    return text(index(month) + n)


def between(start: Column, end: Column) -> Column:
    """Months from start to end, negative if end is earlier."""
    return index(end) - index(start)


def span(start: Column, end: Column) -> Column:
    """Array of all months from start to end."""
    return F.transform(F.sequence(index(start), index(end)), text)


def of(date: Column) -> Column:
    return F.lpad((F.year(date) * 100 + F.month(date)).cast("string"), 6, "0")  # no formatter for each row


def shift(month: str, n: int) -> str:
    """Plan-time version of add()."""
    i = int(month[:4]) * 12 + int(month[4:]) - 1 + n
    return f"{i // 12:04d}{i % 12 + 1:02d}"


#: Fixed values: (longest period, gap allowed at the start, at the end), in months.
FRESHNESS = ((3, 1, 1), (6, 2, 2), (12, 3, 3), (36, 6, 3))
FRESHNESS_BEYOND = (12, 3)


def freshness(period: float) -> tuple[int, int]:
    """How many months the start and end price of a period may lag; NaN counts as the longest."""
    return next(((a, b) for most, a, b in FRESHNESS if period <= most), FRESHNESS_BEYOND)


def fresh(source: Column, target: Column, most: int) -> Column:
    gap = between(source, target)
    return (gap >= 0) & (gap <= most)
