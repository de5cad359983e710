"""Monthly prices, as-of joins, densification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import months

TYPE = ("complex_id", "type_id")


def mean_int(c: str | Column) -> Column:
    return F.round(F.avg(c)).cast("int")


def monthly(deals: DataFrame, keys: Sequence[str] = TYPE) -> DataFrame:
    """Price per type and month; dimensions are joined after the aggregation, not carried through it."""
    return deals.groupBy(*keys, "month").agg(mean_int("amount").alias("price"), F.min("amount").alias("low"), F.max("amount").alias("high"), mean_int("pyeong").alias("pyeong"), F.count("*").alias("deals"))


def recent(deals: DataFrame, today: str, days: int = 30, keys: Sequence[str] = TYPE) -> DataFrame:
    """Price per type over the last days, both ends counted; source_month is the newest deal's."""
    day = F.to_date(F.lit(today))
    rows = deals.where(F.col("deal_date").between(F.date_sub(day, days), day))
    return rows.groupBy(*keys).agg(mean_int("amount").alias("price"), mean_int("pyeong").alias("pyeong"), F.count("*").alias("deals"), F.max("month").alias("source_month"))


def asof(prices: DataFrame, keys: Sequence[str], targets: dict[str, str], columns: Sequence[str], forward: bool = False) -> DataFrame:
    """Per key, for each name and month of targets, a struct of the row at or before it (forward: at or after).

    One aggregation for all targets: no window sort, no join. Months are unique per key.
    """
    row = F.struct("month", *columns)
    pick = lambda t: (F.min_by(row, F.when(F.col("month") >= t, F.col("month"))) if forward else F.max_by(row, F.when(F.col("month") <= t, F.col("month"))))
    lo, hi = min(targets.values()), max(targets.values())
    rows = prices.where(F.col("month") >= lo) if forward else prices.where(F.col("month") <= hi)
    found = rows.groupBy(*keys).agg(*(pick(t).alias(n) for n, t in targets.items()))
    ok = lambda n, t: F.when(F.col(n)["month"] >= t if forward else F.col(n)["month"] <= t, F.col(n))
    return found.select(*keys, *(ok(n, t).alias(n) for n, t in targets.items()))


def asof_many(left: DataFrame, prices: DataFrame, keys: Sequence[str], month: str, columns: Sequence[str]) -> DataFrame:
    """left with, per row, the columns of the newest price at or before its month: union, then the last value carried on."""
    mine = prices.select(*keys, F.col("month").alias("_m"), F.struct("month", *columns).alias("found"), F.lit(0).alias("_side"))
    theirs = left.withColumns({"_m": F.col(month), "_side": F.lit(1), "_row": F.struct(*left.columns)}).select(*keys, "_m", "_side", "_row")
    w = Window.partitionBy(*keys).orderBy("_m", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = mine.unionByName(theirs, allowMissingColumns=True).withColumn("found", F.last("found", True).over(w))
    return both.where("_side = 1").select("_row.*", "found")


def densify(prices: DataFrame, keys: Sequence[str], start: str, end: str, column: str) -> DataFrame:
    """A row for each key and month of the calendar, the last known value carried forward (also from before the start)."""
    calendar = prices.select(*keys).distinct().select(*keys, F.explode(months.span(F.lit(start), F.lit(end))).alias("month"))
    before = asof(prices, keys, {"before": months.shift(start, -1)}, [column]).select(*keys, F.col(f"before.{column}").alias("_before"))
    own = prices.select(*keys, "month", F.col(column).alias("own"))
    w = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return calendar.join(own, [*keys, "month"], "left").join(before, list(keys), "left").select(*keys, "month", "own", F.coalesce(F.last("own", True).over(w), "_before").alias(column))


def interpolate(prices: DataFrame, keys: Sequence[str], month: str, column: str) -> DataFrame:
    """Linear between the rows around a month; null outside."""
    row = F.struct(months.index(F.col("month")).alias("at"), F.col(column).alias("v"))
    t = F.lit(int(month[:4]) * 12 + int(month[4:]) - 1)
    found = prices.groupBy(*keys).agg(F.max_by(row, F.when(F.col("month") <= month, F.col("month"))).alias("a"), F.min_by(row, F.when(F.col("month") >= month, F.col("month"))).alias("b"))
    a, b = F.when(F.col("a.at") <= t, F.col("a")), F.when(F.col("b.at") >= t, F.col("b"))
    return found.select(*keys, F.when(a["at"] == b["at"], a["v"].cast("double")).otherwise(a["v"] + (b["v"] - a["v"]) * (t - a["at"]) / (b["at"] - a["at"])).alias(column))


def order_stats(counts: DataFrame, keys: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """keys, total, median, trimmed of values with their counts: each (keys, value) stands once.

    Running counts tell which values hold the middle places, and how many of each remain without a tenth (rounded down)
    at each end. Only distinct values are sorted, and none are held together. Null values don't count.
    """
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    run = counts.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.col(n).alias("_n"), F.sum(n).over(w).alias("_to"), F.sum(n).over(whole).alias("_all"))
    before, cut = F.col("_to") - F.col("_n"), F.floor(F.col("_all") / 10)
    holds = lambda place: F.max(F.when((before < place) & (F.col("_to") >= place), F.col("_v")))
    left = F.greatest(F.least(F.col("_to"), F.col("_all") - cut) - F.greatest(before, cut), F.lit(0))
    return run.groupBy(*keys).agg(
        F.sum("_n").alias("total"),
        ((holds(F.floor((F.col("_all") + 1) / 2)) + holds(F.floor(F.col("_all") / 2) + 1)) / 2).alias("median"),
        (F.sum(left * F.col("_v")) / F.sum(left)).alias("trimmed"),
    )
