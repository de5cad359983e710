"""Ranks in scopes, roll-ups of the hierarchy, pages, keep-first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import numbers

LEVELS = ("sido", "sigungu", "dong")


def order(growth: str = "growth_rate", *then: Column) -> list[Column]:
    return [F.col(growth).desc_nulls_last(), *then]


def table_rank(df: DataFrame, by: Sequence[Column], out: str) -> DataFrame:
    """df with its 1-based rank over all rows: sorted in ranges, whose counts give each range its start.

    The sorted rows are written to the shared folder, so that ranges and ranks are those of one sort.
    """
    from ridgeline.operators.entity import shared_table

    placed = shared_table(df.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return ranked.withColumn(out, (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_start") + 1).cast("int")).drop("_at", "_part", "_start")


def scope_ranks(items: DataFrame, scopes: dict[str, Sequence[str | Column]], by: Sequence[Column]) -> DataFrame:
    """rank and total columns for each named scope (its partition columns; none: the whole table)."""
    for name, keys in scopes.items():
        if not keys:
            items = table_rank(items, by, f"{name}_rank")
            items = items.crossJoin(F.broadcast(items.agg(F.count("*").cast("int").alias(f"{name}_total"))))  # one row
    out = {}
    for name, keys in scopes.items():
        if keys:
            out[f"{name}_rank"] = F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("int")
            out[f"{name}_total"] = F.count("*").over(Window.partitionBy(*keys)).cast("int")
    return items.withColumns(out) if out else items


def rollup(items: DataFrame) -> DataFrame:
    """Sido, sigungu and dong in one pass: mean place, unweighted mean growth, rounded mean amount, counts."""
    sets = [[F.col("sido_key")], [F.col("sido_key"), F.col("sigungu_key")], [F.col("sido_key"), F.col("sigungu_key"), F.col("dong_key")]]
    gid = F.grouping_id()
    grouped = items.groupingSets(sets, "sido_key", "sigungu_key", "dong_key").agg(
        F.when(gid == 3, "sido").when(gid == 1, "sigungu").otherwise("dong").alias("level"),
        numbers.rounded(F.avg("lat"), 6).alias("lat"),
        numbers.rounded(F.avg("lng"), 6).alias("lng"),
        numbers.rounded(F.avg("growth_rate"), 6).alias("growth_rate"),
        F.floor(F.avg("growth_amount") + 0.5).cast("int").alias("growth_amount"),
        F.countDistinct("complex_id").alias("complexes"),
        F.sum("types").alias("types"),
    )
    return grouped


def first_by(df: DataFrame, keys: Sequence[str], by: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; the plan limits inside each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def page(df: DataFrame, by: Sequence[Column], page: int, size: int) -> DataFrame:
    """A page of the ordered rows with its ranks; sorted once, only the rows up to its end are kept."""
    start = (page - 1) * size
    rows = df.orderBy(*by).limit(start + size)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*by)).cast("int")).where(F.col("rank") > start)


def group_rank(df: DataFrame, keys: Sequence[str], by: Sequence[Column], out: str) -> DataFrame:
    """df with its 1-based rank in each group, however large a group is: sorted by group and order in ranges; a group's
    rows in earlier ranges are counted by one row for each group and range. Null keys are a group."""
    from ridgeline.operators.entity import shared_table

    placed = shared_table(df.orderBy(*keys, *by).withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(starts, same).withColumn(out, (F.col("_at") - F.col("_first") + F.col("_start") + 1).cast("int")).select(*df.columns, out)
