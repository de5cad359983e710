"""Snapshots: written whole, checked, then made active; read exactly or as of a month; ledgers, caches and run logs.

A snapshot is a folder of its own under a root that all executors share; its header is one row of a headers table
whose newest version counts. Readers see a snapshot only once its header says that it is active.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "basis", "start_month", "end_month", "area_band", "min_households")
HEADER = "source string, basis string, start_month string, end_month string, area_band string, min_households int, path string, status string, band_count long, item_count long, updated_at timestamp"


class SnapshotError(ValueError):
    pass


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def log_headers(spark: SparkSession, root: str) -> DataFrame:
    """Every state that any snapshot has been in."""
    return _rows(spark, f"{root}/headers", HEADER)


def headers(spark: SparkSession, root: str) -> DataFrame:
    """The newest state of each snapshot; an older active one of the same keys counts as superseded."""
    newest = log_headers(spark, root).groupBy(*KEYS, "path").agg(F.max_by(F.struct("status", "band_count", "item_count"), "updated_at").alias("s"), F.max("updated_at").alias("updated_at")).select(*KEYS, "path", "s.*", "updated_at")
    last = newest.where("status = 'active'").groupBy(*KEYS).agg(F.max_by("path", "updated_at").alias("last"))
    state = F.when((F.col("status") == "active") & (F.col("path") != F.col("last")), "superseded").otherwise(F.col("status"))
    return newest.join(last, list(KEYS), "left").withColumn("status", state).drop("last")


def save(spark: SparkSession, root: str, keys: dict, bands: DataFrame, items: DataFrame) -> str:
    """Writes a snapshot as `building`, counts what was stored against what was to be, and makes it active.

    Raises if there are no bands or items, or if counts differ; the snapshot before it then stays active.
    """
    path = f"{root}/data/{uuid.uuid4().hex}"
    state = lambda status, nb, ni: spark.createDataFrame([(*(keys[k] for k in KEYS), path, status, nb, ni)], HEADER.rsplit(",", 1)[0]).withColumn("updated_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/headers")
    state("building", 0, 0)
    want = []
    for name, df in (("bands", bands), ("items", items)):
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/{name}")
        want.append(seen.get["n"])
    stored = [spark.read.parquet(f"{path}/{name}").count() for name in ("bands", "items")]
    if not all(stored) or stored != want:
        state("failed", *stored)
        raise SnapshotError(f"stored {stored[0]} bands and {stored[1]} items of {want[0]} and {want[1]}")
    state("active", *stored)
    return path


def exact(found: DataFrame, **keys) -> DataFrame:
    """The active, filled header of these keys, newest first, one row at most."""
    for k, v in keys.items():
        found = found.where(F.col(k) == v)
    return found.where("status = 'active' and band_count > 0 and item_count > 0").orderBy(F.col("updated_at").desc()).limit(1)


def as_of(found: DataFrame, end_month: str | None = None, period_months: int | None = None, **keys) -> DataFrame:
    """The last active, filled header that ends at or before a month: what is shown while the exact one is missing."""
    for k, v in keys.items():
        found = found.where(F.col(k) == v)
    if period_months is not None:
        found = found.where(F.col("period_months") == period_months)
    if end_month:
        found = found.where(F.col("end_month") <= end_month)
    return found.where("status = 'active' and band_count > 0 and item_count > 0").orderBy(F.col("end_month").desc(), F.col("updated_at").desc()).limit(1)


def nearest_period(found: DataFrame, periods: Sequence[int], months: str = "period_months") -> DataFrame:
    """For each period the header whose own is nearest: within 2 months up to a year, else 6; later ends first."""
    asked = F.explode(F.array(*map(F.lit, periods))).alias("asked")
    rows = found.select("*", asked).withColumn("off", F.abs(F.col(months) - F.col("asked"))).where(F.col("off") <= F.when(F.col("asked") <= 12, 2).otherwise(6))
    best = rows.groupBy("asked").agg(F.max_by(F.struct(*found.columns), F.struct(-F.col("off"), "end_month", "updated_at")).alias("h"))
    return best.select("asked", "h.*")


def latest_state(log: DataFrame, keys: Sequence[str], at: str = "updated_at") -> DataFrame:
    """A ledger is appended to; the newest row of each key counts."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in log.columns if c not in keys)), at).alias("s")).select(*keys, "s.*")


def refresh(old: DataFrame, new: DataFrame, keys: Sequence[str], run: Column, stale: Column | None = None) -> DataFrame:
    """A full import: rows of new in place of those with the same keys, stamped by the run; rows that the import didn't
    bring go, or only those that `stale` tells."""
    from ridgeline.operators.entity import upsert

    stamped = upsert(old, new.withColumn("imported_at", run), keys)
    gone = (F.col("imported_at") < run) | F.col("imported_at").isNull()
    return stamped.where(~(gone & (stale if stale is not None else F.lit(True))))


def cached(spark: SparkSession, path: str, key: str, build, hours: float = 24) -> DataFrame:
    """The entry of a key if it is younger than `hours`, else what build() gives, which is stored."""
    at = f"{path}/{key}"
    if _exists(spark, at):
        fresh = spark.read.parquet(at).where(F.col("refreshed_at") >= F.current_timestamp() - F.make_dt_interval(hours=F.lit(int(hours))))
        if fresh.limit(1).count():
            return fresh.drop("refreshed_at")
    df = build()
    df.withColumn("refreshed_at", F.current_timestamp()).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at).drop("refreshed_at")


def log_run(df: DataFrame, path: str, at: str | None = None) -> None:
    """Appends a run's rows with their time: column `at`, or now."""
    df.withColumn("created_at", F.col(at) if at else F.current_timestamp()).write.mode("append").parquet(path)


def last_runs(spark: SparkSession, path: str, n: int, then: Sequence[Column] = ()) -> DataFrame:
    """The newest n rows, 1 to 50; `then` orders rows of one time."""
    return spark.read.parquet(path).orderBy(F.col("created_at").desc(), *then).limit(max(1, min(n, 50)))


def stale(updated_at: Column, now: Column, hours: int = 36) -> Column:
    return F.coalesce(updated_at < now - F.make_dt_interval(hours=F.lit(hours)), F.lit(True))
