"""What the training-data operators share: input columns, tables in the shared folder, joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that the contracts call white space.
SPACE = r"[\x20\x09-\x0D]+"

#: Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """id, text and what else is named; a null text becomes empty, other columns go (so none can clash)."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where the session names none, one of our own in local mode, where all run in one process; on a cluster it raises.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(found)
    return found


#: Paths of written tables that are still there, oldest first.
_TABLES: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: computed once, short lineage, safe from lost executors.

    Shuffle files of the write go when it ends, since nothing reads them again; the table goes by discard(), or else
    when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    _folder(spark, path, "deleteOnExit")
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str, action: str, *more: bool) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    getattr(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), action)(at, *more)


def marked() -> int:
    """A mark in the list of written tables, for discard()."""
    return len(_TABLES)


def discard(spark: SparkSession, since: int, but: Sequence[DataFrame] = ()) -> None:
    """Deletes the tables written after marked() gave `since`, except those that the frames of `but` read.

    Call it only when nothing that is still to be computed reads them.
    """
    kept = {f.split("/")[-2] for df in but for f in df.inputFiles()}
    gone = [p for p in _TABLES[since:] if p.rsplit("/", 1)[-1] not in kept]
    for path in gone:
        _folder(spark, path, "delete", True)
        _TABLES.remove(path)


def few(df: DataFrame, table: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if `table`, the written rows that it is made of, are at most `most`; else it is shuffled."""
    return F.broadcast(df) if table.count() <= most else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner join of rows with one row per key of groups, where a few keys may hold most rows.

    Keys with more than total / parts rows are at most `parts` many, whatever the input: these are broadcast
    and their rows don't move. All other keys are small and take the ordinary join.
    """
    hot = groups.where(F.col(size) > F.lit(max(total // parts, 64)))
    warm = rows.join(F.broadcast(hot), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(size) <= F.lit(max(total // parts, 64))), key)
    return warm.unionByName(cold)


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of edges (u, v long): one row (node, root) per node, root the least node reachable.

    Alternating large-star and small-star rounds; each is two aggregations and joins, with the state written to the
    shared folder. Rounds grow with the logarithm of a component's size. Raises if `limit` rounds don't suffice.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(limit):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        wide = both(now)
        least = wide.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = wide.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = written(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {limit} rounds")


def ranked_in_groups(df: DataFrame, group: str, order: Sequence[Column | str], salt: Column, out: str = "rank") -> DataFrame:
    """0-based rank of each row in its group, without one task per group.

    Rows are ranked inside (group, salt); a running sum over the table of counts, one row per group and salt, gives
    each salt its start. `salt` must be a bounded function of the row; order is by salt first.
    """
    from pyspark.sql import Window

    dealt = df.withColumn("_salt", salt)
    counts = dealt.groupBy(group, "_salt").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).select(group, "_salt", F.coalesce("_start", F.lit(0)).alias("_start"))
    own = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order)) - 1)
    return own.join(starts, [group, "_salt"]).withColumn(out, (F.col("_rn") + F.col("_start")).cast("long")).drop("_salt", "_rn", "_start")
