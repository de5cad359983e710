"""A resumable back-fill: tasks less what the ledger says is done, claimed in waves, stopped at a quota.

The ledger only grows: every change of a task's state is a row, the newest counts. What a wave brings is written under
a name of its own before its tasks are said to be completed; readers take only what the ledger vouches for. So a run
that is killed leaves nothing to clean: its unfinished tasks are claimed again, and what it wrote for them isn't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import snapshots

TASK = ("code", "month")
LEDGER = "code string, month string, status string, wave string, total_count long, fetched long, saved long, filtered long, error string, n long, updated_at timestamp"

#: Fetches claimed tasks: gives code, month, total_count, error (null if it went well) and items, an array.
Provider = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Outcome:
    completed: int
    failed: int
    stopped: str  # 'quota' if a fetch said so, 'limit' if tasks are left, else ''


def plan(codes: DataFrame, months: Sequence[str]) -> DataFrame:
    """Every code in every month."""
    return codes.select(F.col("code").cast("string").alias("code"), F.explode(F.array(*map(F.lit, months))).alias("month")).distinct()


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """The newest state of each task; a state's number breaks ties of time."""
    log = snapshots._rows(spark, f"{root}/ledger", LEDGER)
    return log.groupBy(*TASK).agg(F.max_by(F.struct("status", "wave", "total_count", "fetched", "saved", "filtered", "error", "updated_at"), F.struct("n", "updated_at")).alias("s"), F.count_if(F.col("status") == "started").alias("starts")).select(*TASK, "s.*", "starts")


def left(spark: SparkSession, root: str, tasks: DataFrame, force: bool = False) -> DataFrame:
    """Tasks that aren't completed; all of them with force."""
    done = ledger(spark, root).where("status = 'completed'").select(*TASK)
    return tasks if force else tasks.join(done, list(TASK), "left_anti")


def _append(rows: DataFrame, root: str, status: str, wave: str, n: int) -> None:
    """One file for a wave's states: they show all at once."""
    have = {c: F.col(c) if c in rows.columns else F.lit(None) for c in ("total_count", "fetched", "saved", "filtered", "error")}
    rows.select(*TASK, (F.col("status") if "status" in rows.columns else F.lit(status)).alias("status"), F.lit(wave).alias("wave"), *(c.cast("string" if k == "error" else "long").alias(k) for k, c in have.items()), F.lit(n).cast("long").alias("n"), F.current_timestamp().alias("updated_at")).coalesce(1).write.mode("append").parquet(f"{root}/ledger")


def run(spark: SparkSession, root: str, tasks: DataFrame, fetch: Provider, limit: int, wave: int = 500, keep: Callable[[DataFrame], DataFrame] | None = None, quota: str = "quota", force: bool = False) -> Outcome:
    """Works off at most `limit` tasks, by month and code, `wave` at a time; a wave is fetched by Spark's tasks side by side.

    A fetch with an error fails its task only; if an error names the quota, no further wave is claimed. keep: filters
    items (code, month, item) before they are stored; what it drops is counted.
    """
    # The claims are fixed before the first wave: at most `limit` rows.
    claims = [tuple(r) for r in left(spark, root, tasks, force).select(*TASK).orderBy("month", "code").limit(limit + 1).collect()]
    more, claims = len(claims) > limit, claims[:limit]
    base = spark.read.parquet(f"{root}/ledger").agg(F.max("n")).first()[0] or 0 if snapshots._exists(spark, f"{root}/ledger") else 0
    completed = failed = 0
    for k in range(0, len(claims), wave):
        name, n = uuid.uuid4().hex, base + 2 * (k // wave) + 1
        mine = spark.createDataFrame(claims[k : k + wave], "code string, month string")
        _append(mine, root, "started", name, n)
        path = f"{root}/items/{name}"
        got = fetch(mine)
        got.select(*TASK, "total_count", "error", F.when(F.col("error").isNull(), F.col("items")).alias("items")).write.parquet(f"{path}/fetched")
        got = spark.read.parquet(f"{path}/fetched")
        items = got.select(*TASK, F.explode("items").alias("item"))
        (items if keep is None else keep(items)).write.parquet(f"{path}/kept")
        saved = spark.read.parquet(f"{path}/kept").groupBy(*TASK).agg(F.count("*").alias("saved"))
        states = mine.join(got, list(TASK), "left").join(saved, list(TASK), "left")
        bad = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("items").isNull(), "no answer")
        size, kept = F.size("items"), F.coalesce("saved", F.lit(0))
        states = states.select(*TASK, F.when(bad.isNull(), "completed").otherwise("failed").alias("status"), F.coalesce("total_count", size).alias("total_count"), F.when(bad.isNull(), size).alias("fetched"), F.when(bad.isNull(), kept).alias("saved"), F.when(bad.isNull(), size - kept).alias("filtered"), F.left(bad, F.lit(500)).alias("error"))
        _append(states, root, "", name, n + 1)
        ended = {r["status"]: (r["n"], r["quota"]) for r in spark.read.parquet(f"{root}/ledger").where((F.col("wave") == name) & (F.col("n") == n + 1)).groupBy("status").agg(F.count("*").alias("n"), F.bool_or(F.contains(F.lower(F.coalesce("error", F.lit(""))), F.lit(quota))).alias("quota")).collect()}
        completed += ended.get("completed", (0, False))[0]
        failed += ended.get("failed", (0, False))[0]
        if ended.get("failed", (0, False))[1]:
            return Outcome(completed, failed, "quota")
    return Outcome(completed, failed, "limit" if more else "")


def stored(spark: SparkSession, root: str) -> DataFrame:
    """code, month, item of the tasks that are completed, each from the wave that completed it."""
    done = ledger(spark, root).where("status = 'completed' and saved > 0").select(*TASK, "wave")
    waves = [r["wave"] for r in done.select("wave").distinct().collect()]  # one for each wave that has run
    if not waves:
        return spark.createDataFrame([], "code string, month string, item map<string, string>")
    rows = spark.read.parquet(*(f"{root}/items/{w}/kept" for w in waves)).withColumn("wave", F.element_at(F.split(F.input_file_name(), "/"), -3))
    return rows.join(done, [*TASK, "wave"]).drop("wave")


def progress(spark: SparkSession, root: str, tasks: DataFrame) -> DataFrame:
    """status, tasks, fetched, saved, filtered: planned tasks by state, untouched ones as 'pending'."""
    states = tasks.join(ledger(spark, root), list(TASK), "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    return states.groupBy("status").agg(F.count("*").alias("tasks"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fetched", "saved", "filtered")))
