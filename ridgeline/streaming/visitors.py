"""Structured Streaming forms of the visitor state, and the alert throttle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ridgeline.operators.entity import shared_table
from ridgeline.plans.visitors import GAP, sessions

LATE = "1 day"  # watermark: later events no longer change a session


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def session_stream(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """Closed sessions, in append mode."""
    return sessions(events.withWatermark("ts", late), gap)


def visitor_stream(events: DataFrame) -> DataFrame:
    """First and last sight and counters of each visitor, in update mode."""
    return events.groupBy("visitor_id").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("events"), F.count_if(F.col("event_name") == "view").alias("views"))


def new_visitors(events: DataFrame) -> DataFrame:
    """The first event of each visitor ever: one flag a visitor stays in state, however long ago the visit was."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = min((b["ts"].min() for b in batches if len(b)), default=None)
        if not state.exists and first is not None:
            state.update((True,))
            yield pd.DataFrame({"visitor_id": [k[0]], "ts": [first]})

    rows = events.select("visitor_id", "ts")
    return rows.groupBy("visitor_id").applyInPandasWithState(run, f"visitor_id {rows.schema['visitor_id'].dataType.simpleString()}, ts timestamp", "seen boolean", "append", GroupStateTimeout.NoTimeout)


def rolling_counts(events: DataFrame, size: str = "1 hour", slide: str = "10 minutes", late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_name").agg(F.count("*").alias("n"))


def throttle_stream(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """An alert passes if the last that passed for its key is at least so long ago; arrival order within a batch by time."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -(1 << 62)
        out = []
        for batch in batches:
            for ts in batch["ts"].sort_values():
                at = ts.value // 1000
                if at - last >= seconds * 1_000_000:
                    out.append(ts)
                    last = at
        state.update((last,))
        if out:
            yield pd.DataFrame({key: k[0], "ts": out})

    return events.select(key, "ts").groupBy(key).applyInPandasWithState(run, f"{key} string, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout)


def throttled(events: DataFrame, key: str, seconds: int, gaps: int = 16) -> DataFrame:
    """The batch form of the throttle: per key the first event, then each first one at least `seconds` after the last that
    passed. Times are cut into blocks of `gaps` times the wait, so no task holds a key.

    What passes in a block depends on the event by which the chain enters it: one of those in the block's first wait, or
    the first after. Each block tells for all of these the last that would pass, hence the entry of the next block; these
    steps are doubled until they span all blocks, which gives each block's true entry, and the blocks list what passes.
    Null keys and times are left out.
    """
    gap = seconds * 1_000_000
    times = events.select(F.col(key).alias("k"), F.unix_micros("ts").alias("at")).dropna().distinct()
    times = shared_table(times.withColumn("block", F.floor(F.col("at") / (gap * gaps))), "times")
    kind = times.schema["k"].dataType.simpleString()

    def entries(of: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(rows["at"].to_numpy())
        follows = np.searchsorted(at, at + gap)
        last = np.arange(len(at))
        for i in range(len(at) - 1, -1, -1):
            if follows[i] < len(at):
                last[i] = last[follows[i]]
        n = min(len(at), int(np.searchsorted(at, of[1] * gap * gaps + gap)) + 1)
        return pd.DataFrame({"k": of[0], "block": of[1], "at": at[:n], "last": at[last[:n]]})

    def passing(of: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at, out = np.sort(rows["at"].to_numpy()), []
        i = int(np.searchsorted(at, rows["entry"].iloc[0]))
        while i < len(at):
            out.append(at[i])
            i = int(np.searchsorted(at, at[i] + gap))
        return pd.DataFrame({"k": of[0], "at": out})

    found = shared_table(times.groupBy("k", "block").applyInPandas(entries, f"k {kind}, block long, at long, last long"), "entries")
    order = Window.partitionBy("k").orderBy("block")  # a row for each block
    firsts = found.groupBy("k", "block").agg(F.min("at").alias("first"))
    ahead = firsts.select("k", "block", F.lead("block").over(order).alias("to"), F.lead("first", 2).over(order).alias("else")).where("to is not null")
    asked = found.join(ahead, ["k", "block"]).select("k", F.col("to").alias("block"), (F.col("last") + gap).alias("x"), F.col("at").alias("source"), "else", F.lit(1).alias("side"))
    given = found.select("k", "block", F.col("at").alias("x"), F.lit(0).alias("side"))
    after = Window.partitionBy("k", "block").orderBy(F.col("x").desc(), "side").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(given, allowMissingColumns=True).withColumn("next", F.last(F.when(F.col("side") == 0, F.col("x")), True).over(after))
    steps = [shared_table(both.where("side = 1").select("k", F.col("source").alias("at"), F.coalesce("next", "else").alias("next")).where("next is not null"), "steps")]
    while steps[-1].limit(1).count():
        on = steps[-1].select("k", F.col("at").alias("next"), F.col("next").alias("then"))
        steps.append(shared_table(steps[-1].join(on, ["k", "next"]).select("k", "at", F.col("then").alias("next")), "steps"))
    chain = times.groupBy("k").agg(F.min("at").alias("at"))
    for step in reversed(steps[:-1]):
        chain = shared_table(chain.unionByName(chain.join(step, ["k", "at"]).select("k", F.col("next").alias("at"))), "chain")
    entered = chain.select("k", F.floor(F.col("at") / (gap * gaps)).alias("block"), F.col("at").alias("entry"))
    alerts = times.join(entered, ["k", "block"]).groupBy("k", "block").applyInPandas(passing, f"k {kind}, at long")
    return alerts.select(F.col("k").alias(key), F.timestamp_micros("at").alias("ts"))


def merge_batches(events: DataFrame, path: str, keys: list[str], checkpoint: str, parts: int = 64):
    """Keyed upsert of a stream into Parquet, in parts by a hash of the keys: a batch rewrites the parts it has rows of.

    Each part is a folder of versions, p=<part>/v=<batch>; a batch writes its version of a part and then drops older ones
    but the last, so a batch that is run again finds what it read. Returns the started query; read_merged() reads.
    """
    from ridgeline.operators.entity import upsert
    from ridgeline.operators.ranks import first_by

    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("_p")

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = first_by(batch, keys, [F.col("ts").desc()]).persist()
        touched = [r["_p"] for r in new.select(part).distinct().collect()]  # at most `parts`
        old = _versions(spark, path, touched, n)
        rows = new if not old else upsert(spark.read.schema(batch.schema).parquet(*old.values()), new, keys)
        if touched:
            _clear(spark, path, touched, n)
            rows.withColumn("_p", part).withColumn("_v", F.lit(n)).repartition("_p").write.partitionBy("_p", "_v").mode("append").parquet(path)
        _drop_before(spark, path, old)
        new.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The versions of a part's folder, ascending."""
    files, at = _folder(spark, path)
    return sorted(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(at) if f.getPath().getName().startswith("_v=")) if files.exists(at) else []


def _versions(spark: SparkSession, path: str, touched: list[int], n: int) -> dict[int, str]:
    """The newest folder before batch n of each part that has one."""
    found = {p: [v for v in _numbers(spark, f"{path}/_p={p}") if v < n] for p in touched}
    return {p: f"{path}/_p={p}/_v={vs[-1]}" for p, vs in found.items() if vs}


def _clear(spark: SparkSession, path: str, touched: list[int], n: int) -> None:
    """What a batch that broke off has left."""
    for p in touched:
        files, at = _folder(spark, f"{path}/_p={p}/_v={n}")
        files.delete(at, True)


def _drop_before(spark: SparkSession, path: str, read: dict[int, str]) -> None:
    for p, newest in read.items():
        for v in _numbers(spark, f"{path}/_p={p}"):
            if v < int(newest.rsplit("=", 1)[1]):
                files, at = _folder(spark, f"{path}/_p={p}/_v={v}")
                files.delete(at, True)


def read_merged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version of each part."""
    files, at = _folder(spark, path)
    parts = [int(f.getPath().getName().split("=")[1]) for f in files.listStatus(at) if f.getPath().getName().startswith("_p=")] if files.exists(at) else []
    found = [f"{path}/_p={p}/_v={vs[-1]}" for p in parts if (vs := _numbers(spark, f"{path}/_p={p}"))]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
