"""Streams over files against their batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.plans.visitors import sessions
from ridgeline.streaming import visitors as v

SCHEMA = "event_id long, ts timestamp, visitor_id long, event_name string, k int"


@pytest.fixture()
def folder(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=m), i % 3, "view" if i % 2 else "error", 0) for i, m in enumerate([0, 5, 8, 30, 36, 100, 131, 200, 5000])]
    for n in range(3):
        spark.createDataFrame(rows[n * 3 : n * 3 + 3], SCHEMA).write.parquet(f"{tmp_path}/in/p{n}")
    return tmp_path


def ran(stream, mode, tmp, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def source(spark, tmp):
    return v.read_events(spark, f"{tmp}/in/*", SCHEMA)


def test_sessions(spark, folder):
    got = {tuple(r) for r in ran(v.session_stream(source(spark, folder)), "append", folder, "s1").collect()}
    want = {tuple(r) for r in sessions(spark.read.parquet(f"{folder}/in/*")).collect()}
    assert got <= want and len(want - got) == 1  # the last session is still open


def test_sessions_gap_is_inclusive(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [(i, t + dt.timedelta(seconds=s), 1, "view", 0) for i, s in enumerate([0, 1800, 3601])]
    assert sorted(r["events"] for r in sessions(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 2]


def test_visitors_and_throttle(spark, folder):
    got = {r["visitor_id"]: r["events"] for r in ran(v.visitor_stream(source(spark, folder)), "complete", folder, "s2").collect()}
    assert got == {0: 3, 1: 3, 2: 3}
    assert ran(v.new_visitors(source(spark, folder)), "append", folder, "s4").count() == 3
    errors = spark.read.parquet(f"{folder}/in/*").where("event_name = 'error'")
    batch = {(r["event_name"], r["ts"]) for r in v.throttled(errors, "event_name", 3600).collect()}
    stream = {tuple(r) for r in ran(v.throttle_stream(source(spark, folder).where(F.col("event_name") == "error"), "event_name", 3600), "append", folder, "s3").collect()}
    assert batch == stream and len(batch) == 3


def test_merge(spark, folder):
    v.merge_batches(source(spark, folder), f"{folder}/out", ["visitor_id"], f"{folder}/cp", parts=2).awaitTermination(120)
    read = lambda: sorted(r["event_id"] for r in v.read_merged(spark, f"{folder}/out", SCHEMA).collect())
    assert read() == [6, 7, 8]
    late = [(20, dt.datetime(2026, 2, 1), 1, "view", 0), (21, dt.datetime(2026, 2, 2), 9, "view", 0)]
    spark.createDataFrame(late, SCHEMA).write.parquet(f"{folder}/in/p9")
    v.merge_batches(source(spark, folder), f"{folder}/out", ["visitor_id"], f"{folder}/cp", parts=2).awaitTermination(120)
    assert read() == [6, 8, 20, 21]


def test_new_visitor_is_new_once(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    rows = [(i, t + dt.timedelta(days=d), 1, "view", 0) for i, d in enumerate([0, 1, 40])]
    for n, r in enumerate(rows):
        spark.createDataFrame([r], SCHEMA).write.parquet(f"{tmp_path}/in/p{n}")
        new = v.new_visitors(source(spark, tmp_path)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        new.outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        assert spark.read.parquet(f"{tmp_path}/out").count() == 1


@pytest.mark.parametrize(("span", "n", "gaps"), [(3_000, 400, 2), (200_000, 300, 16), (50_000, 2_000, 3), (10, 50, 16)])
def test_throttle_in_blocks_equals_the_fold(spark, span, n, gaps):
    rng, t0 = random.Random(span), dt.datetime(2026, 1, 1)
    rows = [(rng.choice(["a", "b"]) if i % 7 else "c", t0 + dt.timedelta(seconds=rng.randrange(span) + (span * 9 if rng.random() < 0.1 else 0))) for i in range(n)] + [("d", t0), ("d", t0), (None, t0), ("a", None)]
    want = set()
    for k in "abcd":
        last = None
        for t in sorted({t for x, t in rows if x == k and t}):
            if last is None or (t - last).total_seconds() >= 100:
                want.add((k, t))
                last = t
    got = [tuple(r) for r in v.throttled(spark.createDataFrame(rows, "name string, ts timestamp"), "name", 100, gaps).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_throttle_of_one_key_is_dealt_out(spark):
    rows = spark.range(200_000).select(F.lit("k").alias("name"), F.timestamp_micros(F.col("id") * 7_000_000).alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plan = v.throttled(rows, "name", 3600).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(plan) == 8 and sum(r["count"] for r in plan) == 200_000 * 7 // 3605 + 1  # every 515th event passes


def test_rolling_counts(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=m), 1, name, 0) for i, (m, name) in enumerate([(0, "view"), (5, "view"), (9, "error"), (15, "view"), (75, "view"), (60 * 48, "view")])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in/p0")
    stream = v.rolling_counts(source(spark, tmp_path))
    got = {(r["window"]["start"], r["event_name"]): r["n"] for r in ran(stream, "append", tmp_path, "rolling").collect()}
    batch = v.rolling_counts(spark.read.parquet(f"{tmp_path}/in/*")).where(F.col("window.end") <= F.lit(t0 + dt.timedelta(days=1)))
    assert got == {(r["window"]["start"], r["event_name"]): r["n"] for r in batch.collect()}
    assert got[(t0, "view")] == 3 and got[(t0 - dt.timedelta(minutes=50), "view")] == 2 and got[(t0, "error")] == 1
