"""Session and visitor state of streams against their batch forms, with late, shuffled and repeated events."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.streaming import states as s

SHAPE = "event_id long, ts timestamp, visitor_id long, event_name string, path string, is_admin boolean"
KEY = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture()
def stored(spark):
    before = spark.conf.get(KEY)
    s.use_rocksdb(spark)
    yield spark
    spark.conf.set(KEY, before)


def ran(spark, tmp, batches, make, name):
    """What `make` appends, a batch of rows at a time; the stream starts again for each batch and resumes from its checkpoint."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp}/in/{n:02}")
        events = spark.readStream.schema(SHAPE).parquet(f"{tmp}/in/*")
        query = make(events).writeStream.format("parquet").option("path", f"{tmp}/{name}").option("checkpointLocation", f"{tmp}/cp-{name}")
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    return spark.read.parquet(f"{tmp}/{name}")


def events(n=160):
    rng, t0 = random.Random(8), dt.datetime(2026, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=rng.randrange(0, 20 * 3600)), rng.randrange(5), rng.choice(["view", "click"]), f"/{rng.randrange(9)}", rng.choice([True, False, None, False])) for i in range(n)]
    # Spans that only a later event joins, an event at the gap exactly, one just beyond.
    rows += [(900, t0, 77, "view", "/a", False), (901, t0 + dt.timedelta(minutes=60), 77, "view", "/c", True), (903, t0 + dt.timedelta(minutes=90), 77, "click", "/d", False), (904, t0 + dt.timedelta(minutes=120, seconds=1), 77, "click", "/e", False), (902, t0 + dt.timedelta(minutes=30), 77, "click", "/b", None)]
    order = rows[:-1]
    rng.shuffle(order)
    batches = [order[i::3] for i in range(3)]
    batches[2] += [rows[-1], *rng.sample(rows, 25)]  # what joins two spans comes last; repeated events
    end = [(9999, t0 + dt.timedelta(days=9), 99, "view", "/end", False)]
    return [*batches, end], rows


def rowset(df, drop=()):
    return sorted(str({k: v for k, v in r.asDict().items() if k not in drop}) for r in df.collect())


def test_sessions_close_by_timer_and_equal_the_batch(stored, tmp_path):
    batches, rows = events()
    early = ran(stored, tmp_path, batches[:3], s.session_states, "sessions").count()
    assert early == 0  # nothing closes while the watermark lets events come
    stored.createDataFrame(batches[3], SHAPE).write.parquet(f"{tmp_path}/in/09")
    stream = s.session_states(stored.readStream.schema(SHAPE).parquet(f"{tmp_path}/in/*")).writeStream.format("parquet").option("path", f"{tmp_path}/sessions").option("checkpointLocation", f"{tmp_path}/cp-sessions")
    stream.outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    got = stored.read.parquet(f"{tmp_path}/sessions")
    want = s.sessions_of(stored.createDataFrame(rows, SHAPE))
    assert rowset(got) == rowset(want.select(got.columns))
    mine = got.where("visitor_id = 77").orderBy("started_at").collect()
    assert [(r["events"], r["entry_path"], r["exit_path"], r["is_admin"]) for r in mine] == [(4, "/a", "/d", True), (1, "/e", "/e", False)]


def test_visitors_keep_last_values(stored, tmp_path):
    batches, rows = events()
    versions = ran(stored, tmp_path, batches[:3], s.visitor_states, "visitors")
    assert versions.groupBy("visitor_id").count().where(F.col("count") > 1).count() > 0
    want = s.visitors_of(stored.createDataFrame(rows, SHAPE))
    got = s.latest(versions)
    assert rowset(got) == rowset(want.select(got.columns))
