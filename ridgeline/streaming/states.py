"""Sessions and visitors as typed state: each visitor's open sessions and last values, kept by transformWithState.

A session is open until the watermark has passed its last event by the gap; a timer then closes it. Events may come
late and in any order within the watermark: they begin, widen or join open sessions. Repeated events count once while
the watermark remembers them. State lives in RocksDB (use_rocksdb()), a few numbers and texts for each open session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LATE = "1 day"
SESSION = "visitor_id {id}, started_at timestamp, last_seen_at timestamp, events long, views long, entry_path string, exit_path string, is_admin boolean"
VISITOR = "visitor_id {id}, first_seen_at timestamp, last_seen_at timestamp, events long, views long, last_event string, last_path string, is_admin boolean, was_admin boolean, version long"

#: Columns that the streams read.
EVENT = ("event_id", "ts", "visitor_id", "event_name", "path", "is_admin")


def use_rocksdb(spark: SparkSession) -> None:
    """transformWithState needs this state store; it holds for the streams that are started after."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def joined(a: tuple, b: tuple) -> tuple:
    """Two spans of one session as one: first, its event, last, its event, events, views, entry, exit, admin."""
    (one, other), (begun, ended) = sorted((a, b), key=lambda s: s[:2]), max((a, b), key=lambda s: s[2:4])[2:4]
    entry, exit_ = one[6], max((a, b), key=lambda s: s[2:4])[7]
    return (*one[:2], begun, ended, a[4] + b[4], a[5] + b[5], entry, exit_, a[8] or b[8])


def merged(spans: list[tuple], gap: int) -> list[tuple]:
    """Spans in order of their start, those not further apart than the gap as one."""
    out: list[tuple] = []
    for s in sorted(spans, key=lambda s: s[:2]):
        if out and s[0] - out[-1][2] <= gap:
            out[-1] = joined(out[-1], s)
        else:
            out.append(s)
    return out


def spans_of(rows: pd.DataFrame) -> list[tuple]:
    """A span for each event."""
    at = rows["ts"].astype("int64") // (1000 if str(rows["ts"].dtype).startswith("datetime64[ns") else 1)
    return [(t, i, t, i, 1, int(name == "view"), path, path, bool(admin)) for t, i, name, path, admin in zip(at.tolist(), rows["event_id"].tolist(), rows["event_name"], rows["path"], rows["is_admin"].fillna(False), strict=True)]


class Sessions(StatefulProcessor):
    """A visitor's open sessions, closed by timers of event time."""

    def __init__(self, gap_seconds: int) -> None:
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, first_id long, last long, last_id long, events long, views long, entry string, exit string, admin boolean")

    def _due(self, span: tuple) -> int:
        """When no event can widen the span any more, in milliseconds."""
        return (span[2] + self.gap) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = list(self.open.get()) if self.open.exists() else []
        new = [s for batch in rows for s in merged(spans_of(batch), self.gap)]
        after = merged([*map(tuple, before), *new], self.gap)
        for span in before:
            self.handle.deleteTimer(self._due(span))
        for span in after:
            self.handle.registerTimer(self._due(span))
        self.open.put(after)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        every = list(map(tuple, self.open.get())) if self.open.exists() else []
        closed, rest = [s for s in every if self._due(s) <= now], [s for s in every if self._due(s) > now]
        if rest:
            self.open.put(rest)
        else:
            self.open.clear()
        if closed:
            yield pd.DataFrame({"visitor_id": [key[0]] * len(closed), "started_at": pd.to_datetime([s[0] for s in closed], unit="us"), "last_seen_at": pd.to_datetime([s[2] for s in closed], unit="us"), "events": [s[4] for s in closed], "views": [s[5] for s in closed], "entry_path": [s[6] for s in closed], "exit_path": [s[7] for s in closed], "is_admin": [s[8] for s in closed]})

    def close(self) -> None:
        pass


class Visitors(StatefulProcessor):
    """A visitor's first and last sight, counters and last values; was_admin stays once it was true."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("visitor", "first long, last long, last_id long, events long, views long, event string, path string, admin boolean, was_admin boolean, version long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = tuple(self.state.get()) if self.state.exists() else None
        version = (now[-1] if now else 0) + 1
        for batch in rows:
            for (t, i, *_, views, path, _, admin), name in zip(spans_of(batch), batch["event_name"], strict=True):
                if now is None:
                    now = (t, t, i, 1, views, name, path, admin, admin, version)
                    continue
                newer = (t, i) > (now[1], now[2])
                last = (t, i) if newer else now[1:3]
                now = (min(t, now[0]), *last, now[3] + 1, now[4] + views, *((name, path, admin) if newer else now[5:8]), now[8] or admin, version)
        if now is not None:
            self.state.update(now)
            first, last, _, events, views, name, path, admin, was, version = now
            yield pd.DataFrame({"visitor_id": [key[0]], "first_seen_at": pd.to_datetime([first], unit="us"), "last_seen_at": pd.to_datetime([last], unit="us"), "events": [events], "views": [views], "last_event": [name], "last_path": [path], "is_admin": [admin], "was_admin": [was], "version": [version]})

    def close(self) -> None:
        pass


def _once(events: DataFrame, late: str) -> DataFrame:
    """Events with a visitor and a time, repeated ids dropped while the watermark remembers them."""
    rows = events.select(*EVENT).where("visitor_id is not null and ts is not null and event_id is not null")
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def session_states(events: DataFrame, gap_seconds: int = 1800, late: str = LATE) -> DataFrame:
    """Closed sessions in append mode: started_at, last_seen_at, events, views, entry and exit path, sticky admin flag."""
    shape = SESSION.format(id=events.schema["visitor_id"].dataType.simpleString())
    return _once(events, late).groupBy("visitor_id").transformWithStateInPandas(Sessions(gap_seconds), shape, "Append", "EventTime")


def visitor_states(events: DataFrame, late: str = LATE) -> DataFrame:
    """A new version of each visitor that a batch has events of, in append mode; latest() keeps the last."""
    shape = VISITOR.format(id=events.schema["visitor_id"].dataType.simpleString())
    return _once(events, late).groupBy("visitor_id").transformWithStateInPandas(Visitors(), shape, "Append", "None")


def latest(versions: DataFrame) -> DataFrame:
    rest = [c for c in versions.columns if c != "visitor_id"]
    return versions.groupBy("visitor_id").agg(F.max_by(F.struct(*rest), "version").alias("v")).select("visitor_id", "v.*").drop("version")


def sessions_of(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """The batch form of session_states(): all sessions, each event once."""
    at = F.struct("ts", "event_id")
    rows = events.where("visitor_id is not null and ts is not null and event_id is not null").dropDuplicates(["event_id"])
    found = rows.groupBy("visitor_id", F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("events"), F.count_if(F.col("event_name") == "view").alias("views"),
        F.min_by("path", at).alias("entry_path"), F.max_by("path", at).alias("exit_path"), F.bool_or(F.coalesce("is_admin", F.lit(False))).alias("is_admin"),
    )
    return found.drop("w")


def visitors_of(events: DataFrame) -> DataFrame:
    """The batch form of visitor_states()."""
    at = F.struct("ts", "event_id")
    admin = F.coalesce("is_admin", F.lit(False))
    rows = events.where("visitor_id is not null and ts is not null and event_id is not null").dropDuplicates(["event_id"])
    return rows.groupBy("visitor_id").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("events"), F.count_if(F.col("event_name") == "view").alias("views"), F.max_by("event_name", at).alias("last_event"), F.max_by("path", at).alias("last_path"), F.max_by(admin, at).alias("is_admin"), F.bool_or(admin).alias("was_admin"))
