"""Live queries and guards on streams.

The change feed is a Parquet folder of change rows (``_op``, the table's columns and
``commit_ts``), or of the channels that commits concern. A subscription keeps the last
result of a range or row per caller's rule and sends the difference after each
micro-batch that concerns it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lattica.functions import ids
from lattica.operators import changes, reads
from lattica.sources.shared import discard, staged

Send = Callable[[str, DataFrame], None]


def change_feed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def concerned(batch: DataFrame, channel_col: str, watched: DataFrame, *, ts: str, seconds: int = 120) -> DataFrame:
    """Distinct watched channels of a batch, without notices older than the limit."""
    fresh = changes.drop_stale(batch, ts, F.current_timestamp(), seconds)
    return fresh.select(channel_col).distinct().join(watched, channel_col, "left_semi")


def append_feed(rows: DataFrame, path: str) -> None:
    """Add a commit's change rows or channels to a feed, stamped with the time of the write."""
    rows.withColumn("commit_ts", F.current_timestamp()).write.mode("append").parquet(path)


def purge_feed(feed: DataFrame, ts: str = "commit_ts", seconds: int = 3600) -> DataFrame:
    """What stays of a feed of notices: those of the last hour."""
    return changes.drop_stale(feed, ts, F.current_timestamp(), seconds)


class Subscription:
    """A live query: ``query`` reads the current snapshot, limited and secured.

    Row security is part of the query, so a row that becomes visible or hidden is an
    insert or delete. The last result is a table in the shared folder, of any size.
    ``channels`` are those that concern it (an index, or a row); without any, every one does.
    """

    def __init__(self, name: str, query: Callable[[], DataFrame], id_col: str = "id", channels: Iterable[str] = ()):
        self.name, self.query, self.id_col, self.channels = name, query, id_col, frozenset(channels)
        self.streams: list[tuple[str, object, Callable[[DataFrame], None]]] = []
        self.last = staged(query(), "live")
        self.sent: DataFrame | None = None

    def refresh(self) -> DataFrame:
        """The difference to the last result: _op and the row, without its version. It can
        be read until the next refresh."""
        before, self.last = self.last, staged(self.query(), "live")
        delta = staged(changes.delta(before, self.last, id_col=self.id_col).drop("_version"), "delta")
        discard(before)
        if self.sent is not None:
            discard(self.sent)
        self.sent = delta
        for op, row, call in self.streams:
            rows = delta.where(F.col("_op") == op) if op else delta.where(F.col(self.id_col) == row)
            if not rows.isEmpty():
                call(rows)
        return delta

    def close(self) -> None:
        """Drop what the subscription keeps."""
        discard(self.last)
        if self.sent is not None:
            discard(self.sent)

    def on_add(self, call: Callable[[DataFrame], None]) -> None:
        """Rows present now, then rows that come in."""
        call(self.last.drop("_version"))
        self.streams.append(("insert", None, call))

    def on_remove(self, call: Callable[[DataFrame], None]) -> None:
        """Ids of rows that leave the result."""
        self.streams.append(("delete", None, lambda rows: call(rows.select(self.id_col))))

    def on_row(self, row_id: object, call: Callable[[DataFrame], None]) -> None:
        """Changes of one row, the last of which is its delete."""
        self.streams.append(("", row_id, call))


def row_subscription(table: Callable[[], DataFrame], name: str, column: str, value: object, visible: Callable[[DataFrame], DataFrame], id_col: str = "id") -> Subscription | None:
    """A live query of the first row of an equality; None if there is none to be seen."""
    found = visible(reads.get_row(table(), column, value, id_col=id_col)).select(id_col).first()
    if not found:
        return None
    row_id = found[0]
    query = lambda: visible(table().where(F.col(id_col) == row_id))
    return Subscription(ids.subscription_id(name, id_col, row_id, None, 1), query, id_col, [f"{name}:id:{row_id}"])


class Broker:
    """Subscriptions by name; the same query twice is one subscription."""

    def __init__(self) -> None:
        self.subscriptions: dict[str, Subscription] = {}
        self.users: dict[str, int] = {}

    def subscribe(self, name: str, query: Callable[[], DataFrame], id_col: str = "id", channels: Iterable[str] = ()) -> Subscription:
        if name not in self.subscriptions:
            self.subscriptions[name] = Subscription(name, query, id_col, channels)
        return self.add(self.subscriptions[name])

    def add(self, subscription: Subscription) -> Subscription:
        """One more user of a subscription made elsewhere; a known name keeps the known one."""
        name = subscription.name
        self.users[name] = self.users.get(name, 0) + 1
        return self.subscriptions.setdefault(name, subscription)

    def unsubscribe(self, name: str) -> None:
        self.users[name] -= 1
        if not self.users[name]:
            self.subscriptions.pop(name).close()
            del self.users[name]

    def count(self) -> int:
        return len(self.subscriptions)

    def touched(self, batch: DataFrame, channel_col: str, ts: str, seconds: int) -> list[Subscription]:
        """The subscriptions that fresh notices of a batch concern."""
        watched = sorted({c for s in self.subscriptions.values() for c in s.channels})
        known = batch.sparkSession.createDataFrame([(c,) for c in watched], f"`{channel_col}` string")
        hit = {r[0] for r in concerned(batch, channel_col, known, ts=ts, seconds=seconds).collect()} if watched else set()
        any_fresh = not changes.drop_stale(batch, ts, F.current_timestamp(), seconds).isEmpty()
        return [s for s in self.subscriptions.values() if (s.channels & hit if s.channels else any_fresh)]

    def run(self, feed: DataFrame, send: Send, checkpoint: str, trigger: dict | None = None, channel_col: str | None = None, ts: str = "commit_ts", seconds: int = 120) -> StreamingQuery:
        """Send the difference of each subscription that a batch of the feed concerns.

        With ``channel_col`` the feed holds notices: those older than ``seconds`` are
        dropped, as one batch that has fallen behind gives the newest state anyway.
        """

        def each(batch: DataFrame, _: int) -> None:
            if batch.isEmpty():
                return
            found = self.touched(batch, channel_col, ts, seconds) if channel_col else list(self.subscriptions.values())
            for subscription in found:
                delta = subscription.refresh()
                if not delta.isEmpty():
                    send(subscription.name, delta)

        return feed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "100 milliseconds"})).start()


class RateLimiter(StatefulProcessor):
    """The batch rate limit on a stream: start and count of a key's window are its state."""

    OUTPUT = T.StructType([T.StructField("key", T.StringType()), T.StructField("call_id", T.LongType()), T.StructField("allowed", T.BooleanType())])

    def __init__(self, times: int, per_micros: int):
        self.times, self.per = times, per_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start long, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, used = self.window.get() if self.window.exists() else (None, 0)
        for frame in rows:
            out = []
            for t in frame["t"].tolist():
                if start is None or t - start > self.per:
                    start, used = t, 0
                used += 1
                if used > self.times:
                    start = t
                out.append(used <= self.times)
            yield pd.DataFrame({"key": key[0], "call_id": frame["call_id"], "allowed": out})
        if start is not None:
            self.window.update((start, used))

    def close(self) -> None:
        pass


def limited_calls(calls: DataFrame, times: int, per_micros: int) -> DataFrame:
    """(key, call_id, allowed) of a stream of (key, t in microseconds, call_id) in time order."""
    return calls.groupBy("key").transformWithStateInPandas(RateLimiter(times, per_micros), RateLimiter.OUTPUT, "Append", "None")


def daily_totals(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Count and sum per type and day, closed once the watermark has passed."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
