import pandas as pd
from pyspark.sql import functions as F

from lattica.operators import reads, security
from lattica.streaming import live


def test_range_subscription_sends_deltas(spark, tmp_path):
    table, feed = f"{tmp_path}/table", f"{tmp_path}/feed"
    schema = "id long, owner long, v long, _version int"
    save = lambda rows: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(table)
    save([(1, 10, 5, 1), (2, 10, 6, 1), (3, 11, 7, 1)])

    def query():
        spark.catalog.refreshByPath(table)
        rows = reads.range_rows(spark.read.schema(schema).parquet(table), "v", 0, 100, id_col="id")
        return security.secured(rows, security.OWNER_RULE, security.Caller(10))

    broker, sent = live.Broker(), []
    first = broker.subscribe("q", query)
    assert broker.subscribe("q", query) is first and broker.count() == 1
    save([(1, 10, 50, 2), (3, 10, 7, 2), (4, 12, 1, 1)])
    spark.createDataFrame([(1, "update")], "id long, _op string").write.parquet(feed)
    stream = live.change_feed(spark, feed, spark.read.parquet(feed).schema)
    run = broker.run(stream, lambda name, delta: sent.append((name, {r.id: (r._op, r.v) for r in delta.collect()})), f"{tmp_path}/check", {"availableNow": True})
    run.awaitTermination(120)
    assert sent == [("q", {1: ("update", 50), 2: ("delete", None), 3: ("insert", 7)})]
    broker.unsubscribe("q")
    broker.unsubscribe("q")
    assert broker.count() == 0


def test_broker_refreshes_what_a_batch_concerns(spark, tmp_path):
    """Row and range subscriptions by channel; fresh notices only; streams of added, removed and changed rows."""
    table, feed = f"{tmp_path}/table", f"{tmp_path}/feed"
    schema = "id long, owner long, v long, _version int"
    save = lambda rows: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(table)
    save([(1, 10, 5, 1), (2, 10, 6, 1), (3, 11, 7, 1)])

    def rows():
        spark.catalog.refreshByPath(table)
        return spark.read.schema(schema).parquet(table)

    visible = lambda df: security.secured(df, security.OWNER_RULE, security.Caller(10))
    broker, sent, seen = live.Broker(), [], []
    one = broker.add(live.row_subscription(rows, "T", "v", 6, visible))
    assert one.name == "T.id[2:None:1]:1" and live.row_subscription(rows, "T", "v", 7, visible) is None
    ranged = broker.subscribe("range", lambda: visible(reads.range_rows(rows(), "v", 0, 100, id_col="id", limit=-1)), channels=["T:index:v"])
    other = broker.subscribe("other", lambda: rows(), channels=["T:index:owner"])
    ranged.on_add(lambda df: seen.append(("add", sorted(r.id for r in df.collect()))))
    ranged.on_remove(lambda df: seen.append(("remove", sorted(r.id for r in df.collect()))))
    ranged.on_row(1, lambda df: seen.append(("row", [(r._op, r.v) for r in df.collect()])))
    save([(1, 10, 50, 2), (2, 11, 6, 2), (4, 10, 1, 1)])
    notices = spark.createDataFrame([("T:index:v",), ("T:id:2",), ("T:id:9",)], "channel string")
    live.append_feed(notices, feed)
    old = spark.createDataFrame([("T:index:owner",)], "channel string").withColumn("commit_ts", F.current_timestamp() - F.expr("INTERVAL 10 MINUTES"))
    old.write.mode("append").parquet(feed)
    stream = live.change_feed(spark, feed, spark.read.parquet(feed).schema)
    run = broker.run(stream, lambda name, delta: sent.append((name, {r.id: (r._op, r.v) for r in delta.collect()})), f"{tmp_path}/check", {"availableNow": True}, channel_col="channel")
    run.awaitTermination(120)
    assert sorted(sent) == [("T.id[2:None:1]:1", {2: ("delete", None)}), ("range", {1: ("update", 50), 2: ("delete", None), 4: ("insert", 1)})]
    assert seen == [("add", [1, 2]), ("add", [4]), ("remove", [2]), ("row", [("update", 50)])] and other.last.count() == 3
    assert live.purge_feed(spark.read.parquet(feed)).count() == 4 and live.purge_feed(spark.read.parquet(feed), seconds=300).count() == 3


def test_old_notices_are_dropped(spark):
    batch = spark.range(3).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("channel"), (F.current_timestamp() - F.make_dt_interval(secs=F.col("id") * 100)).alias("ts"))
    watched = spark.createDataFrame([("c0",), ("c2",)], "channel string")
    assert [r.channel for r in live.concerned(batch, "channel", watched, ts="ts").collect()] == ["c0"]


def test_stream_rate_limit(spark, tmp_path):
    pdf = pd.DataFrame({"key": ["u"] * 5, "t": [x * 1_000_000 for x in (1000, 1000, 1005, 1011, 1022)], "call_id": range(5)})
    spark.createDataFrame(pdf, "key string, t long, call_id long").coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    calls = live.change_feed(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    q = live.limited_calls(calls, 2, 10_000_000).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.call_id: r.allowed for r in spark.table("limited").collect()} == {0: True, 1: True, 2: False, 3: False, 4: True}


def test_daily_totals(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = live.daily_totals(live.change_feed(spark, f"{tmp_path}/in", events.schema))
    q = stream.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("daily").agg(F.sum("n")).first()[0] == events.count()
