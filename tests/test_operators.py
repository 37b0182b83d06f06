"""The contracts of reads, changes, guards and schemas on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import ids
from lattica.operators import changes, clusters, guards, migrate, reads, schedule, security, stats
from lattica.sources.schema import Column, Table, normal_type, status
from lattica.sources.tables import conform, new_rows

ITEM = Table("Item", {"owner": Column("int64", 0, index=True), "model": Column("float32", 0.0, index=True), "qty": Column("int16", 1), "level": Column("int8", 1), "time": Column("int64", 0, unique=True), "name": Column("U8", "", unique=True), "used": Column("bool", False)}, "OWNER")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, f"Itm{i + 10}", 10, 110 + i, 999, float(i) * 0.1) for i in range(25)]
    return conform(spark.createDataFrame(rows, "id long, name string, owner long, time long, qty int, model double"), ITEM).cache()


def times(df):
    return [r.time for r in df.collect()]


@pytest.mark.parametrize(
    ("left", "right", "want"),
    [(110, 115, range(110, 116)), ("[110", "(115", range(110, 115)), ("(110", "[115", range(111, 116)), ("(110", "(115", range(111, 115)), (float("-inf"), 115, range(110, 116)), (120, float("inf"), range(120, 130)), ("-inf", "inf", range(110, 120))],
)
def test_range_bounds(items, left, right, want):
    assert times(reads.range_rows(items, "time", left, right, id_col="id")) == list(want)


def test_range_order_and_limit(items):
    assert times(reads.range_rows(items, "time", 110, 115, id_col="id", desc=True)) == [115, 114, 113, 112, 111, 110]
    assert times(reads.range_rows(items, "time", "(110", "[115", id_col="id", desc=True)) == [115, 114, 113, 112, 111]
    assert [reads.range_rows(items, "owner", 10, id_col="id", limit=n).count() for n in (10, 30, 8, -1)] == [10, 25, 8, 25]
    assert times(reads.range_rows(items, "model", 1.1, 2.3, id_col="id", limit=99)) == list(range(121, 134))
    assert times(reads.range_rows(items, "name", "Itm11", "Itm12", id_col="id")) == [111, 112]


def test_range_errors(items):
    for column, left, right in (("time", 115, 110), ("name", 11, 12)):
        with pytest.raises(ValueError):
            reads.range_rows(items, column, left, right, id_col="id")
    with pytest.raises(ValueError):
        reads.range_rows(items, "qty", 1, 2, id_col="id", indexed=["time"])


def test_string_prefixes(spark):
    df = spark.createDataFrame(list(enumerate(["a", "a0", "a9", "ab", "boss", "boss:1", "boss:99", "bossX", "(x"])), "id long, name string")
    names = lambda *a, **k: [r.name for r in reads.range_rows(df, "name", *a, id_col="id", **k).collect()]
    assert names("a", "ab") == ["a", "a0", "a9", "ab"]
    assert names("a", "ab", desc=True) == ["ab", "a9", "a0", "a"]
    assert names("boss") == ["boss"]
    assert names("[(x") == ["(x"]


def test_random_ranges_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(-50, 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v int").cache()
    for _ in range(12):
        low, high = sorted(rng.sample(range(-60, 60), 2))
        a, b, desc, limit = rng.choice("(["), rng.choice("(["), rng.random() < 0.5, rng.choice([-1, 0, 5, 40])
        want = sorted(((v, i) for i, v in rows if (v > low if a == "(" else v >= low) and (v < high if b == "(" else v <= high)), reverse=desc)
        got = reads.range_rows(df, "v", f"{a}{low}", f"{b}{high}", id_col="id", desc=desc, limit=limit).collect()
        got = [(r.v, r.id) for r in got]
        assert got == (want if limit < 0 else want[:limit])


def test_range_reaches_the_scan(spark, items, tmp_path):
    items.write.parquet(f"{tmp_path}/t")
    df = reads.range_rows(spark.read.parquet(f"{tmp_path}/t"), "model", 1.1, 2.3, id_col="id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(model" in plan and "TakeOrderedAndProject" in plan


def test_storage_rules(spark, items):
    assert items.where("name = 'Itm10'").count() == 1
    assert conform(spark.createDataFrame([(1, "reinsert2")], "id long, name string"), ITEM).first().name == "reinsert"
    assert conform(spark.createDataFrame([(1, None)], "id long, name string"), ITEM).first().name == ""
    with pytest.raises(Exception, match="OVERFLOW"):
        conform(spark.createDataFrame([(1, 300)], "id long, level int"), ITEM).collect()


def test_schema(spark):
    assert list(ITEM.columns) == sorted(ITEM.columns) and ITEM.columns["used"].dtype == "int8"
    assert Table.from_json(ITEM.to_json()).version() == ITEM.version()
    assert ITEM.struct()["level"].dataType == T.ByteType() and not ITEM.struct()["level"].nullable
    assert status(None, None, ITEM, 1) == "not_exists"
    assert status(ITEM.to_json(), 2, ITEM, 1) == "cluster_mismatch"
    assert status(ITEM.duplicate("x").to_json(), 1, ITEM, 1) == "schema_mismatch"
    assert status(ITEM.to_json(), 1, ITEM, 1) == "ok"
    for bad in ({"class": Column("int8", 0)}, {"id": Column("int64", 0)}):
        with pytest.raises(ValueError):
            Table("Bad", bad)
    for dtype, default in (("int8", 300), ("int8", None), ("void", 0), ("U0", ""), ("int32", "x")):
        with pytest.raises(ValueError):
            Column(dtype, default)
    assert normal_type("?") == "int8"


def test_security(items):
    caller = security.Caller(11, user_data={"friend": 10})
    assert security.secured(items, ("eq", "owner", "friend"), caller).count() == 25
    assert security.secured(items, security.OWNER_RULE, caller).count() == 0
    assert security.secured(items, ("ne", "owner", "missing"), caller).count() == 0
    assert security.secured(items, security.OWNER_RULE, security.Caller(1, True)).count() == 25
    with pytest.raises(ValueError):
        security.rls_predicate(("xor", "owner", "caller"), caller)
    assert [security.may_read(p, security.Caller()) for p in ("EVERYBODY", "USER", "ADMIN", "?")] == [True, False, False, False]


def test_row_rule_over_any_attribute(items):
    """The row's value is compared as the type of the caller's."""
    caller = security.Caller(11, group="110", address="10", user_data={"name": "Itm10", "limit": "12"})
    count = lambda rule: security.secured(items, rule, caller).count()
    assert count(("eq", "time", "group")) == 1 and count(("eq", "owner", "address")) == 25 and count(("eq", "name", "name")) == 1
    assert count(("contains", "time", "limit")) == sum("12" in str(110 + i) for i in range(25))
    assert count(("eq", "name", "caller")) == 0 and count(("eq", "owner", "user_data_x")) == 0


EDIT = "id long, op string, new_v long, v long, _op string"


def test_change_rules(spark):
    """Faulty changes leave their rows alone, whatever the columns are called."""
    snap = spark.createDataFrame([(1, "a", 1, 10, 1), (2, "b", 2, 20, 4), (3, "c", 3, 30, 1)], "id long, op string, new_v long, v long, _version int")
    edits = spark.createDataFrame([(1, "a", 1, 11, "insert"), (4, "d", 4, 40, "insert"), (5, "e", 5, 50, "update"), (2, "b", 2, 20, "update"), (3, "x", 3, 30, "delete"), (6, "f", 6, 6, "delete"), (7, "g", 7, 7, "merge"), (8, "h", 8, 8, "upsert")], EDIT)
    after = sorted(tuple(r) for r in changes.apply_changes(snap, edits, id_col="id").collect())
    assert after == [(1, "a", 1, 10, 1), (2, "b", 2, 20, 4), (4, "d", 4, 40, 1), (8, "h", 8, 8, 1)]
    faults = {(r.id, r.fault) for r in changes.rejected(snap, edits, id_col="id").collect()}
    assert faults == {(1, "exists"), (5, "missing"), (2, "unchanged"), (6, "missing"), (7, "unknown")}


def test_several_changes_of_one_id(spark):
    snap = spark.createDataFrame([(1, 10, 1), (2, 20, 1)], "id long, v long, _version int")
    edits = spark.createDataFrame([(1, 11, "update", 1), (1, 12, "update", 3), (1, 13, "update", 2), (2, 21, "update", 1)], "id long, v long, _op string, seq int")
    assert sorted(tuple(r) for r in changes.apply_changes(snap, edits, id_col="id", order_col="seq").collect()) == [(1, 12, 2), (2, 21, 2)]
    assert sorted(tuple(r) for r in changes.apply_changes(snap, edits, id_col="id").collect()) == [(1, 10, 1), (2, 21, 2)]
    assert [tuple(r) for r in changes.rejected(snap, edits, id_col="id").collect()] == [(1, "update", "repeated")]


def test_upsert_keeps_unchanged_rows_and_ids_of_unique_values(spark):
    snap = spark.createDataFrame([(1, "a", 10, 3), (2, "b", 20, 5)], "id long, name string, v long, _version int")
    rows = spark.createDataFrame([(1, "a", 10), (2, "b", 21), (3, "c", 30)], "id long, name string, v long")
    assert sorted(tuple(r) for r in changes.upsert(snap, rows, id_col="id").collect()) == [(1, "a", 10, 3), (2, "b", 21, 6), (3, "c", 30, 1)]
    rows = spark.createDataFrame([(90, "b", 22), (91, "d", 40)], "id long, name string, v long")
    assert sorted(tuple(r) for r in changes.upsert(snap, rows, id_col="id", on="name").collect()) == [(1, "a", 10, 3), (2, "b", 22, 6), (91, "d", 40, 1)]
    part = spark.createDataFrame([(1, 11), (4, 1)], "id long, v long")
    assert sorted((tuple(r) for r in changes.upsert(snap, part, id_col="id").collect()), key=repr) == [(1, "a", 11, 4), (2, "b", 20, 5), (4, None, 1, 1)]


def test_latest_of_updates(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), (None, 1, "n")], "k string, at long, v string")
    assert sorted(((r.k, r.v) for r in changes.latest([rows.where("at < 2"), rows.where("at >= 2")], "k", "at").collect()), key=repr) == [("a", "y"), ("b", "z"), (None, "n")]


def test_unique_swap_and_conflicts(spark):
    snap = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    swap = spark.createDataFrame([(1, "b", "update"), (2, "a", "update")], "id long, name string, _op string")
    assert changes.unique_conflicts(snap, swap, "name", id_col="id").count() == 0
    clash = spark.createDataFrame([(4, "c", "insert"), (5, "d", "insert"), (6, "d", "insert"), (3, "z", "update")], "id long, name string, _op string")
    assert sorted(r.id for r in changes.unique_conflicts(snap, clash, "name", id_col="id").collect()) == [5, 6]
    kinds = changes.unique_conflicts(snap, spark.createDataFrame([(4, "c", "insert")], "id long, name string, _op string"), "name", id_col="id", observed_absent=spark.createDataFrame([("c",)], "name string"))
    assert [r.kind for r in kinds.collect()] == ["race"]


def test_stale_reads_and_channels(spark):
    read = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, _version int")
    now = spark.createDataFrame([(1, 1), (2, 2)], "id long, _version int")
    assert sorted((r.id, r.now_version) for r in changes.stale_reads(read, now, id_col="id").collect()) == [(2, 2), (3, None)]
    edits = spark.createDataFrame([(1, "update", "x"), (2, "delete", "")], "id long, _op string, changed string")
    assert {r.channel for r in changes.channels(edits.where("id = 1"), "T", ["x", "y"], id_col="id").collect()} == {"T:id:1", "T:index:x"}
    assert {r.channel for r in changes.channels(edits, "T", ["x", "y"], id_col="id").collect()} == {"T:id:1", "T:id:2", "T:index:x", "T:index:y"}


def test_rate_limit_sequence(spark):
    calls = spark.createDataFrame([(i, "u", t) for i, t in enumerate([1000, 1000, 1005, 1011, 1022])], "call_id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = guards.rate_limit(calls, "k", "ts", "call_id", 2, 10_000_000).orderBy("call_id").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True]


def test_flood_counts_start_again(spark):
    """One call on the first day must not hide fifty in a minute a month later."""
    day = 86_400
    seconds = [("a", 0)] + [("a", 30 * day)] + [("a", 30 * day + 1 + i) for i in range(50)] + [("b", i) for i in range(3)] + [(None, 0)]
    calls = spark.createDataFrame(seconds, "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(tuple(r) for r in guards.flood_tiers(calls, "k", "ts", [(2, 60), (40, day)]).collect()) == [("a", 0, 50), ("a", 1, 50), ("b", 0, 3)]
    assert guards.flood_tiers(calls.where("k = 'b'"), "k", "ts", [(2, 2), (3, day)]).count() == 0


def test_pop_one_and_create_calls(spark):
    calls = spark.createDataFrame([(2, 5.0, 60, 0.0), (1, 5.0, 0, 0.0), (3, 10.05, 0, 0.0)], "id long, scheduled double, timeout int, last_run double")
    one = schedule.pop_due(calls, 10.0, limit=1)
    assert sorted((r.id, r.scheduled) for r in one.collect()) == [(2, 5.0), (3, 10.05)]
    assert sorted((r.id, r.scheduled) for r in schedule.pop_due(one, 10.0, limit=2).collect()) == [(2, 70.0)]
    table = spark.createDataFrame([], schedule.CALLS)
    rows = [schedule.call_row(1, 100.0, -10, "pay", 7, "x", [1, 2]), schedule.call_row(2, 100.0, 500.0, "tick", timeout=5, recurring=True, locked=False)]
    stored = schedule.create_calls(table, rows)
    assert sorted((r.id, r.scheduled, r.args) for r in stored.collect()) == [(1, 110.0, '[7, "x", [1, 2]]'), (2, 500.0, "[]")]
    with pytest.raises(Exception, match="a call has id 1"):
        schedule.create_calls(stored, [schedule.call_row(1, 1.0, 2.0, "pay")]).collect()
    for bad in ({"timeout": 3}, {"timeout": 0, "recurring": True}, {"locked": False}):
        with pytest.raises(ValueError):
            schedule.call_row(1, 0.0, 1.0, "s", **bad)
    for args in ((object(),), (float("nan"),), ((1, 2),), ("x" * 1100,)):
        with pytest.raises(ValueError):
            schedule.encode_args(args)


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "skewed"])
def test_percentiles(spark, kind, monkeypatch):
    """Ranks narrowed in several passes equal those of a sort."""
    monkeypatch.setattr(stats, "SLICE_ROWS", 50)
    rng = random.Random(7)
    draw = {"spread": lambda: rng.uniform(-1e6, 1e6), "ties": lambda: float(rng.randrange(5)), "few": lambda: rng.choice([0.0, 1e300, -1e300]), "skewed": lambda: 10 ** rng.uniform(-9, 9)}[kind]
    values = [draw() for _ in range(6000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    got = stats.percentiles(df, "v", [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]).first()
    ordered = sorted(values)
    for name, share in zip(("p0", "p1", "p25", "p50", "p95", "p100"), (0.0, 0.01, 0.25, 0.5, 0.95, 1.0), strict=True):
        at = share * (len(ordered) - 1)
        a, b = ordered[int(at)], ordered[min(int(at) + 1, len(ordered) - 1)]
        assert got[name] == pytest.approx(a + (b - a) * (at % 1), rel=1e-12), name
    assert stats.percentiles(df.where("v IS NULL"), "v", [0.5]).first().p50 is None
    assert stats.percentiles(df.limit(1), "v", [0.25, 0.5]).first().p25 == pytest.approx(values[0])


def test_schedules(spark):
    calls = spark.createDataFrame([(1, 5.0, 0, 0.0), (2, 5.0, 60, 0.0), (3, 50.0, 0, 0.0)], "id long, scheduled double, timeout int, last_run double")
    assert sorted((r.id, r.scheduled, r.last_run) for r in schedule.pop_due(calls, 10.0).collect()) == [(2, 70.0, 10.0), (3, 50.0, 0.0)]
    more = schedule.ensure_calls(calls, spark.createDataFrame([(3, 1.0, 0, 0.0), (4, 2.0, 0, 0.0)], calls.schema))
    assert sorted((r.id, r.scheduled) for r in more.collect()) == [(1, 5.0), (2, 5.0), (3, 50.0), (4, 2.0)]
    assert schedule.cancel_calls(calls, calls.where("id = 1").select("id")).count() == 2


@pytest.mark.parametrize(("old", "new", "safe"), [("float32", "float64", True), ("float32", "int32", False), ("U8", "U4", False), ("U4", "U8", True), ("int16", "int32", True), ("int32", "int16", False), ("uint8", "int16", True), ("int8", "uint8", False), ("int64", "float64", True), ("U4", "S4", False)])
def test_cast_safety(old, new, safe):
    assert migrate.casts_safely(old, new) is safe


def test_migration(spark, items):
    own = {n: c for n, c in ITEM.columns.items() if n not in ("id", "_version")}
    added = Table("Item", {**own, "extra": Column("int16", 111)}, "OWNER")
    assert migrate.plan(ITEM, ITEM) == "skip" and migrate.plan(ITEM, added) == "ok"
    assert migrate.migrate(items, ITEM, added).where("extra = 111").count() == 25
    cut = Table("Item", {**own, "name": Column("U4", "", unique=True), "model": Column("int32", 0)}, "OWNER")
    assert migrate.plan(ITEM, cut) == "unsafe"
    with pytest.raises(ValueError):
        migrate.migrate(items, ITEM, cut)
    rows = migrate.migrate(items, ITEM, cut, force=True)
    assert rows.where("name = 'Itm3'").count() == 5
    with pytest.raises(RuntimeError):
        migrate.check_unique(rows, cut)


def test_clusters(spark):
    uses = spark.createDataFrame([("s1", "c1"), ("s1", "c2"), ("s2", "c1"), ("s3", "c2"), ("s4", "c3"), ("g", "c3"), ("g", "c4")], "system string, tab string")
    got = {r.table: r.cluster for r in clusters.numbered_clusters(uses, "system", "tab").collect()}
    assert got == {"c1": 0, "c2": 0, "c3": 1, "c4": 1}


def test_connected_chains(spark):
    """A long chain, a star and pairs settle to one label each."""
    rng = random.Random(3)
    edges = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(200)] + [("s", f"s{i}") for i in range(40)] + [(f"p{i}", f"q{i}") for i in range(5)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in clusters.connected(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert len(got) == 201 + 41 + 10 and all(got[n] == ("n0000" if n[0] == "n" else "s" if n[0] == "s" else "p" + n[1:]) for n in got)


def test_migration_chain(spark):
    rows = spark.range(3)
    steps = {"a": ("b", lambda df: df.withColumn("x", F.col("id") + 1)), "b": ("c", lambda df: df.withColumn("y", F.col("x") * 2))}
    assert sorted(r.y for r in migrate.run_chain(rows, "a", steps, "c").collect()) == [2, 4, 6] and migrate.run_chain(rows, "c", steps, "c") is rows
    with pytest.raises(ValueError, match="no step"):
        migrate.run_chain(rows, "c", steps, "z")
    with pytest.raises(ValueError, match="return"):
        migrate.run_chain(rows, "a", {"a": ("b", lambda d: d), "b": ("a", lambda d: d)}, "z")


def test_new_ids(spark):
    made = spark.range(0, 20_000, 1, 7).select(ids.new_ids(ids.EPOCH_MS + 5).alias("id"))
    got = [r.id for r in made.collect()]
    assert len(set(got)) == 20_000 and min(got) >= 5 << 22
    rows = new_rows(spark, ITEM, 500, ids.EPOCH_MS + 5).collect()
    assert len({r.id for r in rows}) == 500 and all((r.qty, r.level, r.name, r._version) == (1, 1, "", 0) for r in rows)
    texts = ["", "a", "a\u0000", "ab", "b", "é"]
    hexes = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ids.sortable_hex(F.col("t"), "text").alias("h")).collect()]
    assert hexes == sorted(hexes)


def test_ids(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string").select(ids.key_id("k").alias("i"))
    got = [r.i for r in df.collect()]
    assert got[0] < 0 > got[1] and got[0] != got[1] and got[2] is None
    values = [-1e300, -1.5, -0.0, 0.0, 1e-300, 2.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(ids.sortable_hex(F.col("v"), "double").alias("h"))
    hexes = [r.h for r in df.collect()]
    assert hexes == sorted(hexes)
    ints = [-(2**63), -5, 0, 7, 2**63 - 1]
    hexes = [r.h for r in spark.createDataFrame([(v,) for v in ints], "v long").select(ids.sortable_hex(F.col("v"), "int").alias("h")).collect()]
    assert hexes == sorted(hexes)
    assert ids.subscription_id("Item", "time", 1, 5, 10) == "Item.time[1:5:1]:10"
