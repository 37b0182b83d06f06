"""Queries over the driver's tables, each with the SQL that states what it returns.

A query is registered with its oracle by :func:`query`; the few that SQL cannot state
have none and are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import ids
from lattica.operators import changes, clusters, guards, migrate, reads, schedule, security, stats
from lattica.sources.schema import Column, Table
from lattica.sources.tables import conform, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- point and range reads --------------------------------------------------


@query("SELECT * FROM orders WHERE o_orderkey = 37")
def get_by_id(spark, sf):
    return reads.get_row(load(spark, sf, "orders"), "o_orderkey", 37, id_col="o_orderkey")


@query("SELECT * FROM customer WHERE c_name = 'Customer#000000042' ORDER BY c_custkey LIMIT 1")
def get_by_index(spark, sf):
    return reads.get_row(load(spark, sf, "customer"), "c_name", "Customer#000000042", id_col="c_custkey")


def _orders_range(left, right, **options):
    return lambda spark, sf: reads.range_rows(load(spark, sf, "orders"), "o_totalprice", left, right, id_col="o_orderkey", **options)


@query("SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 ORDER BY o_totalprice, o_orderkey LIMIT 100")
def range_closed(spark, sf):
    return _orders_range(1000, 50000, limit=100)(spark, sf)


@query("SELECT * FROM orders WHERE o_totalprice > 1000 AND o_totalprice < 50000 ORDER BY o_totalprice, o_orderkey LIMIT 100")
def range_open(spark, sf):
    return _orders_range("(1000", "(50000", limit=100)(spark, sf)


@query("SELECT * FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000 ORDER BY o_totalprice, o_orderkey LIMIT 10")
def range_half_open(spark, sf):
    return _orders_range("[1000", "(50000")(spark, sf)


@query("SELECT * FROM orders WHERE o_custkey = 7 ORDER BY o_custkey, o_orderkey LIMIT 10")
def range_eq(spark, sf):
    return reads.range_rows(load(spark, sf, "orders"), "o_custkey", 7, id_col="o_orderkey")


@query("SELECT * FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 25")
def range_inf(spark, sf):
    return reads.range_rows(load(spark, sf, "orders"), "o_orderkey", 100, float("inf"), id_col="o_orderkey", limit=25)


@query("SELECT * FROM customer WHERE c_name >= 'Customer#000000010' AND c_name < 'Customer#000000020' ORDER BY c_name, c_custkey LIMIT 10")
def range_string(spark, sf):
    return reads.range_rows(load(spark, sf, "customer"), "c_name", "[Customer#000000010", "(Customer#000000020", id_col="c_custkey")


@query("SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20")
def range_desc_limit(spark, sf):
    return _orders_range(1000, 50000, limit=20, desc=True)(spark, sf)


@query("SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000")
def range_unlimited(spark, sf):
    return _orders_range(1000, 200000, limit=-1)(spark, sf)


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000")
def range_id_list(spark, sf):
    return reads.id_list(_orders_range(1000, 200000, limit=-1)(spark, sf), "o_orderkey")


@query("SELECT o_orderkey FROM orders")
def all_row_ids(spark, sf):
    return reads.id_list(load(spark, sf, "orders"), "o_orderkey")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part")
def raw_rows(spark, sf):
    return reads.raw_format(load(spark, sf, "part"))


@query("""
    SELECT * FROM (SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 ORDER BY o_totalprice, o_orderkey LIMIT 200)
    WHERE o_orderstatus = 'O' AND o_totalprice < 30000
""")
def compound_filter(spark, sf):
    return _orders_range(1000, 50000, limit=200)(spark, sf).where((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") < 30000))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, sqrt(l_quantity * l_quantity + l_tax * l_tax) AS length FROM lineitem")
def column_arithmetic(spark, sf):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    length = F.sqrt(F.col("l_quantity") * F.col("l_quantity") + F.col("l_tax") * F.col("l_tax"))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", net.alias("net"), length.alias("length"))


# ---- row-level security -----------------------------------------------------


@query("""
    SELECT * FROM (SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 100000 ORDER BY o_totalprice, o_orderkey LIMIT 500) WHERE o_custkey = 7
""")
def rls_owner(spark, sf):
    rows = _orders_range(1000, 100000, limit=500)(spark, sf)
    return security.secured(rows, ("eq", "o_custkey", "caller"), security.Caller(7))


@query("""
    SELECT * FROM (SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 100000 ORDER BY o_totalprice, o_orderkey LIMIT 500) WHERE o_custkey >= 50
""")
def rls_compare(spark, sf):
    rows = _orders_range(1000, 100000, limit=500)(spark, sf)
    return security.secured(rows, ("ge", "o_custkey", "least"), security.Caller(7, user_data={"least": 50}))


@query("SELECT * FROM customer WHERE contains(c_mktsegment, 'BUILD')")
def rls_contains(spark, sf):
    return security.secured(load(spark, sf, "customer"), ("contains", "c_mktsegment", "part"), security.Caller(7, user_data={"part": "BUILD"}))


# ---- statistics -------------------------------------------------------------


@query("""
    SELECT sum(l_quantity) AS total, avg(l_quantity) AS mean, min(l_quantity) AS least, max(l_quantity) AS most,
        stddev_pop(l_quantity) AS deviation, count(l_quantity) AS n FROM lineitem
""")
def stats_column(spark, sf):
    return stats.describe(load(spark, sf, "lineitem"), "l_quantity")


@query("SELECT quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem")
def percentile(spark, sf):
    return stats.percentiles(load(spark, sf, "lineitem"), "l_extendedprice", [0.25, 0.5, 0.95])


@query("SELECT count(*) FILTER (l_discount > 0.05) AS discounted, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem")
def count_where(spark, sf):
    return stats.count_where(load(spark, sf, "lineitem"), discounted=F.col("l_discount") > 0.05, returned=F.col("l_returnflag") == "R")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def grouped_count(spark, sf):
    return stats.grouped_count(load(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf):
    return load(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT max(event_id) AS last_id FROM events")
def last_notice(spark, sf):
    return load(spark, sf, "events").agg(F.max("event_id").alias("last_id"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_check(spark, sf):
    return stats.duplicates(load(spark, sf, "orders"), "o_custkey")


@query("""
    SELECT event_type, avg(value) AS mean, max(value) AS worst, count(*) AS n FROM events WHERE value > 10
    GROUP BY event_type ORDER BY mean DESC, event_type LIMIT 20
""")
def slow_calls(spark, sf):
    return stats.slow_calls(load(spark, sf, "events"), "event_type", "value", 10.0)


@query("""
    SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,6))) OVER w AS DOUBLE) / count(value) OVER w AS running_mean FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def running_average(spark, sf):
    return stats.running_average(load(spark, sf, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "running_mean")


@query("SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def top_n(spark, sf):
    return reads.top_n(load(spark, sf, "part"), "p_retailprice", 25, id_col="p_partkey")


@query("SELECT * FROM part ORDER BY abs(p_retailprice - 1234.5), p_partkey LIMIT 1")
def nearest(spark, sf):
    return reads.nearest(load(spark, sf, "part"), F.abs(F.col("p_retailprice") - 1234.5), id_col="p_partkey")


# ---- joins ------------------------------------------------------------------


@query("SELECT * FROM orders WHERE o_totalprice > 200000 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)")
def semi_join(spark, sf):
    big = load(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return reads.semi_join(load(spark, sf, "orders").where("o_totalprice > 200000"), big, "o_orderkey")


@query("SELECT o_custkey FROM orders WHERE o_totalprice < 50000 INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'")
def key_intersection(spark, sf):
    orders = load(spark, sf, "orders")
    return reads.key_intersection(orders.where("o_totalprice < 50000"), orders.where("o_orderpriority LIKE '1%'"), "o_custkey")


@query("SELECT c.* FROM customer c WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def lookup_join(spark, sf):
    keys = load(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    customer = load(spark, sf, "customer")
    return reads.lookup_join(keys, customer, "c_custkey").select(*customer.columns)


@query("""
    SELECT c.c_custkey, c.c_name, n.n_name, count(o.o_orderkey) AS orders FROM customer c JOIN nation n ON n_nationkey = c_nationkey
    LEFT JOIN orders o ON o_custkey = c_custkey GROUP BY ALL
""")
def entity_join(spark, sf):
    counts = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    customer, nation = load(spark, sf, "customer"), load(spark, sf, "nation")
    joined = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(counts, "c_custkey", "left")
    return joined.select("c_custkey", "c_name", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"))


# ---- changes ----------------------------------------------------------------

_VERSIONED = "SELECT o_orderkey AS id, o_custkey AS owner, o_totalprice AS price, o_orderstatus AS state, CAST(1 + o_orderkey % 3 AS INTEGER) AS _version FROM orders"
_EDITS = """
    SELECT id, owner, price + 1 AS price, state, 'update' AS _op FROM snap WHERE id % 5 = 0
    UNION ALL SELECT id, owner, price, state, 'delete' AS _op FROM snap WHERE id % 7 = 0 AND id % 5 <> 0
    UNION ALL SELECT -id - 1 AS id, owner, price, 'N' AS state, 'insert' AS _op FROM snap WHERE id % 11 = 0
"""


def _snapshot(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("state"), (1 + F.col("o_orderkey") % 3).cast("int").alias("_version"))


def _edits(snap):
    columns = ["id", "owner", "price", "state", "_op"]
    update = snap.where("id % 5 = 0").withColumns({"price": F.col("price") + 1, "_op": F.lit("update")})
    gone = snap.where("id % 7 = 0 AND id % 5 <> 0").withColumn("_op", F.lit("delete"))
    new = snap.where("id % 11 = 0").withColumns({"id": -F.col("id") - 1, "state": F.lit("N"), "_op": F.lit("insert")})
    return update.select(columns).unionByName(gone.select(columns)).unionByName(new.select(columns))


# Edits that break a rule, besides those that do not; ``seq`` orders the edits of an id.
_ALL_EDITS = f"""
    WITH snap AS ({_VERSIONED}), edits AS (
        SELECT *, 1 AS seq FROM ({_EDITS})
        UNION ALL SELECT id, owner, price + 7, state, 'insert', 1 FROM snap WHERE id % 5 <> 0 AND id % 7 <> 0 AND id % 13 = 0
        UNION ALL SELECT -id - 500000000, owner, price, state, CASE WHEN id % 2 = 0 THEN 'update' ELSE 'delete' END, 1 FROM snap WHERE id % 17 = 0
        UNION ALL SELECT id, owner, price, state, 'update', 1 FROM snap WHERE id % 5 <> 0 AND id % 7 <> 0 AND id % 13 <> 0 AND id % 3 = 0
        UNION ALL SELECT id, owner, price + 2, state, 'update', 2 FROM snap WHERE id % 25 = 0),
    last AS (SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
    judged AS (
        SELECT coalesce(s.id, e.id) AS id, s.id IS NOT NULL AS there, s.owner AS s_owner, s.price AS s_price, s.state AS s_state, s._version AS s_version,
            e.owner AS e_owner, e.price AS e_price, e.state AS e_state, e._op AS op,
            CASE WHEN e._op = 'insert' AND s.id IS NOT NULL THEN 'exists' WHEN e._op IN ('update', 'delete') AND s.id IS NULL THEN 'missing'
                WHEN e._op = 'update' AND s.owner = e.owner AND s.price = e.price AND s.state = e.state THEN 'unchanged' END AS fault
        FROM snap s FULL JOIN last e ON s.id = e.id)
"""


def _all_edits(snap):
    columns = ["id", "owner", "price", "state", "_op", "seq"]
    rest = snap.where("id % 5 <> 0 AND id % 7 <> 0")
    add = lambda df, op, seq=1: df.withColumns({"_op": op, "seq": F.lit(seq)}).select(columns)
    parts = [
        add(rest.where("id % 13 = 0").withColumn("price", F.col("price") + 7), F.lit("insert")),
        add(snap.where("id % 17 = 0").withColumn("gone", F.col("id") % 2).withColumn("id", -F.col("id") - 500_000_000), F.when(F.col("gone") == 0, "update").otherwise("delete")),
        add(rest.where("id % 13 <> 0 AND id % 3 = 0"), F.lit("update")),
        add(snap.where("id % 25 = 0").withColumn("price", F.col("price") + 2), F.lit("update"), 2),
    ]
    return reduce(DataFrame.unionByName, parts, _edits(snap).withColumn("seq", F.lit(1)))


@query(f"""{_ALL_EDITS}
    SELECT id, CASE WHEN op IS NULL OR fault IS NOT NULL THEN s_owner ELSE e_owner END AS owner, CASE WHEN op IS NULL OR fault IS NOT NULL THEN s_price ELSE e_price END AS price,
        CASE WHEN op IS NULL OR fault IS NOT NULL THEN s_state ELSE e_state END AS state, CAST(CASE WHEN op IS NULL OR fault IS NOT NULL THEN s_version ELSE coalesce(s_version, 0) + 1 END AS INTEGER) AS _version
    FROM judged WHERE CASE WHEN op IS NULL OR fault IS NOT NULL THEN there ELSE op <> 'delete' END
""")
def commit_batch(spark, sf):
    snap = _snapshot(spark, sf)
    return changes.apply_changes(snap, _all_edits(snap), id_col="id", order_col="seq")


@query(f"{_ALL_EDITS} SELECT id, op, fault FROM judged WHERE fault IS NOT NULL")
def rejected_changes(spark, sf):
    snap = _snapshot(spark, sf)
    return changes.rejected(snap, _all_edits(snap), id_col="id", order_col="seq")


@query(f"""
    WITH snap AS ({_VERSIONED}), rows AS (SELECT id + CASE WHEN id % 2 = 0 THEN 0 ELSE 10000000 END AS id, owner, CASE WHEN id % 3 = 0 THEN price ELSE price * 2 END AS price, state FROM snap WHERE id % 4 < 2)
    SELECT coalesce(s.id, r.id) AS id, coalesce(r.owner, s.owner) AS owner, coalesce(r.price, s.price) AS price, coalesce(r.state, s.state) AS state,
        CAST(CASE WHEN r.id IS NULL OR r.price = s.price THEN _version ELSE coalesce(_version, 0) + 1 END AS INTEGER) AS _version FROM snap s FULL JOIN rows r ON s.id = r.id
""")
def upsert_batch(spark, sf):
    """Unchanged rows are no update: they keep their version."""
    snap = _snapshot(spark, sf)
    key = F.col("id") + F.when(F.col("id") % 2 == 0, 0).otherwise(10_000_000)
    price = F.when(F.col("id") % 3 == 0, F.col("price")).otherwise(F.col("price") * 2)
    rows = snap.where("id % 4 < 2").select(key.alias("id"), "owner", price.alias("price"), "state")
    return changes.upsert(snap, rows, id_col="id")


@query("""
    WITH c AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, CAST(2 AS INTEGER) AS _version FROM customer),
    r AS (SELECT -id - 1 AS id, CASE WHEN id % 3 = 0 THEN 'new' || id ELSE name END AS name, nation + id % 2 AS nation FROM c WHERE id % 5 = 0)
    SELECT coalesce(c.id, r.id) AS id, coalesce(c.name, r.name) AS name, coalesce(r.nation, c.nation) AS nation,
        CAST(CASE WHEN c.id IS NULL THEN 1 WHEN r.nation <> c.nation THEN 3 ELSE 2 END AS INTEGER) AS _version FROM c FULL JOIN r ON c.name = r.name
""")
def upsert_by_unique(spark, sf):
    """Rows found by a unique column keep their id."""
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("nation"), F.lit(2).alias("_version"))
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("new"), F.col("id").cast("string"))).otherwise(F.col("name"))
    rows = c.where("id % 5 = 0").select((-F.col("id") - 1).alias("id"), name.alias("name"), (F.col("nation") + F.col("id") % 2).alias("nation"))
    return changes.upsert(c, rows, id_col="id", on="name")


@query(f"WITH snap AS ({_VERSIONED}) SELECT * FROM snap WHERE owner % 10 <> 3")
def delete_batch(spark, sf):
    snap = _snapshot(spark, sf)
    return changes.delete(snap, snap.where("owner % 10 = 3").select("id"), id_col="id")


@query(f"WITH snap AS ({_VERSIONED}) SELECT id, 'price' AS changed FROM snap WHERE id % 5 = 0")
def changed_columns(spark, sf):
    snap = _snapshot(spark, sf)
    return changes.changed_columns(snap, _edits(snap).where("_op = 'update'").drop("_op"), id_col="id")


@query("""
    WITH c AS (SELECT c_custkey AS id, c_name AS name FROM customer),
    mine AS (SELECT id + 10000000 AS id, name FROM c WHERE id % 50 = 0 UNION ALL SELECT id + 20000000, 'new' || id // 2 FROM c WHERE id % 50 IN (2, 3)),
    n AS (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM mine)
    SELECT id, name AS value, CASE WHEN name IN (SELECT name FROM c WHERE id % 100 = 0) THEN 'race' ELSE 'violation' END AS kind
    FROM n WHERE n > 1 OR name IN (SELECT name FROM c)
""")
def unique_conflicts(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    taken = c.where("id % 50 = 0").select((F.col("id") + 10_000_000).alias("id"), "name")
    twins = c.where("id % 50 IN (2, 3)").select((F.col("id") + 20_000_000).alias("id"), F.concat(F.lit("new"), F.floor(F.col("id") / 2).cast("string")).alias("name"))
    new = taken.union(twins).withColumn("_op", F.lit("insert"))
    return changes.unique_conflicts(c, new, "name", id_col="id", observed_absent=c.where("id % 100 = 0"))


@query(f"""
    WITH snap AS ({_VERSIONED})
    SELECT id, _version AS read_version, CAST(CASE WHEN id % 7 = 0 THEN NULL ELSE _version + 1 END AS INTEGER) AS now_version FROM snap WHERE id % 5 = 0 OR id % 7 = 0
""")
def version_check(spark, sf):
    snap = _snapshot(spark, sf)
    now = snap.where("id % 7 <> 0").withColumn("_version", (F.col("_version") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).cast("int"))
    return changes.stale_reads(snap, now, id_col="id")


def _live(spark, sf):
    """A limited range over a table, before and after edits."""
    snap = _snapshot(spark, sf)
    after = changes.apply_changes(snap, _edits(snap), id_col="id")
    window = lambda df: reads.range_rows(df, "price", 1000, 60000, id_col="id", limit=150)
    return window(snap), window(after)


_LIVE_SQL = f"""
    WITH snap AS ({_VERSIONED}), edits AS ({_EDITS}),
    after AS (SELECT coalesce(s.id, e.id) AS id, CASE WHEN _op IS NULL THEN s.owner ELSE e.owner END AS owner, CASE WHEN _op IS NULL THEN s.price ELSE e.price END AS price,
        CASE WHEN _op IS NULL THEN s.state ELSE e.state END AS state, CAST(CASE WHEN _op IS NULL THEN _version ELSE coalesce(_version, 0) + 1 END AS INTEGER) AS _version
        FROM snap s FULL JOIN edits e ON s.id = e.id WHERE _op IS NULL OR _op <> 'delete'),
    o AS (SELECT * FROM snap WHERE price BETWEEN 1000 AND 60000 ORDER BY price, id LIMIT 150),
    n AS (SELECT * FROM after WHERE price BETWEEN 1000 AND 60000 ORDER BY price, id LIMIT 150)
"""


@query(f"""{_LIVE_SQL}
    SELECT CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS _op, coalesce(o.id, n.id) AS id, n.owner, n.price, n.state
    FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.owner <> n.owner OR o.price <> n.price OR o.state <> n.state OR o._version <> n._version
""")
def live_delta(spark, sf):
    old, new = _live(spark, sf)
    return reads.client_format(changes.delta(old, new, id_col="id"))


@query(f"""{_LIVE_SQL} SELECT id, owner, price, state FROM n""")
def live_view(spark, sf):
    old, new = _live(spark, sf)
    return reads.client_format(changes.fold(old, changes.delta(old, new, id_col="id"), id_col="id"))


@query(f"""{_LIVE_SQL}
    SELECT 'add' AS stream, n.id FROM n WHERE n.id NOT IN (SELECT id FROM o) UNION ALL SELECT 'remove', o.id FROM o WHERE o.id NOT IN (SELECT id FROM n)
    UNION ALL SELECT 'row', n.id FROM n JOIN o USING (id) WHERE o.owner <> n.owner OR o.price <> n.price OR o.state <> n.state OR o._version <> n._version
""")
def live_streams(spark, sf):
    """The add, remove and row streams of a live view after a commit."""
    old, new = _live(spark, sf)
    stream = F.when(F.col("_op") == "insert", "add").when(F.col("_op") == "delete", "remove").otherwise("row")
    return changes.delta(old, new, id_col="id").select(stream.alias("stream"), "id")


@query(f"""{_LIVE_SQL.replace("o AS (SELECT", "o_ AS (SELECT")}
    SELECT e.id, a.owner, a.price, a.state, CASE WHEN a.id IS NULL THEN 'delete' ELSE 'row' END AS _op
    FROM (SELECT DISTINCT id FROM edits) e LEFT JOIN (SELECT * FROM after WHERE owner >= 50) a ON a.id = e.id
""")
def row_updates(spark, sf):
    """Watched rows after a commit, under a row rule: gone and hidden ones are deletes."""
    snap = _snapshot(spark, sf)
    edits = _edits(snap)
    now = security.secured(changes.apply_changes(snap, edits, id_col="id"), ("ge", "owner", "least"), security.Caller(7, user_data={"least": 50}))
    return changes.row_updates(edits, now, id_col="id")


@query(f"""
    WITH snap AS ({_VERSIONED}), edits AS ({_EDITS})
    SELECT 'orders:id:' || id AS channel FROM edits UNION SELECT 'orders:index:price' UNION SELECT 'orders:index:owner'
""")
def commit_channels(spark, sf):
    edits = _edits(_snapshot(spark, sf)).withColumn("changed", F.when(F.col("_op") == "update", "price").otherwise(""))
    return changes.channels(edits, "orders", ["owner", "price"], id_col="id")


@query("SELECT epoch_us(ts) // 100000 AS bucket, user_id, count(*) AS notices FROM events GROUP BY ALL")
def notify_batch(spark, sf):
    return changes.notify_batches(load(spark, sf, "events"), "ts", "user_id")


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def age_drop(spark, sf):
    events = load(spark, sf, "events")
    last = events.agg(F.max("ts")).scalar()
    return changes.drop_stale(events, "ts", last, seconds=172_800).select("event_id", "ts")


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def merge_updates(spark, sf):
    events = load(spark, sf, "events").select("user_id", "event_id", "event_type")
    parts = [events.where("event_id % 2 = 0"), events.where("event_id % 2 <> 0")]
    return changes.latest(parts, "user_id", "event_id")


# ---- guards and schedules ---------------------------------------------------

_RATE = """
    WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL),
    w AS (
        SELECT user_id, n, event_id, t AS start, CAST(1 AS BIGINT) AS used FROM e WHERE n = 1
        UNION ALL
        SELECT e.user_id, e.n, e.event_id,
            CASE WHEN e.t - w.start > {per} THEN e.t WHEN w.used + 1 > {times} THEN e.t ELSE w.start END,
            CASE WHEN e.t - w.start > {per} THEN 1 ELSE w.used + 1 END
        FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
    SELECT event_id AS call_id, used <= {times} AS allowed FROM w
"""
_DAY = 86_400_000_000


@query(_RATE.format(per=_DAY, times=2))
def rate_limit(spark, sf):
    return guards.rate_limit(load(spark, sf, "events"), "user_id", "ts", "event_id", 2, _DAY)


@query("""
    WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    w AS (
        SELECT user_id, n, t, t AS start, CAST(1 AS BIGINT) AS used FROM e WHERE n = 1
        UNION ALL
        SELECT e.user_id, e.n, e.t, CASE WHEN w.t - w.start > 604800000000 THEN w.t ELSE w.start END, CASE WHEN w.t - w.start > 604800000000 THEN 1 ELSE w.used + 1 END
        FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1),
    c AS (SELECT user_id, max(used) FILTER (t - start < 86400000000) AS t0, max(used) FILTER (t - start < 604800000000) AS t1 FROM w GROUP BY user_id)
    SELECT user_id, CAST(0 AS INTEGER) AS tier, t0 AS calls FROM c WHERE t0 > 2 UNION ALL SELECT user_id, 1, t1 FROM c WHERE t1 > 7
""")
def flood_check(spark, sf):
    return guards.flood_tiers(load(spark, sf, "events"), "user_id", "ts", [(2, 86_400), (7, 604_800)])


@query("SELECT o_orderpriority AS address, count(*) FILTER (o_custkey % 10 = 0) AS guests FROM orders GROUP BY ALL HAVING guests > 5")
def guest_limit(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("address"), (F.col("o_custkey") % 10).alias("owner"))
    return guards.guests_per_address(rows, "address", "owner", 5)


@query("SELECT event_id, ts, user_id FROM events WHERE ts <= (SELECT min(ts) + INTERVAL 3 DAY FROM events) ORDER BY ts, event_id LIMIT 10")
def due_calls(spark, sf):
    events = load(spark, sf, "events").select("event_id", "ts", "user_id")
    first = events.agg(F.min("ts")).scalar()
    return schedule.due(events, first + F.expr("INTERVAL 3 DAYS"), at="ts", id_col="event_id", limit=10)


_CALLS = "SELECT event_id AS id, epoch_us(ts) / 1e6 AS scheduled, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 60 END AS INTEGER) AS timeout, CAST(0 AS DOUBLE) AS last_run FROM events"


def _calls(spark, sf):
    return load(spark, sf, "events").select(F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("scheduled"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(60).alias("timeout"), F.lit(0.0).alias("last_run"))


@query(f"""
    WITH c AS ({_CALLS}), first AS (SELECT id AS taken FROM c WHERE scheduled BETWEEN 0 AND 1.705e9 + 0.1 ORDER BY scheduled, id LIMIT 1)
    SELECT id, CASE WHEN taken IS NOT NULL THEN 1.705e9 + timeout ELSE scheduled END AS scheduled, timeout, CASE WHEN taken IS NOT NULL THEN 1.705e9 ELSE last_run END AS last_run
    FROM c LEFT JOIN first ON id = taken WHERE NOT (taken IS NOT NULL AND timeout = 0)
""")
def pop_due_calls(spark, sf):
    """The earliest due call alone is taken."""
    return schedule.pop_due(_calls(spark, sf), 1.705e9, limit=1)


@query(f"""
    WITH c AS ({_CALLS})
    SELECT id, CASE WHEN scheduled <= 1.705e9 + 0.1 THEN 1.705e9 + timeout ELSE scheduled END AS scheduled, timeout, CASE WHEN scheduled <= 1.705e9 + 0.1 THEN 1.705e9 ELSE last_run END AS last_run
    FROM c WHERE NOT (scheduled <= 1.705e9 + 0.1 AND timeout = 0)
""")
def pop_all_due(spark, sf):
    return schedule.pop_due(_calls(spark, sf), 1.705e9)


@query("""
    SELECT event_id, user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events
    WHERE NOT (user_id % 5 = 0)) WHERE n = 1
""")
def idempotent_apply(spark, sf):
    events = load(spark, sf, "events").withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    done = events.where("user_id % 5 = 0").select("key").distinct()
    return schedule.apply_once(events, "key", ["ts", "event_id"], done).select("event_id", "user_id", "event_type", "ts")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'new' FROM supplier WHERE s_suppkey % 2 <> 0 AND s_suppkey % 3 = 0")
def ensure_calls(spark, sf):
    rows = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return schedule.ensure_calls(rows.where("id % 2 = 0"), rows.where("id % 3 = 0").select("id", F.lit("new").alias("name")))


@query(f"WITH c AS ({_CALLS}) SELECT * FROM c WHERE id NOT IN (SELECT event_id FROM events WHERE user_id % 4 = 0)")
def cancel_calls(spark, sf):
    keys = load(spark, sf, "events").where("user_id % 4 = 0").select(F.col("event_id").alias("id"))
    return schedule.cancel_calls(_calls(spark, sf), keys)


@query("""
    SELECT s_suppkey AS id, 'pay' AS system, '[]' AS args, CAST(s_suppkey AS DOUBLE) AS scheduled, CAST(60 AS INTEGER) AS timeout, false AS recurring, CAST(0 AS DOUBLE) AS created, CAST(0 AS DOUBLE) AS last_run FROM supplier
    UNION ALL SELECT -1, 'pay', '[7, "x"]', 110.0, 60, false, 100.0, 0.0
    UNION ALL SELECT -2, 'tick', '[]', 500.0, 5, true, 100.0, 0.0
""")
def create_calls(spark, sf):
    """Two checked calls, one ten seconds from now, join the table."""
    c = lambda v, kind: F.lit(v).cast(kind)
    table = load(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.lit("pay").alias("system"), F.lit("[]").alias("args"), F.col("s_suppkey").cast("double").alias("scheduled"), c(60, "int").alias("timeout"), F.lit(False).alias("recurring"), c(0, "double").alias("created"), c(0, "double").alias("last_run"))
    new = [schedule.call_row(-1, 100.0, -10, "pay", 7, "x"), schedule.call_row(-2, 100.0, 500.0, "tick", timeout=5, recurring=True, locked=False)]
    return schedule.create_calls(table, new)


@query("""
    SELECT event_type, avg(value) AS mean, max(value) AS worst, count(*) AS n FROM events WHERE value > 50 OR user_id % 9 > 5
    GROUP BY event_type ORDER BY mean DESC, event_type LIMIT 20
""")
def slow_or_retried_calls(spark, sf):
    events = load(spark, sf, "events").withColumn("tries", F.col("user_id") % 9)
    return stats.slow_calls(events, "event_type", "value", 50.0, retries="tries")


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def purge_locks(spark, sf):
    events = load(spark, sf, "events").select("event_id", "ts")
    return schedule.purge_locks(events, events.agg(F.max("ts")).scalar(), called="ts")


# ---- schema and functions ---------------------------------------------------

_CUSTOMER = Table("Customer", {"name": Column("U8", ""), "balance": Column("int32", 0), "tag": Column("U4", "none"), "nation": Column("int16", -1)})


@query("""
    SELECT CAST(1 AS INTEGER) AS _version, CAST(trunc(c_acctbal) AS INTEGER) AS balance, c_custkey AS id, substr(c_name, 1, 8) AS name, CAST(c_nationkey AS SMALLINT) AS nation, 'none' AS tag
    FROM customer
""")
def migrate_columns(spark, sf):
    rows = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("_version"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    return conform(rows, _CUSTOMER)


@query("SELECT c_custkey, substr(c_mktsegment, 1, 4) AS segment FROM customer")
def truncate_string(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", ids.fixed_text(F.col("c_mktsegment"), 4).alias("segment"))


@query("""
    WITH i AS (SELECT event_id, ((epoch_us(ts) // 1000 + 100000000000 - 1766000000000) << 22) | ((event_id % 1024) << 12) | (event_id % 4096) AS id FROM events)
    SELECT event_id, id, (id >> 22) + 1766000000000 AS millis, (id >> 12) & 1023 AS worker, id & 4095 AS sequence FROM i
""")
def snowflake_unpack(spark, sf):
    millis = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long") + 100_000_000_000
    packed = load(spark, sf, "events").select("event_id", ids.pack_id(millis, F.col("event_id") % 1024, F.col("event_id") % 4096).alias("id"))
    time, worker, sequence = ids.unpack_id(F.col("id"))
    return packed.select("event_id", "id", time.alias("millis"), worker.alias("worker"), sequence.alias("sequence"))


@query("SELECT o_orderkey, lpad(hex(CAST(o_orderkey - 700 AS HUGEINT) + 9223372036854775808), 16, '0') AS number_key, hex(o_orderpriority) AS text_key FROM orders")
def sortable_keys(spark, sf):
    """Text keys that sort as the numbers and texts do."""
    orders = load(spark, sf, "orders")
    return orders.select("o_orderkey", ids.sortable_hex(F.col("o_orderkey") - 700, "int").alias("number_key"), ids.sortable_hex(F.col("o_orderpriority"), "text").alias("text_key"))


@query("""
    SELECT c_custkey AS id, CAST(3 AS INTEGER) AS _version, substr(c_name, 1, 12) AS name, CAST(trunc(c_acctbal) AS INTEGER) AS balance, CAST(111 AS SMALLINT) AS extra FROM customer
""")
def migrate_forced(spark, sf):
    """A lossy migration: texts are cut, fractions go, a new column gets its default."""
    old = Table("Customer", {"name": Column("U18", ""), "balance": Column("float64", 0.0), "nation": Column("int32", 0)})
    new = Table("Customer", {"name": Column("U12", ""), "balance": Column("int32", 0), "extra": Column("int16", 111)})
    rows = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(3).alias("_version"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    return migrate.migrate(rows, old, new, force=True)


@query("SELECT p_partkey, md5(p_name) AS digest FROM part")
def name_digest(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.md5(F.col("p_name").cast("binary")).alias("digest"))


@query("""
    WITH RECURSIVE uses AS (SELECT DISTINCT 'c' || c_nationkey AS s, 't' || (c_nationkey // 4 * 2 + c_custkey % 2) AS t FROM customer),
    e AS (SELECT s AS a, t AS b FROM uses UNION SELECT t, s FROM uses),
    r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
    SELECT a AS node, min(b) AS component FROM r GROUP BY a
""")
def colocation_clusters(spark, sf):
    group = F.floor(F.col("c_nationkey") / 4) * 2 + F.col("c_custkey") % 2
    uses = load(spark, sf, "customer").select(F.concat(F.lit("c"), "c_nationkey").alias("s"), F.concat(F.lit("t"), group.cast("string")).alias("t"))
    return clusters.connected(uses, "s", "t")


@query("""
    WITH RECURSIVE uses AS (SELECT DISTINCT 'c' || c_nationkey AS s, 't' || (c_nationkey // 4 * 2 + c_custkey % 2) AS t FROM customer),
    r(a, b) AS (SELECT t, t FROM uses UNION SELECT r.a, v.t FROM r JOIN uses u ON u.t = r.b JOIN uses v ON v.s = u.s),
    c AS (SELECT a AS tab, min(b) AS comp FROM r GROUP BY a), f AS (SELECT t AS tab, count(DISTINCT s) AS refs FROM uses GROUP BY t),
    h AS (SELECT comp, arg_min(tab, (-refs, tab)) AS hub FROM c JOIN f USING (tab) GROUP BY comp)
    SELECT tab AS "table", CAST(rank - 1 AS INTEGER) AS cluster FROM c JOIN (SELECT comp, row_number() OVER (ORDER BY hub) AS rank FROM h) USING (comp)
""")
def numbered_clusters(spark, sf):
    """Clusters numbered by the name of their most used table."""
    group = F.floor(F.col("c_nationkey") / 4) * 2 + F.col("c_custkey") % 2
    uses = load(spark, sf, "customer").select(F.concat(F.lit("c"), "c_nationkey").alias("s"), F.concat(F.lit("t"), group.cast("string")).alias("t")).distinct()
    return clusters.numbered_clusters(uses, "s", "t")


@query("""
    WITH p AS (SELECT DISTINCT c_nationkey AS system, c_mktsegment AS tab FROM customer), r AS (SELECT tab, count(*) AS refs FROM p GROUP BY tab)
    SELECT system, arg_min(tab, (-refs, tab)) AS hub, max(refs) AS refs FROM p JOIN r USING (tab) GROUP BY system
""")
def reference_hubs(spark, sf):
    pairs = load(spark, sf, "customer").select(F.col("c_nationkey").alias("system"), F.col("c_mktsegment").alias("tab")).distinct()
    return stats.reference_hubs(pairs, "system", "tab")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def windowed_events(spark, sf):
    day = F.window(F.col("ts").cast("timestamp"), "1 day").getField("start").cast("timestamp_ntz")
    return load(spark, sf, "events").groupBy("event_type", day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
