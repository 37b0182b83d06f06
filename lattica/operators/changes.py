"""Sets of row changes: applying them, checking them, and telling who is concerned.

A change set has the table's columns and ``_op`` (insert, update or delete). A snapshot
has an id column and ``_version``. Everything is a join on keys, so a batch of millions of
changes is one shuffle of each side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Operations of a change set.
OPERATIONS = ("insert", "update", "upsert", "delete")


def judged(snapshot: DataFrame, changes: DataFrame, *, id_col: str, order_col: str | None = None) -> DataFrame:
    """One row per id of either side: id, was, new, op, fault.

    ``was`` and ``new`` are structs of the other columns (null where a side lacks the id),
    so column names never clash. Columns that the changes lack keep their old value. Of
    several changes of one id the last by ``order_col`` counts; without that column none
    does. ``fault`` is null for a change that may be applied, else ``repeated``,
    ``unknown`` (no such operation), ``exists`` (insert of an id that is there),
    ``missing`` (update or delete of one that is not) or ``unchanged`` (update that
    changes nothing; such an upsert is none at all, and its op is null).
    """
    columns = [c for c in snapshot.columns if c != id_col]
    values = F.struct(*[F.col(f"`{c}`") for c in columns if c in changes.columns])
    edit = F.struct(F.col("_op").alias("op"), values.alias("row"))
    last = F.max_by(edit, F.col(f"`{order_col}`")) if order_col else F.any_value(edit)
    per_id = changes.groupBy(F.col(f"`{id_col}`").alias("id")).agg(last.alias("edit"), F.count(F.lit(1)).alias("times"))
    old = snapshot.select(F.col(f"`{id_col}`").alias("id"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("was"))
    joined = old.join(per_id, "id", "full_outer")
    new = F.struct(*[(F.col(f"edit.row.`{c}`") if c in changes.columns else F.col(f"was.`{c}`")).alias(c) for c in columns if c != "_version"])
    before = F.struct(*[F.col(f"was.`{c}`").alias(c) for c in columns if c != "_version"])
    joined = joined.select("id", "was", new.alias("new"), before.alias("before"), F.col("edit.op").alias("op"), "times", F.col("edit").isNotNull().alias("edited"))
    same = F.col("was").isNotNull() & F.col("before").eqNullSafe(F.col("new"))
    fault = (
        F.when(~F.col("edited"), None)
        .when(F.lit(order_col is None) & (F.col("times") > 1), "repeated")
        .when(F.col("op").isNull() | ~F.col("op").isin(*OPERATIONS), "unknown")
        .when((F.col("op") == "insert") & F.col("was").isNotNull(), "exists")
        .when(F.col("op").isin("update", "delete") & F.col("was").isNull(), "missing")
        .when((F.col("op") == "update") & same, "unchanged")
    )
    idle = (F.col("op") == "upsert") & same
    return joined.select("id", "was", "new", F.when(~F.coalesce(idle, F.lit(False)), F.col("op")).alias("op"), fault.alias("fault"))


def apply_changes(snapshot: DataFrame, changes: DataFrame, *, id_col: str, order_col: str | None = None) -> DataFrame:
    """The next snapshot: inserts get version 1, updates the old one plus 1, deletes go.

    Changes with a fault (see :func:`judged`) leave their row as it was;
    :func:`rejected` lists them.
    """
    rows = judged(snapshot, changes, id_col=id_col, order_col=order_col)
    applied = F.col("op").isNotNull() & F.col("fault").isNull()
    rows = rows.where(F.when(applied, F.col("op") != "delete").otherwise(F.col("was").isNotNull()))
    version = F.coalesce(F.col("was._version"), F.lit(0)) + F.when(applied, 1).otherwise(0)
    value = lambda c: version.cast("int") if c == "_version" else F.when(applied, F.col(f"new.`{c}`")).otherwise(F.col(f"was.`{c}`"))
    return rows.select(F.col("id").alias(id_col), *[value(c).alias(c) for c in snapshot.columns if c != id_col])


def rejected(snapshot: DataFrame, changes: DataFrame, *, id_col: str, order_col: str | None = None) -> DataFrame:
    """(id, op, fault) of the changes that :func:`apply_changes` leaves out."""
    return judged(snapshot, changes, id_col=id_col, order_col=order_col).where("fault IS NOT NULL").select(F.col("id").alias(id_col), "op", "fault")


def upsert(snapshot: DataFrame, rows: DataFrame, *, id_col: str, on: str | None = None, order_col: str | None = None) -> DataFrame:
    """Insert rows whose key is new, update the others; an unchanged row keeps its version.

    ``on`` names a unique column that finds the row to update in place of the id: that
    row keeps its id, and the id given with ``rows`` is for new ones only.
    """
    if on:
        found = snapshot.select(F.col(f"`{on}`").alias("__on"), F.col(f"`{id_col}`").alias("__id"))
        rows = rows.join(found, F.col(f"`{on}`").eqNullSafe(F.col("__on")), "left").withColumn(id_col, F.coalesce("__id", F.col(f"`{id_col}`"))).drop("__on", "__id")
    return apply_changes(snapshot, rows.withColumn("_op", F.lit("upsert")), id_col=id_col, order_col=order_col)


def delete(snapshot: DataFrame, ids: DataFrame, *, id_col: str) -> DataFrame:
    return snapshot.join(ids, id_col, "left_anti")


def changed_columns(old: DataFrame, new: DataFrame, *, id_col: str) -> DataFrame:
    """(id, changed): sorted names of columns that differ, for rows in both with any."""
    columns = sorted(c for c in old.columns if c not in (id_col, "_version"))
    joined = old.alias("o").join(new.alias("n"), id_col)
    names = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in columns]))
    return joined.select(id_col, F.array_join(names, ",").alias("changed")).where("changed != ''")


def unique_conflicts(snapshot: DataFrame, changes: DataFrame, unique: str, *, id_col: str, observed_absent: DataFrame | None = None) -> DataFrame:
    """(id, value, kind) of changes whose unique value another row would hold.

    Values are compared in the state after the changes, so two rows may swap theirs. A
    value that the session had seen to be absent means a race, any other a violation.
    """
    untouched = snapshot.join(changes.select(id_col), id_col, "left_anti").select(F.col(unique).alias("value")).distinct().withColumn("taken", F.lit(True))
    mine = changes.where("_op != 'delete'").select(id_col, F.col(unique).alias("value"))
    shared = mine.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    found = mine.join(shared, "value").join(untouched, "value", "left").where("n > 1 OR taken")
    if observed_absent is None:
        return found.select(id_col, "value", F.lit("violation").alias("kind"))
    absent = observed_absent.select(F.col(unique).alias("value")).distinct().withColumn("absent", F.lit(True))
    kind = F.when(F.col("absent"), F.lit("race")).otherwise(F.lit("violation"))
    return found.join(absent, "value", "left").select(id_col, "value", kind.alias("kind"))


def stale_reads(read_set: DataFrame, snapshot: DataFrame, *, id_col: str) -> DataFrame:
    """(id, read_version, now_version) of rows that changed or went since they were read."""
    now = snapshot.select(id_col, F.col("_version").alias("now_version"))
    joined = read_set.select(id_col, F.col("_version").alias("read_version")).join(now, id_col, "left")
    return joined.where(~F.col("read_version").eqNullSafe(F.col("now_version")))


def delta(old: DataFrame, new: DataFrame, *, id_col: str) -> DataFrame:
    """Row changes between two results: _op and the row; a deleted one's values are null."""
    columns = [c for c in new.columns if c != id_col]
    o = old.select(id_col, F.struct(*columns).alias("was"), F.lit(True).alias("old"))
    n = new.select(id_col, F.struct(*columns).alias("row"), F.lit(True).alias("new"))
    joined = o.join(n, id_col, "full_outer")
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(~F.col("was").eqNullSafe(F.col("row")), "update")
    return joined.withColumn("_op", op).where("_op IS NOT NULL").select("_op", id_col, "row.*")


def row_updates(ids: DataFrame, visible: DataFrame, *, id_col: str) -> DataFrame:
    """What the watchers of single rows get: each touched id with its row as it is now, or
    nulls where it is gone or no longer to be seen."""
    rows = visible.drop("_version").withColumn("_there", F.lit(True))
    return ids.select(id_col).distinct().join(rows, id_col, "left").withColumn("_op", F.when(F.col("_there"), "row").otherwise("delete")).drop("_there")


def fold(view: DataFrame, deltas: DataFrame, *, id_col: str) -> DataFrame:
    """A client's view after a delta."""
    kept = view.join(deltas.select(id_col), id_col, "left_anti")
    return kept.unionByName(deltas.where("_op != 'delete'").select(*view.columns))


def channels(changes: DataFrame, table: str, indexes: list[str], *, id_col: str) -> DataFrame:
    """Channels that a commit concerns: a row's own; all indexes of an insert or delete;
    of an update only those in its ``changed`` list."""
    row = F.concat_ws(":", F.lit(table), F.lit("id"), F.col(id_col).cast("string"))
    hit = lambda i: (F.col("_op") != "update") | F.array_contains(F.split("changed", ","), i)
    index: list[Column] = [F.when(hit(i), F.lit(f"{table}:index:{i}")) for i in indexes]
    return changes.select(F.explode(F.array_compact(F.array(row, *index))).alias("channel")).distinct()


def notify_batches(events: DataFrame, ts: str, channel: str, millis: int = 100) -> DataFrame:
    """One notice per channel and time bucket: (bucket, channel, notices)."""
    bucket = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (millis * 1000)).cast("long")
    return events.groupBy(bucket.alias("bucket"), channel).agg(F.count(F.lit(1)).alias("notices"))


def drop_stale(events: DataFrame, ts: str, now: Column, seconds: int = 120) -> DataFrame:
    """Pending notices not older than the limit."""
    return events.where(F.col(ts) >= now - F.expr(f"INTERVAL {seconds} SECONDS"))


def latest(updates: list[DataFrame], key: str, order: str) -> DataFrame:
    """Merged updates, the last of each key."""
    rows = reduce(DataFrame.unionByName, updates)
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(F.col(f"`{key}`").alias("__key")).agg(F.max_by(row, F.col(f"`{order}`")).alias("__row")).select("__row.*")
