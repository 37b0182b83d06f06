"""Scheduled and idempotent calls as operations on tables of calls."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

LOCK_DAYS = 7
#: Seconds before its time at which a call counts as due.
AHEAD = 0.1
ARGS_CHARS = 1024
CALLS = "id long, system string, args string, scheduled double, timeout int, recurring boolean, created double, last_run double"


def due(calls: DataFrame, now: Column, *, at: str, id_col: str, limit: int = 1) -> DataFrame:
    """The earliest calls due at ``now``."""
    return calls.where(F.col(at) <= now).orderBy(at, id_col).limit(limit)


def pop_due(calls: DataFrame, now: float, *, at: str = "scheduled", timeout: str = "timeout", id_col: str = "id", limit: int | None = None) -> DataFrame:
    """The table after the earliest ``limit`` due calls were taken (None: all; 1: as a worker pops them).

    Due are calls scheduled within :data:`AHEAD` seconds from ``now``, the earliest and of
    equal ones the smallest id first. One without timeout goes, the others are due again a
    timeout after ``now``, with ``last_run`` set.
    """
    is_due = F.col(at).between(0, now + AHEAD)
    if limit is not None:
        taken = F.broadcast(calls.where(is_due).orderBy(at, id_col).limit(limit).select(F.col(id_col).alias("__taken")))
        calls = calls.join(taken, F.col(id_col) == F.col("__taken"), "left")
        is_due = F.col("__taken").isNotNull()
    kept = calls.where(~(is_due & (F.col(timeout) == 0)))
    kept = kept.withColumns({at: F.when(is_due, now + F.col(timeout)).otherwise(F.col(at)), "last_run": F.when(is_due, F.lit(now)).otherwise(F.col("last_run"))})
    return kept.drop("__taken")


def call_row(call_id: int, now: float, at: float, system: str, *args: Any, timeout: int = 60, recurring: bool = False, locked: bool = True) -> Row:
    """A checked row of :data:`CALLS`, to be added to the table.

    ``at`` is a time, or seconds from ``now`` if not positive. Arguments are stored as JSON
    and must come back equal from it. A call that is tried again (``timeout`` is not 0)
    runs a system that locks calls (``locked``), unless it recurs.
    """
    if timeout != 0 and timeout < 5:
        raise ValueError("a timeout is 0 or at least 5 seconds")
    if recurring and timeout == 0:
        raise ValueError("a recurring call needs a timeout")
    if timeout and not recurring and not locked:
        raise ValueError(f"system {system} takes no call lock")
    text = encode_args(args)
    return Row(id=call_id, system=system, args=text, scheduled=float(at if at > 0 else now - at), timeout=timeout, recurring=recurring, created=float(now), last_run=0.0)


def encode_args(args: Sequence[Any]) -> str:
    """Arguments as JSON of at most :data:`ARGS_CHARS` characters that gives equal ones back."""
    try:
        text = json.dumps(list(args), ensure_ascii=False, allow_nan=False)
    except (TypeError, ValueError) as e:
        raise ValueError(f"arguments are not plain values: {e}") from e
    if json.loads(text) != list(args):
        raise ValueError("arguments change when they are stored")
    if len(text) > ARGS_CHARS:
        raise ValueError(f"arguments take more than {ARGS_CHARS} characters")
    return text


def create_calls(calls: DataFrame, rows: Sequence[Row]) -> DataFrame:
    """The table with new calls; an id that is taken fails the write that reads this."""
    new = calls.sparkSession.createDataFrame(list(rows), CALLS)
    taken = new.join(calls.select("id").withColumn("__there", F.lit(True)), "id", "left")
    fresh = taken.withColumn("id", F.when(F.col("__there"), F.raise_error(F.concat(F.lit("a call has id "), F.col("id").cast("string"))).cast("long")).otherwise(F.col("id")))
    return calls.unionByName(fresh.select(*calls.columns))


def ensure_calls(calls: DataFrame, wanted: DataFrame, *, key: str = "id") -> DataFrame:
    """Insert the calls whose key is not there yet."""
    return calls.unionByName(wanted.dropDuplicates([key]).join(calls, key, "left_anti"))


def cancel_calls(calls: DataFrame, keys: DataFrame, *, key: str = "id") -> DataFrame:
    return calls.join(keys, key, "left_anti")


def apply_once(calls: DataFrame, key: str, order: list[str], done: DataFrame | None = None) -> DataFrame:
    """The first call of each key that is not among the done ones.

    An aggregate that keeps one row per key on the map side, so a hot key moves few rows.
    """
    rows = calls if done is None else calls.join(done.select(key), key, "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    first = F.min_by(row, F.struct(*[F.col(f"`{c}`") for c in order]))
    return rows.groupBy(F.col(f"`{key}`").alias("__key")).agg(first.alias("__row")).select("__row.*")


def purge_locks(locks: DataFrame, now: Column, *, called: str = "called") -> DataFrame:
    """Locks not older than a week."""
    return locks.where(F.col(called) >= now - F.expr(f"INTERVAL {LOCK_DAYS} DAYS"))
