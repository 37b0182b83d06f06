"""Rate limits and flood checks: decisions that depend on the order of a key's calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rate_limit(calls: DataFrame, key: str, ts: str, call_id: str, times: int, per_micros: int) -> DataFrame:
    """(call_id, allowed): at most ``times`` calls of a key in a window of ``per_micros``.

    A window opens at a key's first call and is renewed by a call strictly later than its
    end; a rejected call moves the window's start to itself. The rule is not associative,
    so a key's calls are read in order; they stream through in batches and only the
    window's start and count are held, however many calls a key has.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = start = count = None
        for frame in frames:
            out = []
            for k, t in zip(frame["k"].tolist(), frame["t"].tolist(), strict=True):
                if k != current or current is None:
                    current, start, count = k, t, 0
                if t - start > per_micros:
                    start, count = t, 0
                count += 1
                if count > times:
                    start = t
                out.append(count <= times)
            yield pd.DataFrame({"call_id": frame["c"], "allowed": out})

    rows = calls.select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(call_id).cast("long").alias("c")).where("k IS NOT NULL")
    return rows.repartition("k").sortWithinPartitions("k", "t", "c").mapInPandas(run, "call_id long, allowed boolean")


def flood_tiers(calls: DataFrame, key: str, ts: str, tiers: list[tuple[int, int]]) -> DataFrame:
    """(key, tier, calls) of tiers ``(most calls, seconds)`` that a key exceeds.

    Calls are counted from a key's first one. A call that comes later than the last
    tier's seconds is the last of its count; the next one starts again from that call's
    time. A tier is exceeded by more than its calls within less than its seconds, and
    ``calls`` is the most that any count had by then. Like :func:`rate_limit` the rule
    depends on order alone, so a key's calls stream through in bounded memory.
    """
    micros, period = [s * 1_000_000 for _, s in tiers], tiers[-1][1] * 1_000_000
    columns = {key: "k", "tier": "tier", "calls": "calls"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, start, count, best = None, 0, 0, [0] * len(tiers)

        def hits() -> list[tuple]:
            return [(current, i, n) for i, n in enumerate(best) if n > tiers[i][0]]

        for frame in frames:
            out = []
            for k, t in zip(frame["k"].tolist(), frame["t"].tolist(), strict=True):
                if k != current:
                    out += hits()
                    current, start, count, best = k, t, 0, [0] * len(tiers)
                count += 1
                elapsed = t - start
                for i, m in enumerate(micros):
                    if elapsed < m:
                        best[i] = max(best[i], count)
                if elapsed > period:
                    start, count = t, 0
            yield pd.DataFrame(out, columns=["k", "tier", "calls"])
        yield pd.DataFrame(hits(), columns=["k", "tier", "calls"])

    rows = calls.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    found = rows.repartition("k").sortWithinPartitions("k", "t").mapInPandas(run, T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("tier", T.IntegerType()), T.StructField("calls", T.LongType())]))
    return found.toDF(*columns)


def guests_per_address(connections: DataFrame, address: str, owner: str, limit: int) -> DataFrame:
    """Addresses with more guests (owner 0) than allowed."""
    return connections.groupBy(address).agg(F.count_if(F.col(owner) == 0).alias("guests")).where(F.col("guests") > limit)
