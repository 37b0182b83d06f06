"""Statistics over fetched rows and tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def describe(df: DataFrame, column: str) -> DataFrame:
    """sum, mean, min, max, population deviation and count in one pass."""
    c = F.col(column)
    return df.agg(F.sum(c).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), F.stddev_pop(c).alias("deviation"), F.count(c).alias("n"))


#: Rows of a slice that is sorted to find a rank, and slices of a round of narrowing.
SLICE_ROWS, SLICES = 1 << 16, 16


def percentiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one column each (p25, p50, ...).

    The rank is narrowed to a range of values by counting below approximate quantiles,
    sixteen times closer in each pass, until the range holds few rows; only those are sorted.
    Nothing is shuffled but counts, whatever the number of rows or of distinct values.
    Nulls and NaN are left out; without a value every percentile is null.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    names = [f"p{round(s * 100)}" for s in shares]
    schema = ", ".join(f"{n} double" for n in names)
    row = values.agg(F.count("v"), F.min("v"), F.max("v"), _marks()).first()
    n, low, high = row[:3]
    if not n:
        return df.sparkSession.createDataFrame([tuple(None for _ in names)], schema)
    cuts: dict = {(low, high): _counted(values, low, high, row[3])}
    below = {s: int(s * (n - 1)) for s in shares}
    spots = {r: _narrowed(values, r, low, high, n, cuts) for s in shares for r in (below[s], min(below[s] + 1, n - 1))}
    # The few rows of each range that is left, sorted, in one pass.
    ranges = sorted({(a, b) for a, b, _ in spots.values()})
    kept = values.agg(*[F.sort_array(F.collect_list(F.when(F.col("v").between(a, b), F.col("v")))) if a < b else F.array(F.lit(a)) for a, b in ranges]).first()
    value = {r: kept[ranges.index((a, b))][r - base if a < b else 0] for r, (a, b, base) in spots.items()}
    spot = lambda s: (value[below[s]], value[min(below[s] + 1, n - 1)], s * (n - 1) % 1)
    return df.sparkSession.createDataFrame([tuple(a + (b - a) * part for a, b, part in map(spot, shares))], schema)


def _marks() -> Column:
    return F.percentile_approx("v", [i / SLICES for i in range(1, SLICES)], SLICES * 10)


def _counted(values: DataFrame, low: float, high: float, marks: list[float]) -> list[tuple[float, bool, int]]:
    """(mark, whether it counts, values of the range below or up to it), ascending."""
    marks = sorted(set(marks))
    counts = values.where(F.col("v").between(low, high)).agg(*[c for m in marks for c in (F.count_if(F.col("v") < m), F.count_if(F.col("v") <= m))]).first()
    return [(m, own, counts[2 * i + own]) for i, m in enumerate(marks) for own in (False, True)]


def _narrowed(values: DataFrame, rank: int, low: float, high: float, rows: int, cuts: dict) -> tuple[float, float, int]:
    """A range of values that holds the rank and few rows, or one value, and the rows below it.

    ``cuts`` keeps what the pass over a range has counted, for all ranks in it.
    """
    base = 0
    while rows > SLICE_ROWS and low < high:
        if (low, high) not in cuts:
            cuts[low, high] = _counted(values, low, high, values.where(F.col("v").between(low, high)).agg(_marks()).first()[0])
        under = max((x for x in cuts[low, high] if base + x[2] <= rank), default=None)
        over = min((x for x in cuts[low, high] if base + x[2] > rank), default=None)
        rows = (over[2] if over else rows) - (under[2] if under else 0)
        base += under[2] if under else 0
        if under:
            low = math.nextafter(under[0], math.inf) if under[1] else under[0]
        if over:
            high = over[0] if over[1] else math.nextafter(over[0], -math.inf)
    return low, high, base


def count_where(df: DataFrame, **conditions: Column) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def grouped_count(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once."""
    return grouped_count(df, column).where("n > 1")


def running_average(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds the average of a key's values so far, summed exactly to six decimals."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("running_mean", F.sum(F.col(value).cast("decimal(18,6)")).over(w).cast("double") / F.count(value).over(w))


def slow_calls(df: DataFrame, key: str, value: str, over: float, top: int = 20, retries: str | None = None, most_retries: int = 5) -> DataFrame:
    """Keys by average of their values above a limit, the slowest first.

    With a column of ``retries``, calls tried again more than ``most_retries`` times count too.
    """
    is_slow = F.col(value) > over
    if retries:
        is_slow = is_slow | (F.col(retries) > most_retries)
    slow = df.where(is_slow).groupBy(key).agg(F.avg(value).alias("mean"), F.max(value).alias("worst"), F.count(F.lit(1)).alias("n"))
    return slow.orderBy(F.col("mean").desc(), F.col(key)).limit(top)


def reference_hubs(pairs: DataFrame, group: str, member: str) -> DataFrame:
    """Each group's most referenced member (ties: smallest name) over all pairs."""
    counts = pairs.groupBy(member).agg(F.count(F.lit(1)).alias("refs"))
    joined = pairs.join(counts, member)
    return joined.groupBy(group).agg(F.min_by(member, F.struct(-F.col("refs"), F.col(member))).alias("hub"), F.max("refs").alias("refs"))
