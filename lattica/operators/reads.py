"""Point reads, ordered range reads and what callers do with the rows they get."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def bound(value: Any, kind: T.DataType) -> tuple[Any, bool]:
    """A bound's value and whether it is open. Texts may start with ``(`` or ``[``.

    On a text column that first character is always taken as the mark, so a literal one
    needs a mark before it. Infinities on integer columns become the type's ends.
    """
    is_open = False
    if isinstance(value, str) and value[:1] in ("(", "["):
        is_open, value = value[0] == "(", value[1:]
    if isinstance(kind, T.StringType):
        if not isinstance(value, str):
            raise ValueError("a text column takes text bounds")
        return value, is_open
    if isinstance(value, str):
        value = float(value) if isinstance(kind, (T.FloatType, T.DoubleType)) or "inf" in value else int(value)
    bits = _INTS.get(type(kind))
    if bits and isinstance(value, float):
        if math.isinf(value):
            value = 2 ** (bits - 1) - 1 if value > 0 else -(2 ** (bits - 1))
        elif value == int(value):
            value = int(value)
        else:
            raise ValueError(f"{value} is no integer")
    return value, is_open


def between(df: DataFrame, column: str, left: Any, right: Any = None) -> Column:
    """The predicate of a range; a missing right bound asks for equality.

    Literals are cast to the column's type and the column is left alone, so the
    predicate reaches the Parquet scan.
    """
    kind = df.schema[column].dataType
    low, low_open = bound(left, kind)
    if right is None:
        return F.col(column) == F.lit(low).cast(kind)
    high, high_open = bound(right, kind)
    if low > high:
        raise ValueError(f"the left bound {low!r} is above the right bound {high!r}")
    above = F.col(column) > F.lit(low).cast(kind) if low_open else F.col(column) >= F.lit(low).cast(kind)
    below = F.col(column) < F.lit(high).cast(kind) if high_open else F.col(column) <= F.lit(high).cast(kind)
    return above & below


def range_rows(df: DataFrame, column: str, left: Any, right: Any = None, *, id_col: str, limit: int = 10, desc: bool = False, indexed: Sequence[str] | None = None) -> DataFrame:
    """Rows of a range, ordered by (column, id), at most ``limit`` (negative: all).

    ``desc`` reverses both; bounds keep their own open and closed marks either way.
    """
    if indexed is not None and column not in indexed:
        raise ValueError(f"column {column!r} has no index")
    rows = df.where(between(df, column, left, right))
    order = [F.col(column).desc(), F.col(id_col).desc()] if desc else [F.col(column), F.col(id_col)]
    ordered = rows.orderBy(*order)
    return ordered.limit(limit) if limit >= 0 else ordered


def get_row(df: DataFrame, column: str, value: Any, *, id_col: str) -> DataFrame:
    """The first row of an equality, by id."""
    return range_rows(df, column, value, id_col=id_col, limit=1)


def id_list(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(id_col)


def raw_format(rows: DataFrame) -> DataFrame:
    """Every column as text."""
    return rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])


def client_format(rows: DataFrame) -> DataFrame:
    """What clients see: no version column."""
    return rows.drop("_version")


def top_n(df: DataFrame, column: str, n: int, *, id_col: str) -> DataFrame:
    """The ``n`` largest by a column without index; equal values by ascending id."""
    return df.orderBy(F.col(column).desc(), F.col(id_col)).limit(n)


def nearest(df: DataFrame, distance: Column, *, id_col: str) -> DataFrame:
    """The row of least distance; the smaller id of equal ones. One aggregation, no sort."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.agg(F.min_by(row, F.struct(distance.alias("d"), F.col(id_col).alias("i"))).alias("row")).where("row IS NOT NULL").select("row.*")


def semi_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_semi")


def key_intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def lookup_join(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Each key's row: the set form of one point read per key."""
    return keys.select(key).distinct().join(rows, key)
