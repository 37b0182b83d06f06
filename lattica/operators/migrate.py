"""Moving a table's rows from one declared schema to another."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.stats import duplicates
from lattica.sources.schema import INT_RANGES, Table, spark_type, text_width
from lattica.sources.tables import conform

Step = Callable[[DataFrame], DataFrame]
_FLOAT_DIGITS = {"float16": 11, "float32": 24, "float64": 53}


def casts_safely(old: str, new: str) -> bool:
    """Whether every value of the old type is one of the new type."""
    if old == new:
        return True
    a, b = text_width(old), text_width(new)
    if a is not None or b is not None:
        return a is not None and b is not None and old[0] == new[0] and a <= b
    if old in INT_RANGES and new in INT_RANGES:
        return INT_RANGES[new][0] <= INT_RANGES[old][0] and INT_RANGES[old][1] <= INT_RANGES[new][1]
    if old in _FLOAT_DIGITS:
        return new in _FLOAT_DIGITS and _FLOAT_DIGITS[old] <= _FLOAT_DIGITS[new]
    # 64-bit integers go to float64 by convention, though large ones lose digits.
    bits = int(old.lstrip("uint"))
    return new == "float64" or new == "float32" and bits <= 16 or new == "float16" and bits <= 8


def plan(old: Table, new: Table) -> str:
    """``skip`` for equal schemas, ``unsafe`` if columns go or lose values, else ``ok``."""
    if old.version() == new.version():
        return "skip"
    gone = set(old.columns) - set(new.columns)
    lossy = [c for c in set(old.columns) & set(new.columns) if not casts_safely(old.columns[c].dtype, new.columns[c].dtype)]
    return "unsafe" if gone or lossy else "ok"


def migrate(rows: DataFrame, old: Table, new: Table, force: bool = False) -> DataFrame:
    """The rows under the new schema: shared columns cast, new ones with their default.

    A lossy step needs ``force``: floats lose their fraction, texts are cut. Unique
    columns are checked afterwards by :func:`check_unique`.
    """
    step = plan(old, new)
    if step == "skip":
        return rows
    if step == "unsafe" and not force:
        raise ValueError("the migration would lose data")
    kept = [c for c in new.columns if c in rows.columns]
    return conform(rows.select(*[F.col(c).cast(spark_type(new.columns[c].dtype)).alias(c) for c in kept]), new)


def run_chain(rows: DataFrame, version: str, steps: Mapping[str, tuple[str, Step]], wanted: str) -> DataFrame:
    """Rows brought from one schema version to another by the registered steps.

    ``steps`` maps an old version to the one that its function makes. The chain stops
    at ``wanted``; one that ends elsewhere or runs in a circle is an error.
    """
    seen = {version}
    while version != wanted:
        if version not in steps:
            raise ValueError(f"no step leads on from version {version}")
        version, step = steps[version]
        if version in seen:
            raise ValueError(f"the steps return to version {version}")
        seen.add(version)
        rows = step(rows)
    return rows


def check_unique(rows: DataFrame, table: Table) -> None:
    """Fail if a unique column repeats a value."""
    for name, column in table.columns.items():
        if column.unique and not duplicates(rows, name).isEmpty():
            raise RuntimeError(f"column {name} of {table.name} is unique, but values repeat")
