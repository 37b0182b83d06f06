"""Reading and writing the tables that queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import ids
from lattica.sources.schema import Table, text_width


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conform(rows: DataFrame, table: Table) -> DataFrame:
    """Rows as the declaration stores them: all columns in order, defaults for missing
    ones and nulls, texts cut to their width, numbers cast (an overflow fails)."""
    out = []
    for field in table.struct().fields:
        default = F.lit(field.metadata["default"]).cast(field.dataType)
        value = F.coalesce(F.col(field.name).cast(field.dataType), default) if field.name in rows.columns else default
        width = text_width(field.metadata["dtype"])
        out.append((F.substring(value, 1, width) if width else value).alias(field.name, metadata=field.metadata))
    return rows.select(*out)


def new_rows(spark: SparkSession, table: Table, size: int, millis: int) -> DataFrame:
    """``size`` rows of defaults with new ids of the time ``millis``; version 0 until stored."""
    return conform(spark.range(size).select(ids.new_ids(millis).alias("id")), table)


def write_snapshot(rows: DataFrame, path: str, sort_by: str | None = None) -> None:
    """Store a table, sorted by an index column so that Parquet statistics prune ranges."""
    (rows.sortWithinPartitions(sort_by) if sort_by else rows).write.parquet(path)
