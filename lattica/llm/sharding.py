"""Extendible hashing: shards of bounded bytes, found by splitting only what is too large.

A document's hash is 60 bits of the MD5 of its id. The directory is indexed by leading
bits; a shard is a bit prefix. The empty prefix holds everything; a bucket over the byte
limit splits on its next bit, others stay as they are. Bytes are summed once per cell
of ``k`` leading bits and every shorter prefix is a sum of cells, so one aggregation
decides ``k`` splits at once; only cells still too large are looked at again with more
bits. Rows of one id share a hash: where they are too large together, 60 bits of a hash
of their text follow, and for rows that repeat it too, 60 bits of one of the row's number.
So only a single row can exceed the limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.workspace import Workspace

BITS = 60
#: Hashes of a row: of its id, of its text, of its number.
HASHES = 3
LIMIT = 16 << 20
#: More bits for each further look at cells that are still too large.
STEP = 8


def id_hash(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def _shift(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftright", value, (F.lit(by) if isinstance(by, int) else by).cast("int"))


def assign_shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, bytes, shard, depth, shard_docs, shard_bytes.

    ``shard`` is the bit prefix as a string of 0 and 1 (empty: everything fits in one
    shard), ``depth`` its length, ``bytes`` the UTF-8 length of the whole text (null: 0).
    Null ids share one hash; rows that share an id stay together as long as they fit.
    Which of equal rows goes where may differ between runs. An empty table gives no
    rows; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "sharding")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), _bits_of(F.xxhash64(text)).alias("h1"), F.monotonically_increasing_id().alias("rid"))
    rows = ws.stage(rows.withColumns({"h0": id_hash(F.col("doc_id")), "h2": _bits_of(F.xxhash64("rid"))}).drop("rid"), "rows")
    placed = ws.stage(_place(ws, rows, limit), "placed")
    shards = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("shard_docs"), F.sum("bytes").alias("shard_bytes"))
    return ws.finish(placed.join(shards, "shard").select("doc_id", "bytes", "shard", F.length("shard").cast("long").alias("depth"), "shard_docs", "shard_bytes"))


def _bits_of(hash_64: Column) -> Column:
    return hash_64.bitwiseAND(F.lit((1 << BITS) - 1))


def _place(ws: Workspace, rows: DataFrame, limit: int) -> DataFrame:
    """(doc_id, bytes, shard) of all rows, hash after hash where one does not suffice."""
    done = []
    rows = rows.withColumn("stem", F.lit(""))
    for k in range(HASHES):
        rows, full = _place_by(ws, rows.withColumn("h", F.col(f"h{k}")), limit, done)
        if not full:
            break
        rows = rows.withColumnRenamed("shard", "stem")
    return reduce(DataFrame.unionAll, done)


def _place_by(ws: Workspace, rows: DataFrame, limit: int, done: list[DataFrame]) -> tuple[DataFrame, int]:
    """Adds the rows that one more hash places to ``done``; returns those of one hash that are too large, and their number."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth, low, left = min(BITS, max(1, total // limit).bit_length() + 3), 0, []
    columns = ["doc_id", "bytes", "h0", "h1", "h2"]
    while True:
        directory = ws.stage(_split(rows, low, depth, limit), "directory")
        # A cell's leaf is known, or the cell is too large at the deepest prefix looked at.
        cell = _shift(F.col("h"), BITS - depth)
        found = rows.withColumn("cell", cell).join(directory, ["stem", "cell"])
        bits = F.lpad(F.conv(_shift(F.col("h"), F.lit(BITS) - F.col("leaf")).cast("string"), 10, 2), F.col("leaf").cast("int"), F.lit("0"))
        shard = F.concat("stem", F.when(F.col("leaf") == 0, F.lit("")).otherwise(bits))
        # One hash alone takes all of its bits before the next hash's follow.
        whole = F.concat("stem", F.lpad(F.conv(F.col("h").cast("string"), 10, 2), BITS, F.lit("0")))
        done.append(found.where("leaf IS NOT NULL AND NOT over").select("doc_id", "bytes", shard.alias("shard")))
        left.append(found.where("leaf IS NOT NULL AND over").select(*columns, whole.alias("shard")))
        if directory.where("leaf IS NULL").isEmpty():
            break
        rows = ws.stage(found.where("leaf IS NULL").select(*columns, "stem", "h"), "rows")
        low, depth = depth + 1, min(BITS, depth + STEP)
    return ws.counted(reduce(DataFrame.unionAll, left), "left")


def _split(rows: DataFrame, low: int, depth: int, limit: int) -> DataFrame:
    """(stem, cell, leaf, over): for each cell of ``depth`` bits the length of its shard's prefix, or null,
    and whether that shard is of one hash, more than one row and too large."""
    cells = rows.groupBy("stem", _shift(F.col("h"), BITS - depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("h").alias("least"), F.max("h").alias("most"))
    tree = cells.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(depth))))
    tree = tree.withColumn("prefix", _shift(F.col("cell"), F.lit(depth) - F.col("d")))
    large = F.sum("bytes") > limit
    one = F.min("least") == F.max("most")
    buckets = tree.groupBy("stem", "d", "prefix").agg((~large | one).alias("fits"), (large & one & (F.sum("n") > 1)).alias("over"))
    leaves = tree.select("stem", "cell", "d", "prefix").join(buckets, ["stem", "d", "prefix"])
    leaf = F.min(F.when(F.col("fits"), F.col("d")))
    return leaves.groupBy("stem", "cell").agg(leaf.cast("long").alias("leaf"), F.coalesce(F.max(F.col("fits") & F.col("over")), F.lit(False)).alias("over"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Write ``docs`` as one Parquet folder per shard and return the shard list."""
    if {"shard"} & set(docs.columns):
        raise ValueError("the documents have a column named shard")
    placed = assign_shards(docs, limit)
    # Rows of one id and size take its places in any order.
    nth = lambda *order: F.row_number().over(W.partitionBy("__id", "__bytes").orderBy(*order))
    owners = placed.select(F.col("doc_id").alias("__id"), F.col("bytes").alias("__bytes"), "shard").withColumn("__nth", nth("shard"))
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    named = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__bytes": size}).withColumn("__nth", nth(F.xxhash64("text")))
    same = F.col("d.__id").eqNullSafe(F.col("o.__id")) & (F.col("d.__bytes") == F.col("o.__bytes")) & (F.col("d.__nth") == F.col("o.__nth"))
    joined = named.alias("d").join(owners.alias("o"), same).select("d.*", "o.shard").drop("__id", "__bytes", "__nth")
    named = joined.withColumn("shard", F.concat(F.lit("s"), "shard"))
    named.repartition("shard").write.partitionBy("shard").parquet(path)
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("docs"), F.sum("bytes").alias("bytes"))
