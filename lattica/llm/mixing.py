"""Mixing sources to target weights along a curriculum.

Targets. Sources in code-point order (null last) weigh 3, 1, 2, repeating. They share
``BUDGET`` times all words; a target stops at ``MAX_REPEATS`` times its source's words
and the excess is shared again by weight until none is above. That fixed point has a
closed form: with sources ordered by cap / weight, the capped ones are a prefix.

Positions. A source's weight changes with training time t in [0, 1] as
``1 + a (1 - 2 t)``: with a > 0 it is heavier early, with a < 0 late. Its integral
``t + a t (1 - t)`` is the share of its target that training has used by t; a document
whose words begin at share q of its source's stream is trained at the t that solves it.
A stream is the source's documents in hash order, then again from the start while words
are owed; the document where the target runs out gives the words still owed.

Running sums never meet in one task: hash order is cut into slices of about
``SLICE_DOCS`` documents, sums of slices are accumulated, then documents in their slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.workspace import Workspace

WEIGHTS = (3.0, 1.0, 2.0)
#: Curriculum slope of each source, repeating in the order of the weights.
TILTS = (0.5, 0.0, -0.5)
BUDGET = 1.5
MAX_REPEATS = 2.0
SLICE_DOCS = 1024
_WORD = r"[^\x20\x09-\x0D]+"
_KEY_SPACE = float(1 << 60)


def source_key(source: Column) -> Column:
    """Sorts as the source does by code point, with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def shuffle_key(doc_id: Column) -> Column:
    """A document's place in hash order: 60 bits, the same in every run."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, src, key, size): size counts runs of characters other than ASCII white space."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("src"), shuffle_key(F.col("doc_id").cast("long")).alias("key"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"), *more)


def _cycle(values: tuple[float, ...], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(place - 1, F.lit(len(values))) + 1).cast("int"))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, tilts: tuple[float, ...] = TILTS, budget: float = BUDGET, repeats: float = MAX_REPEATS) -> DataFrame:
    """One row per source: src, source_size, target, tilt. Works on the list of sources alone."""
    every = W.partitionBy()
    place = F.row_number().over(W.orderBy("src"))
    sources = rows.groupBy("src").agg(F.sum("size").alias("source_size")).withColumn("place", place)
    sources = sources.select("src", "source_size", _cycle(weights, F.col("place")).alias("weight"), _cycle(tilts, F.col("place")).alias("tilt"), (F.col("source_size") * F.lit(float(repeats))).alias("cap"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "src")
    before, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    owed = F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    sources = sources.withColumns({"owed": owed, "sharing": F.sum("weight").over(onward)})
    sources = sources.withColumn("capped", F.col("owed") * F.col("weight") / F.col("sharing") > F.col("cap"))
    first = F.max(F.when(~F.col("capped"), F.struct("sharing", "owed"))).over(every)
    shared = F.least(first.getField("owed") * F.col("weight") / first.getField("sharing"), F.col("cap"))
    return sources.select("src", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(shared).alias("target"), "tilt")


def _position(words_before: Column) -> Column:
    """Training time at which a source's stream reaches a word."""
    q, a = words_before / F.col("target"), F.col("tilt")
    return F.when(a == 0, q).otherwise(((1 + a) - F.sqrt(F.greatest((1 + a) * (1 + a) - 4 * a * q, F.lit(0.0)))) / (2 * a))


def assign(docs: DataFrame, **options) -> DataFrame:
    """The curriculum of all documents, range-sorted by first position.

    Columns: doc_id, size, source_size, target, taken, first_position, second_position.
    ``taken`` counts repeats and never exceeds twice ``size``; a source's sum is its
    target rounded down. A null text has size 0; a document of size 0 or beyond the
    target takes 0 and has null positions. Rows that repeat an id are ordered by size.
    Null ids share one place in hash order. Reruns agree. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    return ws.finish(_assigned(ws, ws.stage(sized(docs), "sized"), options))


def _assigned(ws: Workspace, rows: DataFrame, options: dict) -> DataFrame:
    out = _streams(rows, *_bases(ws, rows, options))
    n = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["doc_id", "size", "source_size", "target", "taken", "first_position", "second_position"]
    return out.select(*columns).repartitionByRange(n, "first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


def _slice(slices: int) -> Column:
    return F.floor(F.col("key") / _KEY_SPACE * slices).cast("long")


def _bases(ws: Workspace, rows: DataFrame, options: dict) -> tuple[DataFrame, int]:
    """(src, slice, words of the source before the slice, source_size, target, tilt), and the number of slices."""
    slices = max(1, rows.count() // SLICE_DOCS)
    sums = rows.groupBy("src", _slice(slices).alias("slice")).agg(F.sum("size").alias("slice_size"))
    base = F.coalesce(F.sum("slice_size").over(W.partitionBy("src").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("src", "slice", base.alias("base")).join(ws.stage(targets(rows, **options), "targets"), "src")
    return ws.stage(sums, "slices"), slices


def _streams(rows: DataFrame, bases: DataFrame, slices: int) -> DataFrame:
    """The rows with their place: what each pass takes of a document, and when."""
    inside = F.coalesce(F.sum("size").over(W.partitionBy("src", "slice").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("slice", _slice(slices)).withColumn("inside", inside).join(bases, ["src", "slice"]).withColumn("start", F.col("base") + F.col("inside"))
    owed = F.floor("target")
    first = F.greatest(F.least(F.col("size"), owed - F.col("start")), F.lit(0))
    second = F.greatest(F.least(F.col("size"), owed - F.col("source_size") - F.col("start")), F.lit(0))
    placed = placed.withColumns({"first": first, "second": second})
    return placed.withColumns({
        "taken": F.col("first") + F.col("second"),
        "first_position": F.when(F.col("first") > 0, _position(F.col("start"))),
        "second_position": F.when(F.col("second") > 0, _position(F.col("start") + F.col("source_size"))),
    })


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, whole, in training order; one taken twice appears twice.

    A document is emitted for a pass when the mix takes at least half of it there, at the
    position where its source's cumulative words meet the schedule. Texts go to their
    slice of a source for the running sums, and then to their place in the order; rows
    that cannot be told apart keep no order of their own.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    bases, slices = _bases(ws, ws.stage(sized(docs), "sized"), options)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    streams = _streams(sized(docs, row.alias("row")), ws.finish(bases), slices)
    position = lambda name: F.when((F.col("size") > 0) & (2 * F.col(name) >= F.col("size")), F.col(f"{name}_position"))
    emitted = streams.select("row", "src", "key", F.explode(F.array_compact(F.array(position("first"), position("second")))).alias("position"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return emitted.repartitionByRange(n, "position", "src", "key").sortWithinPartitions("position", "src", "key").select("row.*")
