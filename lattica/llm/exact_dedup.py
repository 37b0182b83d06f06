"""Exact dedup against a minimal perfect hash of historical digests.

History is reduced to distinct SHA-256 digests with the id of the row that wins and
the number of rows. Digests are dealt into buckets by their leading bits and each
bucket gets a minimal perfect hash (cascading bit arrays: a key settles in the first
level where it is alone). Slot ``rank(position)`` holds the full digest, the winner's
id and the count. Incoming digests, first reduced per distinct digest, look up their
slot and compare all 32 bytes: equal ones join the historical group, the others form
groups of their own.

Buckets hold a few hundred *distinct* digests, so a text that fills a third of the
rows is one entry. The last join, which hands every row its group, is a plain
equi-join that Spark can split where a digest is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import as_strings, chunks, mix64, raw_bytes
from lattica.llm.workspace import Workspace

#: Distinct digests per bucket of the index, on average.
BUCKET = 512
#: Bits of a level per key still to place.
GAMMA = 1.6
_MPH = "bucket long, levels array<long>, bits binary, digests binary, winners binary, sizes binary"


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of each whole text with A-Z lower-cased; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = as_strings(batch.column(1)), []
            for _, part in chunks(texts):
                body, offsets = raw_bytes(pc.ascii_lower(part))
                view = memoryview(np.ascontiguousarray(body))
                out += [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest binary")


def _keys(digests: np.ndarray) -> np.ndarray:
    """Two 64-bit words of each digest folded into one key; n x 32 bytes in."""
    words = np.ascontiguousarray(digests).view(np.uint64)
    return words[:, 1] ^ mix64(words[:, 2])


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (mix64(keys + seed) % np.uint64(size)).astype(np.int64)


def build_mph(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, bits of all levels, and the slot (0..n-1) of each of the distinct keys."""
    slots, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    levels, bits = [], []
    while len(left):
        size = max(8, int(len(left) * GAMMA))
        at = _place(keys[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        slots[left[placed]] = at[placed] + sum(levels)
        levels.append(size)
        bits.append(alone)
        left = left[~placed]
        if len(levels) > 200:
            raise ValueError("two distinct digests share a key")
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return levels, flat, (np.cumsum(flat) - 1)[slots] if len(keys) else slots


def find_slots(keys: np.ndarray, levels: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot each key would have; -1 where no level holds it. Non-members may get any slot."""
    rank, slots, left, base = np.cumsum(bits) - 1, np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(levels):
        at = base + _place(keys[left], level, size)
        hit = bits[at]
        slots[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return slots


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


#: Stands for "no id" among the winners; ids are compared with nulls lowest.
_NO_ID = np.iinfo(np.int64).min


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(pdf["digest"])
    levels, bits, slots = build_mph(_keys(digests))
    order = np.argsort(slots)
    row = {
        "bucket": int(pdf["bucket"].iloc[0]), "levels": levels, "bits": np.packbits(bits).tobytes(), "digests": digests[order].tobytes(),
        "winners": pdf["keep_id"].to_numpy(np.int64)[order].tobytes(), "sizes": pdf["n"].to_numpy(np.int64)[order].tobytes(),
    }
    return pd.DataFrame([row])


def _merge(incoming: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Groups of one bucket: historical ones with what joined them, then the new ones."""
    new, keep, n = _matrix(incoming["digest"]), incoming["keep_id"].to_numpy(np.int64), incoming["n"].to_numpy(np.int64)
    if index.empty:
        out, winners, sizes, member = new[:0], keep[:0], n[:0], np.zeros(len(new), bool)
    else:
        row = index.iloc[0]
        levels = [int(x) for x in row["levels"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(levels)].astype(bool)
        out = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        winners, sizes = np.frombuffer(row["winners"], np.int64).copy(), np.frombuffer(row["sizes"], np.int64).copy()
        slots = find_slots(_keys(new), levels, bits)
        member = (slots >= 0) & (out[slots] == new).all(axis=1)
        winners[slots[member]] = np.maximum(winners[slots[member]], keep[member])
        sizes[slots[member]] += n[member]
    digests = np.concatenate([out, new[~member]])
    return pd.DataFrame({"digest": [d.tobytes() for d in digests], "keep_id": np.concatenate([winners, keep[~member]]), "n": np.concatenate([sizes, n[~member]])})


def build_index(digests: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket with the minimal perfect hash of its distinct digests."""
    return _distinct(digests, buckets).groupBy("bucket").applyInPandas(_build, _MPH)


def _distinct(digests: DataFrame, buckets: int) -> DataFrame:
    lead = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    groups = digests.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(_NO_ID)).alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return groups.select((lead % buckets).alias("bucket"), "digest", "keep_id", "n")


def exact_dedup(incoming: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``history`` and ``incoming``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest id of a group
    stays. A null text is an empty one. A null id never beats another; a group of null
    ids only has a null keep_id and all its rows stay. Rows that repeat the winner's id
    all stay: they are one document. Empty tables give an empty result; other columns
    are ignored whatever their names.
    """
    spark = incoming.sparkSession
    ws = Workspace(spark, "exact_dedup")
    tagged = text_digests(incoming, id_col, text_col).withColumn("old", F.lit(False))
    if history is not None:
        tagged = tagged.unionByName(text_digests(history, id_col, text_col).withColumn("old", F.lit(True)))
    return ws.finish(_groups(ws, ws.stage(tagged, "digests"), bucket))


def _groups(ws: Workspace, rows: DataFrame, bucket: int) -> DataFrame:
    buckets = max(1, rows.count() // bucket)
    index = ws.stage(build_index(rows.where("old"), buckets), "index")
    incoming = _distinct(rows.where("not old"), buckets)
    looked_up = incoming.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_merge, "digest binary, keep_id long, n long")
    groups = looked_up.select("digest", F.nullif("keep_id", F.lit(_NO_ID)).alias("keep_id"), F.col("n").alias("group_size"))
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def dedup_by_arrival(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """:func:`exact_dedup` of one table: ids up to the middle of their range are the history."""
    ws = Workspace(docs.sparkSession, "exact_dedup")
    staged = ws.stage(text_digests(docs, id_col, text_col), "digests")
    low, high = staged.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else (low + high) // 2
    rows = staged.withColumn("old", F.coalesce(F.col("doc_id") <= middle, F.lit(False)))
    return ws.finish(_groups(ws, rows, bucket))
