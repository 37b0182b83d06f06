"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so Jaccard similarity says nothing;
containment ``|S(item) & S(doc)| / |S(item)|`` over five-word shingles does. Items are
partitioned by their number of distinct shingles. An item of ``n`` shingles keeps the
``k`` smallest shingle hashes, ``k = floor((1 - t) u) + 1`` for the largest size ``u`` of
its partition: a document that contains at least a share ``t`` misses at most
``floor((1 - t) n) < k`` shingles, so it holds one of those ``k``. The search therefore
loses nothing. A document of fewer than ``t l`` shingles skips the partitions of smallest
size ``l``. Each candidate is verified on the words themselves.

A benchmark counted to have at most ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters
is broadcast, and documents never move. A larger one becomes a table of sketches made in
tasks, joined with the documents' shingle hashes; either way documents are hashed once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import SHINGLE, as_strings, chunks, shingle_hashes, shingles_of, word_hashes, words_of
from lattica.llm.workspace import Workspace

THRESHOLD = 0.8
#: Items and characters of a benchmark that is broadcast.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
_OUT = "doc_id long, item_id long, n_item_shingles long, n_found long, containment double"


def size_class(n: int) -> int:
    """The partition of items of ``n`` shingles: sizes over ``2^(c - 1)`` up to ``2^c``."""
    return max(0, n - 1).bit_length()


def sketch_size(n: int, threshold: float = THRESHOLD) -> int:
    """Smallest hashes to keep of an item of ``n`` shingles, by the largest size of its partition."""
    return min(n, int((1 - threshold) * (1 << size_class(n)) + 1e-9) + 1)


def sketch(text: str, width: int, threshold: float) -> tuple[int, np.ndarray]:
    """An item's number of distinct shingles and the hashes that it is found by."""
    hashes, offsets = word_hashes(pa.array([text], pa.large_string()))
    distinct = np.unique(shingle_hashes(hashes, offsets, width)[0])
    return len(distinct), distinct[: sketch_size(len(distinct), threshold)]


class ItemBlock:
    """Items of a bounded benchmark: of each shingle width, sketch hashes by size partition."""

    def __init__(self, items: list[tuple[int, str]], threshold: float):
        self.threshold = threshold
        self.shingles: list[tuple[int, frozenset]] = []
        tables: dict[int, dict[int, dict[int, list[int]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            width = min(SHINGLE, len(words))
            at = len(self.shingles)
            self.shingles.append((item_id, frozenset(shingles_of(words, width))))
            n, kept = sketch(text, width, threshold)
            for h in kept.tolist():
                tables[width][size_class(n)][h].append(at)
        #: width: hashes of any partition by their low bits, then (smallest size, hashes, items of each) per partition
        self.widths: dict[int, tuple[np.ndarray, list[tuple[int, np.ndarray, list[list[int]]]]]] = {}
        for width, classes in tables.items():
            seen, parts = np.zeros(1 << 20, bool), []
            for c, table in sorted(classes.items()):
                keys = np.array(sorted(table), np.uint64)
                seen[keys & np.uint64((1 << 20) - 1)] = True
                parts.append(((1 << (c - 1)) + 1 if c else 1, keys, [table[int(k)] for k in keys]))
            self.widths[width] = (seen, parts)

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row of the text, item id, shingles of the item, how many the text holds)."""
        hashes, offsets = word_hashes(texts)
        found: dict[int, set[int]] = defaultdict(set)
        for width, (seen, parts) in self.widths.items():
            grams, ends = shingle_hashes(hashes, offsets, width)
            sizes = np.diff(ends)
            near = np.flatnonzero(seen[grams & np.uint64((1 << 20) - 1)])
            rows = np.searchsorted(ends, near, side="right") - 1
            for least, keys, owners in parts:
                mine = sizes[rows] >= self.threshold * least
                wanted = grams[near[mine]]
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[at] == wanted
                pairs = np.unique(np.stack([rows[mine][hit], at[hit]]), axis=1)
                for row, key in pairs.T.tolist():
                    found[row].update(i for i in owners[key] if sizes[row] >= self.threshold * len(self.shingles[i][1]))
        for row, items in found.items():
            words = words_of(texts[row].as_py())
            grams = {w: set(shingles_of(words, w)) for w in {len(next(iter(self.shingles[i][1]))) for i in items}}
            for i in sorted(items):
                item_id, wanted = self.shingles[i]
                n = len(wanted & grams[len(next(iter(wanted)))])
                if n >= self.threshold * len(wanted):
                    yield row, item_id, len(wanted), n


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """Distinct (item_id, text) of the benchmark, and whether they are few enough to broadcast."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").dropDuplicates()
    n, chars = items.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    return items, n <= BLOCK_ITEMS and (chars or 0) <= BLOCK_CHARS


def _block(items: DataFrame, threshold: float):
    return items.sparkSession.sparkContext.broadcast(ItemBlock([(r.item_id, r.text) for r in items.collect()], threshold))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every (document, item) whose containment is at least ``threshold``.

    Columns: doc_id, item_id, n_item_shingles, n_found, containment. An item of fewer
    than five words is one shingle of all its words. Null or wordless items and texts
    match nothing. A document row with a null id gives a row with a null doc_id; rows
    that repeat give repeated pairs, items that repeat give one. Other columns are
    ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items, small = _items(benchmark, item_id_col, item_text_col)
    if small:
        return rows.mapInArrow(_searcher(_block(items, threshold)), _OUT)
    return _joined_leaks(rows, items, threshold).select("doc_id", "item_id", "n_item_shingles", "n_found", "containment")


_FOUND = "doc_id long, text_hash long, item_id long, n_item_shingles long, n_found long, containment double"


def _joined_leaks(rows: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The leaks of a benchmark of any size: sketches met by equal hashes, then verified.

    Columns as of :func:`find_leaks`, and text_hash.
    """
    ws = Workspace(rows.sparkSession, "decontaminate")
    text_hash = F.xxhash64("text").alias("text_hash")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if width := min(SHINGLE, len(words_of(text))):
                    n, kept = sketch(text, width, threshold)
                    out.append((key, item_id, text, width, n, kept.view(np.int64).tolist()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["item", "item_id", "item_text", "width", "n", "hashes"])

    made = ws.stage(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(sketches, "item long, item_id long, item_text string, width int, n long, hashes array<long>"), "sketches")
    widths = sorted(r.width for r in made.select("width").distinct().collect())

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(as_strings(batch.column(2))):
                hashes, offsets = word_hashes(part)
                for width in widths:
                    found, ends = shingle_hashes(hashes, offsets, width)
                    owner = np.repeat(np.arange(len(part)), np.diff(ends))
                    at = pa.array(first + owner)
                    yield pa.record_batch([pc.take(batch.column(0), at), pc.take(batch.column(1), at), pa.array(np.full(len(found), width, np.int32)), pa.array(np.diff(ends)[owner]), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "width", "size", "hash"])

    held = rows.select("doc_id", text_hash, "text").mapInArrow(grams, "doc_id long, text_hash long, width int, size long, hash long")
    wanted = made.select("item", "width", "n", F.explode("hashes").alias("hash"))
    pairs = ws.stage(held.join(wanted, ["width", "hash"]).where(F.col("size") >= threshold * F.col("n")).select("doc_id", "text_hash", "item").distinct(), "pairs")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, hashed, item_id, text, item_text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(item_text)
                width = min(SHINGLE, len(words))
                item = set(shingles_of(words, width))
                n = len(item.intersection(shingles_of(words_of(text), width)))
                if n >= threshold * len(item):
                    out.append((doc_id, hashed, item_id, len(item), n, n / len(item)))
            yield pa.record_batch([pa.array([r[k] for r in out], pa.float64() if k == 5 else pa.int64()) for k in range(6)], names=[c.split()[0] for c in _FOUND.split(", ")])

    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash"))
    texts = rows.select("doc_id", text_hash, "text").alias("d").join(pairs.alias("p"), same).select("d.doc_id", "d.text_hash", "item", "text")
    return ws.finish(texts.join(made.select("item", "item_id", "item_text"), "item").select("doc_id", "text_hash", "item_id", "text", "item_text").mapInArrow(verified, _FOUND))


def _searcher(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, out = batch.column(0), as_strings(batch.column(1)), []
            for first, part in chunks(texts):
                out += [(first + row, item, n, got) for row, item, n, got in block.value.search(part)]
            at, item, n, got = (pa.array([r[k] for r in out], pa.int64()) for k in range(4))
            share = pa.array([r[3] / r[2] for r in out], pa.float64())
            yield pa.record_batch([pc.take(ids, at), item, n, got, share], names=["doc_id", "item_id", "n_item_shingles", "n_found", "containment"])

    return run


def drop_leaked(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that contain a test item; all columns stay.

    For a benchmark that is broadcast the verdict is made in the same pass as the rows.
    """
    items, small = _items(benchmark, "item_id", "text")
    if small:
        return docs.mapInArrow(_keeper(_block(items, threshold)), docs.schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = _joined_leaks(rows, items, threshold).select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash")), "left_anti")


def _keeper(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, part in chunks(as_strings(batch.column("text"))):
                for row, *_ in block.value.search(part):
                    keep[first + row] = False
            yield batch.filter(pa.array(keep))

    return run
