"""Near-duplicate classes by BagMinHash over the multiset of five-word shingles.

Signatures. A shingle that occurs ``w`` times has weight ``w``. For each shingle runs a
hierarchy of Poisson processes over the weight levels (0,1], (1,2], (2,4], (4,8], ...;
level ``(a, b]`` has rate ``b - a``. Every point has a time, a weight mark uniform in its
level and a component; it counts when its mark is below ``w``. A component's value is its
earliest point, so two texts agree in one with probability equal to their weighted
Jaccard similarity, without bias, whatever their lengths. Points come in ascending time,
and a shingle stops at the text's latest component, so the work is linear in the text
plus ``m log m``.

Search. Texts of equal multisets are one class from the start. Classes that agree on
all rows of a band share a bucket; the bucket's leader is the member that shares most
buckets with others, so in a family of copies the text they were made from. A leader's
star is all classes of its buckets; each is compared with the leader by exact multiset
overlap of whole texts. Linked classes form components.

Members of a bucket outside its leader's component may still be linked to another
member. Each such bucket takes as pivot the class of its leader's component that shares
most buckets, and all its members are compared with the pivot ``c``. Were an open member
``u``, one outside the pivot's component, linked to a member ``m``, then
``|u & m| >= k (|u| + |m|)``, k = t / (1 + t), and at most ``|u & c|`` of that lies in ``c``. So
they share a shingle in excess of ``c``, unless ``k (|u| + |m|) <= |u & c|``, which the sizes
alone tell. Of an open member the ``(1 - t) |u| + 1`` smallest such shingles suffice (prefix
filter). If most linked members share an excess, the pivot itself is a copy with edits, and
the linked member with most of that excess takes its place.

Candidates are pairs of a pivot's members that share such a shingle. One minus the
similarity is a metric, so their distances to the pivot must differ by no more than
``1 - t``, and where all excess of both is known, what they share of it must suffice: that is
counted in short lists, and bounded by the places of the shared shingle in long ones.
What is left is verified. No bucket pair that could join two components is lost, and families of
copies do not emit their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import as_strings, chunks, mix64, shingle_hashes, word_hashes
from lattica.llm.workspace import Workspace

THRESHOLD = 0.8
BANDS, ROWS = 20, 4
_BYTES = 1 << 20
_KEY_BITS = np.uint64(50)
#: Shingles of a sorted excess that go with each of its rows.
_HEAD = 64
#: Texts of one vectorised step: their index takes the other 14 bits of a composite key.
_TEXTS = 1 << 14
_GOLDEN = 0x9E3779B97F4A7C15


def _seed(k: int) -> np.uint64:
    return np.uint64((k + 1) * _GOLDEN % (1 << 64))


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def multisets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts: composite key (text index, 50-bit shingle), count, text index."""
    if len(texts) > _TEXTS:
        raise ValueError(f"{len(texts)} texts in a step, more than {_TEXTS}")
    grams, offsets = shingle_hashes(*word_hashes(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(offsets))
    keys = np.sort((owner << _KEY_BITS) | (grams >> (np.uint64(64) - _KEY_BITS)))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))), (keys[first] >> _KEY_BITS).astype(np.int64)


def bag_minhash(shingles: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n, m) of ``n`` weighted sets given as flat arrays; an empty set's is all zero."""
    times, sig = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    base = mix64(shingles & ((np.uint64(1) << _KEY_BITS) - np.uint64(1)))
    node, level = [np.arange(len(base))], [np.zeros(len(base), np.int64)]
    top = int(weights.max()) if len(weights) else 0
    for k in range(1, max(1, top - 1).bit_length() + 1):
        more = np.flatnonzero(weights > 1 << (k - 1))
        node.append(more)
        level.append(np.full(len(more), k))
    node, level = np.concatenate(node), np.concatenate(level)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    rate = np.maximum(low, 1)
    seed, doc, w = mix64(base[node] + (level.astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLDEN)), owner[node], weights[node]
    x, step = np.zeros(len(node)), 0
    while len(doc):
        g = int(np.clip(40_000 // len(doc), 1, 64))
        h = mix64(seed[:, None] + (np.arange(step, step + g, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[None, :])
        points = x[:, None] + np.cumsum(-np.log(_unit(h)), axis=1) / rate[:, None]
        x, step = points[:, -1].copy(), step + g
        marks = low[:, None] + (_unit(mix64(h + _seed(1))) * rate[:, None]).astype(np.int64)
        ids = mix64(h + _seed(2))
        valid = marks < w[:, None]
        at = (doc[:, None] * m + (ids % np.uint64(m)).astype(np.int64))[valid]
        points, ids = points[valid], ids[valid]
        near = points < times[at]
        at, points, ids = at[near], points[near], ids[near]
        np.minimum.at(times, at, points)
        best = times[at] == points
        sig[at[best]] = ids[best]
        alive = x < times.reshape(n, m).max(axis=1)[doc]
        seed, doc, w, x, low, rate = seed[alive], doc[alive], w[alive], x[alive], low[alive], rate[alive]
    return sig.reshape(n, m)


def _signatures(bands: int, rows: int):
    """Of (doc_id, text_hash, rid, text): the first three, a digest of the multiset, its weight and buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(as_strings(batch.column(3)), _BYTES, _TEXTS):
                n = len(part)
                keys, counts, owner = multisets(part)
                sig = bag_minhash(keys, counts, owner, n, bands * rows)
                buckets = np.zeros((n, bands), np.uint64)
                for j in range(rows):
                    buckets = mix64(buckets + sig[:, j::rows] + _seed(j))
                buckets = mix64(buckets + np.arange(bands, dtype=np.uint64)).view(np.int64)
                weight = np.bincount(owner, counts, n).astype(np.int64)
                entry = mix64((keys & ((np.uint64(1) << _KEY_BITS) - np.uint64(1))) * np.uint64(_GOLDEN) + counts.astype(np.uint64))
                digest = np.zeros((2, n), np.uint64)
                np.add.at(digest[0], owner, entry)
                np.add.at(digest[1], owner, mix64(entry + _seed(7)))
                full = weight > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))])
                names = ["doc_id", "text_hash", "rid", "digest_1", "digest_2", "weight", "buckets"]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(buckets[full].reshape(-1)))
                yield pa.record_batch([*(batch.column(k).slice(first, n) for k in range(3)), *map(pa.array, digest.view(np.int64)), pa.array(weight), lists], names=names)

    return run


def overlaps(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Of each pair of texts: the size of the shingle multisets' intersection and of their
    union; then what the right texts have in excess: owner and hash of each occurrence."""
    n = len(left)
    ka, ca, oa = multisets(left)
    kb, cb, ob = multisets(right)
    at = np.searchsorted(ka, kb)
    at_safe = np.minimum(at, max(len(ka) - 1, 0))
    other = np.where((at < len(ka)) & (ka[at_safe] == kb), ca[at_safe], 0) if len(ka) else np.zeros(len(kb), np.int64)
    common = np.minimum(cb, other)
    shared = np.bincount(ob, common, n).astype(np.int64)
    total = (np.bincount(oa, ca, n) + np.bincount(ob, cb, n)).astype(np.int64) - shared
    more = cb - common
    owner = np.repeat(ob, more)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more) + np.repeat(common, more)
    shingle = np.repeat(kb & ((np.uint64(1) << _KEY_BITS) - np.uint64(1)), more)
    return shared, total, (owner, mix64(shingle * np.uint64(_GOLDEN) + nth.astype(np.uint64)))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array, pa.Array]]:
    """Row ranges of a batch of pairs with their two texts, bounded in bytes."""
    left, right = as_strings(batch.column("text_a")), as_strings(batch.column("text_b"))
    ends = np.cumsum((pc.binary_length(left).to_numpy() + pc.binary_length(right).to_numpy()).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = min(at + _TEXTS, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BYTES, side="right"))))
        yield at, stop, left.slice(at, stop - at), right.slice(at, stop - at)
        at = stop


def _star_verifier(threshold: float):
    """Of (a, b, texts): a, b, inter, their distance, linked, and b's excess over a in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop, left, right in _pieces(batch):
                n = stop - at
                shared, total, (owner, excess) = overlaps(left, right)
                linked = (shared >= threshold * total - 1e-9) & (total > 0)
                size = shared + np.bincount(owner, minlength=n)
                limit = np.where(linked, size, np.floor((1 - threshold) * size + 1e-9).astype(np.int64) + 1)
                order = np.lexsort((excess, owner))
                owner, excess = owner[order], excess[order]
                rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
                keep = rank < limit[owner]
                lengths = np.bincount(owner[keep], minlength=n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(excess[keep].view(np.int64)))
                yield pa.record_batch([batch.column("a").slice(at, n), batch.column("b").slice(at, n), pa.array(shared), pa.array(1 - shared / np.maximum(total, 1)), pa.array(linked), lists], names=["a", "b", "inter", "far", "linked", "excess"])

    return run


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for at, stop, left, right in _pieces(batch):
                shared, total, _ = overlaps(left, right)
                keep[at:stop] = (shared >= threshold * total - 1e-9) & (total > 0)
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, comp) of every node with an edge; ``comp`` is one of the component's nodes.

    Each node points at its least neighbour if that is less than itself, pointers are
    doubled until all end at a root, and edges between roots are what is left to do. A
    star takes one round, and the edges of any graph at least halve their roots.
    """
    labels = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = ws.stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parents")
        moved = 1
        while moved:
            jump = roots.select(F.col("a").alias("p"), F.col("p").alias("q"))
            twice = roots.join(jump, "p").select("a", F.col("q").alias("p"))
            jump = twice.select(F.col("a").alias("p"), F.col("p").alias("q"))
            roots, moved = ws.counted(twice.join(jump, "p").select("a", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "roots", F.col("moved"))
            roots = roots.drop("moved")
        if labels is None:
            labels = roots.select(F.col("a").alias("node"), F.col("p").alias("comp"))
        else:
            labels = labels.join(roots.select(F.col("a").alias("comp"), "p"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
        edges, n = ws.counted(_relabelled(edges, roots.select(F.col("a").alias("node"), F.col("p").alias("comp"))), "edges")
        if not n:
            return labels


def _relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct edges between different components; nodes without a label are their own."""
    of = lambda key: labels.select(F.col("node").alias(key), F.col("comp").alias(f"{key}_comp"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    return ends.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hash_of_text(text_col: str = "text") -> Column:
    """The 64-bit hash that tells rows of one id apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept.

    Two documents are linked when the multisets of their five-word shingles have a
    weighted Jaccard similarity of at least ``threshold``; classes are the connected
    components. ``class_id`` is the smallest doc_id of the class and that row is kept (a
    null id never beats another; a class of null ids only keeps them all, and rows that
    repeat the kept id are all kept). A text of fewer than five words is one shingle of
    all its words; texts without a word, null among them, are one class. Other columns
    are ignored whatever their names. ``with_hash`` adds text_hash, as :func:`hash_of_text`.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "neardup")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), hash_of_text(text_col).alias("text_hash"), F.monotonically_increasing_id().alias("rid"), text.alias("text"))
    signed = ws.stage(source.mapInArrow(_signatures(bands, rows), "doc_id long, text_hash long, rid long, digest_1 long, digest_2 long, weight long, buckets array<long>"), "signed")

    # One class for each multiset; its number is that of the row whose text stands for it.
    digest = ["digest_1", "digest_2"]
    classes = ws.stage(signed.groupBy(*digest).agg(F.min("rid").alias("cls")), "classes")
    entries, n = ws.counted(_entries(ws, signed, classes), "entries")
    comps = _linked_components(ws, source, signed, entries, threshold) if n else None

    own = ["doc_id", "text_hash"] if with_hash else ["doc_id"]
    labelled = signed.select(*own, *digest).join(classes, digest)
    if comps is not None:
        labelled = labelled.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("cls", F.coalesce("comp", "cls"))
    sizes = labelled.groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return ws.finish(labelled.select(*own, "cls").join(sizes, "cls").select(*own, "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")))


def _linked_components(ws: Workspace, source: DataFrame, signed: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """(node, comp) of the classes that are linked to another."""
    texts = ws.stage(_candidate_texts(source, signed, entries), "texts")
    near = F.least("weight", "leader_weight") >= threshold * F.greatest("weight", "leader_weight") - 1e-9
    pairs = entries.where("cls != leader").where(near).select(F.col("leader").alias("a"), F.col("cls").alias("b")).distinct()
    verified = lambda pairs: ws.stage(_with_texts(pairs, texts).mapInArrow(_verifier(threshold), "a long, b long"), "links")
    comps = components(ws, verified(pairs))
    members, n = ws.counted(_pivots(entries, comps), "members")
    if not n:
        return comps
    measured = lambda pairs: ws.stage(_with_texts(pairs.select("a", "b"), texts).mapInArrow(_star_verifier(threshold), "a long, b long, inter long, far double, linked boolean, excess array<long>"), "stars")
    star = measured(members)
    better, n = ws.counted(_better_pivots(star), "better")
    if n:
        moved = members.join(better, "a")
        moved = moved.select(F.col("pivot").alias("a"), "b", "weight", F.lit(0).cast("long").alias("a_weight")).union(moved.select(F.col("pivot").alias("a"), F.col("a").alias("b"), F.col("a_weight").alias("weight"), F.lit(0).cast("long")))
        moved = ws.stage(moved.where("a != b").distinct(), "moved")
        star = star.join(better, "a", "left_anti").union(measured(moved))
        members = members.join(better, "a", "left_anti").union(moved)
    comps = _joined(ws, comps, star.where("linked").select("a", "b"))
    pairs, n = ws.counted(_open_pairs(ws, star, members, comps, threshold), "open")
    return _joined(ws, comps, verified(pairs)) if n else comps


def _joined(ws: Workspace, comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components of the links and of what ``comps`` already joins."""
    between, n = ws.counted(_relabelled(links, comps), "between")
    if not n:
        return comps
    above = components(ws, between)
    alone = above.join(comps.select(F.col("comp").alias("node")), "node", "left_anti").select("node", F.col("node").alias("comp"))
    every = comps.union(alone).join(above.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left")
    return ws.stage(every.select("node", F.coalesce("root", "comp").alias("comp")), "components")


def _entries(ws: Workspace, signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, cls, weight, density, leader, leader_weight) of every class in a shared bucket.

    ``density`` counts the members of all its buckets; the leader has most. Of equal ones
    both aggregates take the same row.
    """
    one_each = signed.join(classes.select(F.col("cls").alias("rid")), "rid", "left_semi")
    rows = ws.stage(one_each.select(F.col("rid").alias("cls"), "weight", F.explode("buckets").alias("bucket")), "buckets")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = ws.stage(rows.join(shared, "bucket"), "rows")
    rows = rows.join(rows.groupBy("cls").agg(F.sum("n").alias("density")), "cls")
    leaders = rows.groupBy("bucket").agg(F.max_by("cls", "density").alias("leader"), F.max_by("weight", "density").alias("leader_weight"))
    return rows.join(leaders, "bucket").select("bucket", "cls", "weight", "density", "leader", "leader_weight")


def _pivots(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """(a, b, weight, a_weight): pivot and member, of buckets of three members or more with several components."""
    of = lambda key: comps.select(F.col("node").alias(key), F.col("comp").alias(f"{key}_comp"))
    rows = entries.join(of("cls"), "cls", "left").join(of("leader"), "leader", "left")
    rows = rows.select("bucket", "cls", "weight", "density", F.coalesce("cls_comp", "cls").alias("comp"), F.coalesce("leader_comp", "leader").alias("leader_comp"))
    best = rows.groupBy("comp").agg(F.max_by("cls", "density").alias("a"), F.max_by("weight", "density").alias("a_weight")).withColumnRenamed("comp", "leader_comp")
    mixed = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("comp") != F.col("leader_comp")).alias("mixed")).where("n > 2 AND mixed").select("bucket")
    rows = rows.join(mixed, "bucket", "left_semi").select("leader_comp", "cls", "weight").distinct().join(best, "leader_comp")
    return rows.where("a != cls").select("a", F.col("cls").alias("b"), "weight", "a_weight")


def _better_pivots(star: DataFrame) -> DataFrame:
    """(a, pivot) of pivots that lack shingles which most of their linked members have."""
    linked = star.where("linked")
    sizes = linked.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n >= 8")
    excess = linked.join(sizes, "a").select("a", "n", "b", "inter", F.explode("excess").alias("shingle"))
    usual = excess.groupBy("a", "n", "shingle").agg(F.count(F.lit(1)).alias("held")).where("2 * held > n").select("a", "shingle")
    held = excess.join(usual, ["a", "shingle"]).groupBy("a", "b", "inter").agg(F.count(F.lit(1)).alias("held"))
    return held.groupBy("a").agg(F.max_by("b", F.col("held") * (1 << 31) + F.col("inter")).alias("pivot"))


def _candidate_texts(source: DataFrame, signed: DataFrame, entries: DataFrame) -> DataFrame:
    """(cls, text) of every class that shares a bucket; rows that repeat id and text give one."""
    key = F.coalesce("doc_id", F.lit(-1).cast("long")).alias("key")
    wanted = signed.join(entries.select(F.col("cls").alias("rid")).distinct(), "rid", "left_semi").select(key, "text_hash", F.col("rid").alias("cls"))
    return source.select(key, "text_hash", "text").join(wanted, ["key", "text_hash"]).dropDuplicates(["key", "text_hash"]).select("cls", "text")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")


def _open_pairs(ws: Workspace, star: DataFrame, members: DataFrame, comps: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a pivot's members that could still join two components, by shared excess or by size."""
    of = lambda key: comps.select(F.col("node").alias(key), F.col("comp").alias(f"{key}_comp"))
    rows = star.join(members.select("a", "b", "weight").distinct(), ["a", "b"])
    rows = rows.join(of("b"), "b", "left").join(of("a"), "a", "left")
    rows = rows.select("a", "b", "weight", "inter", "far", "excess", F.coalesce("b_comp", "b").alias("comp"), (F.coalesce("b_comp", "b") != F.coalesce("a_comp", "a")).alias("open"))
    live = rows.groupBy("a").agg(F.max("open").alias("any"), F.min("weight").alias("least")).where("any").drop("any")
    rows = ws.stage(rows.join(live, "a").withColumn("full", F.size("excess") == F.col("weight") - F.col("inter")), "live")
    own = ["b", "weight", "inter", "far", "comp", "open", "full"]
    place = ["n", "nth", "head"]
    entries = rows.select("a", *own, F.size("excess").alias("n"), F.slice("excess", 1, _HEAD).alias("head"), F.posexplode("excess").alias("nth", "shingle"))
    mixed = entries.groupBy("a", "shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("open").alias("any")).where("low != high AND any").select("a", "shingle")
    entries = ws.stage(entries.join(mixed, ["a", "shingle"], "left_semi"), "excess")
    other = lambda df: df.withColumnsRenamed({c: f"m_{c}" for c in (*own[1:], *place)} | {"b": "m"})
    near = (F.least("weight", "m_weight") >= threshold * F.greatest("weight", "m_weight") - 1e-9) & (F.abs(F.col("far") - F.col("m_far")) <= 1 - threshold + 1e-9)
    pair = (F.least("b", "m").alias("x"), F.greatest("b", "m").alias("y"))
    k = threshold / (1 + threshold)
    # What a link's excess must share, where all of it is known, and what it can share.
    need = F.when(F.col("full") & F.col("m_full"), k * (F.col("weight") + F.col("m_weight")) - F.least("inter", "m_inter") - 1e-6).otherwise(F.lit(0.0))
    both = F.array_intersect("head", "m_head")
    bound = F.least("nth", "m_nth") + F.least(F.col("n") - F.col("nth"), F.col("m_n") - F.col("m_nth"))
    most = F.when((F.col("n") <= _HEAD) & (F.col("m_n") <= _HEAD), F.size(both)).otherwise(bound)
    # A pair once if it shares any of both heads: at the least one.
    once = (~F.col("m_open") | (F.col("b") < F.col("m"))) & F.coalesce(F.array_min(both) == F.col("shingle"), F.lit(True))
    by_excess = entries.where("open").join(other(entries), ["a", "shingle"]).where((F.col("comp") != F.col("m_comp")) & near & once & (most >= need)).select(*pair)
    roomy = rows.where("open").withColumn("room", F.col("inter") / k - F.col("weight") + 1e-6).where("room >= least").select("a", *own, "room")
    by_size = roomy.join(other(rows.select("a", *own)), "a").where("m_weight <= room AND comp != m_comp").where(near).select(*pair)
    return by_excess.union(by_size).distinct().select(F.col("x").alias("a"), F.col("y").alias("b"))
