import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, awkward, empty, shingles, similarity

from lattica.llm import neardup as X
from lattica.llm import queries
from lattica.llm.workspace import Workspace


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s or [None]:
            having[g].append(i)
    pairs = {(a, b) for ids in having.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in pairs:
        if sets[a] == sets[b] or similarity(sets[a], sets[b]) >= threshold:
            parent[root(b)] = root(a)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = []
    for ids in groups.values():
        low = min((rows[i][0] for i in ids if rows[i][0] is not None), default=None)
        out += [(rows[i][0], low, len(ids), rows[i][0] == low) for i in ids]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.class_id, r.class_size, r.kept) for r in df.collect()), key=repr)


def test_awkward_rows(spark):
    assert rows_of(X.near_duplicates(awkward(spark))) == brute([r[:2] for r in AWKWARD])
    assert X.near_duplicates(empty(spark)).count() == 0


def test_families_of_copies(spark):
    """Copies with edits around the threshold: stars, pivots and excess must find all links."""
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(400)]
    rows = []
    for _ in range(4):
        base = rng.choices(vocab, k=120)
        rows += [" ".join(base)] * 3
        for _ in range(70):
            w = list(base)
            for _ in range(rng.choice([1, 2, 3, 4, 5, 8])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choices(vocab, k=rng.choice([0, 1, 1, 2]))
            rows.append(" ".join(w))
            if rng.random() < 0.3:  # copies of copies: links that no pivot has
                w[rng.randrange(len(w))] = "again"
                rows.append(" ".join(w))
    rows += [" ".join(rng.choices(vocab, k=rng.randint(1, 200))) for _ in range(100)]
    rows = list(enumerate(rows))
    assert rows_of(X.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_large_batches_of_short_texts(spark):
    """Batches of more texts than the composite key can number are cut."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50_000)
    try:
        rows = spark.range(30_000).coalesce(1).selectExpr("id AS doc_id", "concat('w', id) AS text")
        out = X.near_duplicates(rows)
        assert out.count() == 30_000 and out.where("class_size > 1").isEmpty()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(ValueError, match="texts in a step"):
        X.multisets(pa.array(["a"] * 16_385, pa.large_string()))


def test_long_near_copies(spark):
    """Texts of 20,000 words with edits around the threshold, and copies of copies."""
    rng = random.Random(5)
    base = [f"v{rng.randrange(5000)}" for _ in range(20_000)]
    rows = [" ".join(base)]
    for share in (0.01, 0.02, 0.03, 0.04, 0.042, 0.044, 0.05, 0.06):
        for _ in range(2):
            w = list(base)
            for at in rng.sample(range(len(w)), int(share * len(w))):
                w[at] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(w))
            v = list(w)
            for at in rng.sample(range(len(v)), 300):
                v[at] = "again"
            rows.append(" ".join(v))
    rows = list(enumerate(rows))
    assert rows_of(X.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_components_of_chains(spark):
    """Long chains, stars and pairs, against the labels of a plain search."""
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1100)] + [(5000 + 2 * i, 5001 + 2 * i) for i in range(20)] + [(1100, 1050)]
    rng.shuffle(edges)
    found = X.components(Workspace(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r.comp].add(r.node)
    want = [set(range(301)), set(range(1000, 1101))] + [{5000 + 2 * i, 5001 + 2 * i} for i in range(20)]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want)) and len(found) == 301 + 101 + 40


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    for wa, wb in (({1: 1, 2: 1, 3: 1}, {2: 1, 3: 1, 4: 1}), ({1: 5, 2: 3}, {1: 3, 2: 4, 3: 2}), ({1: 100, 2: 7}, {1: 60, 2: 9}), ({9: 1}, {9: 3})):
        want = sum(min(wa.get(k, 0), wb.get(k, 0)) for k in wa | wb) / sum(max(wa.get(k, 0), wb.get(k, 0)) for k in wa | wb)
        agree = []
        for _ in range(40):
            salt = rng.integers(1 << 40)
            keys = np.array([k * 7919 + salt for k in (*wa, *wb)], np.uint64)
            sig = X.bag_minhash(keys, np.array([*wa.values(), *wb.values()]), np.array([0] * len(wa) + [1] * len(wb)), 2, 64)
            agree.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(agree) - want) < 0.05


def test_overlap_is_exact():
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdefg", k=rng.randint(0, 60))) for _ in range(60)]
    left, right = texts[:30], texts[30:]
    shared, total, (owner, _) = X.overlaps(pa.array(left, pa.large_string()), pa.array(right, pa.large_string()))
    for i in range(30):
        a, b = shingles(left[i]), shingles(right[i])
        assert shared[i] == sum((a & b).values()) and total[i] == sum((a | b).values())
        assert (owner == i).sum() == sum((b - a).values())


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(queries.op10_near_dedup(spark, sf)) == brute(rows)
