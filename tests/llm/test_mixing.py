import re
from collections import defaultdict

import pytest
from helpers import AWKWARD, awkward, empty
from oracle import connect, same

from lattica.llm import mixing as X
from lattica.llm import queries


def reshared(sizes, budget=1.5):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    left, target, free = budget * sum(sizes.values()), {}, list(names)
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 2 * sizes[s]]
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def check(rows, out):
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = reshared(dict(sizes))
    source = {i: s for i, t, _, s in rows}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert (r.first_position is not None) == (r.taken > 0) and (r.second_position is not None) == (r.taken > r.size)
        assert all(0 <= p <= 1 for p in (r.first_position, r.second_position) if p is not None)
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1


def test_awkward_rows(spark):
    out = X.assign(awkward(spark)).collect()
    assert len(out) == len(AWKWARD)
    check(AWKWARD, out)
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, X.assign(awkward(spark).repartition(7)).collect()), key=repr)
    assert X.assign(empty(spark)).count() == 0


def test_many_sources_and_slices(spark, monkeypatch):
    monkeypatch.setattr(X, "SLICE_DOCS", 10)
    rows = [(i, "w " * (1 + i * 7 % 40), "en", None if i % 11 == 0 else f"s{min(i % 7, 3)}") for i in range(600)]
    check(rows, X.assign(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect())


def test_tilts_move_positions(spark):
    rows = [(i, "w " * 20, "en", "abc"[i % 3]) for i in range(900)]
    out = X.assign(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    mean = {k: sum(r.first_position for r in out if r.doc_id % 3 == k and r.taken) / sum(1 for r in out if r.doc_id % 3 == k and r.taken) for k in (0, 2)}
    # Source a (tilt 0.5) reaches its words earlier than c (tilt -0.5); both repeat all documents.
    assert mean[0] < mean[2]


def test_mixed_documents(spark):
    rows = [(i, f"w{i} " * (1 + i % 30), "en", f"s{min(i % 5, 2)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = {r.doc_id: (r.taken, r.size) for r in X.assign(df).collect()}
    mixed = X.mix_documents(df)
    assert mixed.columns == df.columns
    copies = defaultdict(int)
    for r in mixed.collect():
        copies[r.doc_id] += 1
    wrong = [i for i, (t, s) in taken.items() if abs(copies[i] * s - t) > s / 2]
    assert not wrong
    assert X.mix_documents(df.where("false")).count() == 0
    assert X.mix_documents(awkward(spark)).columns == awkward(spark).columns


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    same(queries.op4_mixing(spark, sf), connect(sf), queries.ORACLE_SQL["op4_mixing"])


def test_mixed_documents_stand_in_order_of_position(spark, monkeypatch):
    """The order of the mix is that of the exact positions, over slices and sources."""
    monkeypatch.setattr(X, "SLICE_DOCS", 20)
    rows = [(i, f"w{i} " * (1 + i * 7 % 30), "en", f"s{min(i % 5, 2)}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = []
    for r in X.assign(df).collect():
        first = min(r.taken, r.size)
        want += [(r.first_position, r.doc_id)] if r.size and 2 * first >= r.size else []
        want += [(r.second_position, r.doc_id)] if r.size and 2 * (r.taken - first) >= r.size else []
    got = [r.doc_id for r in X.mix_documents(df).collect()]
    position = defaultdict(list)
    for p, i in sorted(want):
        position[i].append(p)
    order = [position[i].pop(0) for i in got]
    assert len(got) == len(want) and order == sorted(order)
