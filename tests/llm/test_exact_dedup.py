import hashlib
from collections import defaultdict

import numpy as np
from helpers import AWKWARD, awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, same

from lattica.llm import exact_dedup as X
from lattica.llm import queries

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[hashlib.sha256((t or "").translate(UP).encode()).hexdigest()].append(i)
    out = []
    for digest, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def test_awkward_rows(spark):
    df = awkward(spark)
    for bucket in (1, 512):
        assert rows_of(X.dedup_by_arrival(df, bucket=bucket)) == brute(AWKWARD)
    assert rows_of(X.exact_dedup(df.where("doc_id > 4"), df.where("doc_id <= 4 OR doc_id IS NULL"), bucket=2)) == brute(AWKWARD)
    assert rows_of(X.exact_dedup(df)) == brute(AWKWARD)
    assert X.dedup_by_arrival(empty(spark)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**32))
def test_hash_is_minimal_and_perfect(n, seed):
    keys = np.unique(np.random.default_rng(seed).integers(0, 2**63, n).astype(np.uint64))
    levels, bits, slots = X.build_mph(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert (X.find_slots(keys, levels, bits) == slots).all()
    assert bits.sum() == len(keys)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    same(queries.op1_exact_dedup(spark, sf), connect(sf), queries.ORACLE_SQL["op1_exact_dedup"])
