import hashlib
from collections import defaultdict

import pytest
from helpers import AWKWARD, awkward, empty
from oracle import connect, same

from lattica.llm import queries
from lattica.llm import sharding as X


def bits(i):
    return f"{int(hashlib.md5(('null' if i is None else str(i)).encode()).hexdigest()[:15], 16):060b}"


def check(rows, got, limit):
    """Extendible hashing by the id's bits while ids differ, then by the text's and the row's."""
    want, todo = {}, [("", [(bits(i), i, len((t or "").encode())) for i, t, *_ in rows])]
    while todo:
        prefix, members = todo.pop()
        alone = len({m[0] for m in members}) == 1
        if sum(m[2] for m in members) <= limit or alone:
            whole = sum(m[2] for m in members) <= limit or len(members) == 1
            for m in members:
                want[m[1], m[2]] = (prefix if whole else m[0], whole)
        else:
            for b in "01":
                part = [m for m in members if m[0].startswith(prefix + b)]
                todo += [(prefix + b, part)] if part else []
    sizes, count = defaultdict(int), defaultdict(int)
    for r in got:
        prefix, whole = want[r.doc_id, r.bytes]
        assert r.shard == prefix if whole else r.shard.startswith(prefix), r
        sizes[r.shard] += r.bytes
        count[r.shard] += 1
    assert sorted((r.doc_id or -1, r.bytes) for r in got) == sorted((i or -1, len((t or "").encode())) for i, t, *_ in rows)
    for r in got:
        assert r.depth == len(r.shard) and r.shard_bytes == sizes[r.shard] and r.shard_docs == count[r.shard]
        assert r.shard_bytes <= limit or r.shard_docs == 1
    names = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))


@pytest.mark.parametrize("limit", [0, 10, 200, 10_000, 1 << 30])
def test_awkward_rows(spark, limit):
    check(AWKWARD, X.assign_shards(awkward(spark), max(limit, 1)).collect(), max(limit, 1))


def test_hot_ids_split_by_text_and_row(spark):
    """A third of all rows without an id, a third that repeat one row: every shard fits all the same."""
    rows = [(None, "n" * (i % 50)) for i in range(300)] + [(7, "same text in every row")] * 300 + [(i, "x" * 40) for i in range(300)] + [(9, "y" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, X.assign_shards(df, 400).collect(), 400)
    check(rows, X.assign_shards(df, 20_000).collect(), 20_000)


def test_only_large_buckets_split(spark):
    rows = [(i, "x" * (50 + i % 100)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, X.assign_shards(df, 3000).collect(), 3000)
    assert X.assign_shards(empty(spark)).count() == 0


def test_written_shards(spark, tmp_path):
    df = awkward(spark)
    listed = X.write_shards(df, f"{tmp_path}/out", 100)
    back = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out")
    assert back.count() == len(AWKWARD) == sum(r.docs for r in listed.collect())
    assert set(df.columns) < set(back.columns)


def test_native(spark):
    assert "Python" not in X.assign_shards(awkward(spark))._jdf.queryExecution().executedPlan().toString()


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert {len(r.shard) for r in queries.op7_sharding(spark, sf).select("shard").distinct().collect()} - {0}
    same(queries.op7_sharding(spark, sf), connect(sf), queries.ORACLE_SQL["op7_sharding"])
