import random

from helpers import awkward, empty, shingles, words

from lattica.llm import decontaminate as X
from lattica.llm import queries


def brute(docs, items, threshold=0.8):
    out = set()
    for i, t in docs:
        w = words(t)
        for j, q in items:
            wanted = set(shingles(q))
            if not wanted:
                continue
            width = min(5, len(words(q)))
            have = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
            n = len(wanted & have)
            if n >= threshold * len(wanted):
                out.add((i, j, len(wanted), n))
    return out


def test_random_passages(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 5, 6, 9, 20, 60, 200])))) for k in range(60)]
    docs = []
    for d in range(200):
        w = rng.choices(vocab, k=rng.randint(0, 900))
        for _ in range(rng.randint(0, 2)):
            q = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 0, 1, 2, len(q) // 30])):
                q[rng.randrange(len(q))] = "edit"
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + rng.choice(["", ",", "."]) for x in q]
        docs.append((d, " ".join(w)))
    got = X.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id, r.n_item_shingles, r.n_found) for r in got.collect()}
    assert got == brute(docs, items) and len(got) > 30


def test_awkward_rows(spark, monkeypatch):
    items = spark.createDataFrame([(1, "one"), (1, "one"), (2, None), (3, ""), (4, "gamma delta EPSILON zeta eta"), (None, "a row without an id"), (5, "word word word word word word")], "item_id long, text string")
    df = awkward(spark)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    want = [(1, 4), (5, 4), (5, 4), (6, 5), (8, 1), (9, 1), (None, None)]
    got = sorted(((r.doc_id, r.item_id) for r in X.find_leaks(df, items).collect()), key=key)
    assert got == want
    monkeypatch.setattr(X, "BLOCK_ITEMS", 2)  # several blocks give the same
    assert sorted(((r.doc_id, r.item_id) for r in X.find_leaks(df, items).collect()), key=key) == want
    kept = X.drop_leaked(df, items)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 7]
    assert X.find_leaks(empty(spark), items).count() == X.find_leaks(df, items.where("false")).count() == 0
    assert X.drop_leaked(df, items.where("false")).count() == df.count()


def test_sketch_cannot_miss():
    for n in range(1, 400):
        assert X.sketch_size(n) > n - -(-8 * n // 10) or X.sketch_size(n) == n


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t, k: [(r[k], r.text) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    got = {(r.doc_id, r.item_id, r.n_item_shingles, r.n_found) for r in queries.op8_decontaminate(spark, sf).collect()}
    assert got == brute(read("documents", "doc_id"), read("benchmark", "item_id"))


def test_large_benchmark_is_joined(spark, monkeypatch):
    """A benchmark over the broadcast's bounds gives the same leaks by equal hashes."""
    monkeypatch.setattr(X, "BLOCK_CHARS", 100)
    test_random_passages(spark)
    test_query_against_brute_force(spark)
    docs = spark.createDataFrame([(1, "a b c d e f"), (None, "a b c d e f"), (1, "other words that are clean"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "A b c d e f " + "x" * 0), (2, "z" * 200)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in X.drop_leaked(docs, items).collect()) == [(1, "other words that are clean"), (2, "")]


def test_partitions_by_size():
    for n in range(1, 300):
        c = X.size_class(n)
        assert ((1 << (c - 1)) + 1 if c else 1) <= n <= 1 << c
