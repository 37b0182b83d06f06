import zlib

import duckdb
import numpy as np
from helpers import awkward, empty

from lattica.llm import queries
from lattica.llm import toxicity as X

SMALL = X.Settings(steps=60, word_rows=512, char_rows=2048, toxic_rows=60, clean_rows=120)


def corpus(n, rng):
    plain = ["".join(rng.choice(list("aeioutrnsl"), rng.integers(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        w = list(rng.choice(plain, rng.integers(20, 200)))
        if i % 3 == 0:
            for _ in range(3):
                w.insert(int(rng.integers(len(w))), rng.choice(["zorkface", "blarghead", "zorkling"]))
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    return texts, labels


def auc(y, p):
    rank = np.argsort(np.argsort(p)) + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_learns_and_generalises():
    rng = np.random.default_rng(1)
    net = X.train(*corpus(150, rng), SMALL)
    texts, y = corpus(90, rng)
    p = X._Scorer(net).scores(texts)
    assert auc(np.array(y), p) > 0.95 and ((p >= 0) & (p <= 1)).all()


def test_gradient_matches_differences():
    s = X.Settings(window=6, stride=3, hidden=3, word_dim=2, char_dim=3, word_rows=16, char_rows=64)
    net = X.Network.new(s)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    index = np.array([[1, 2, 3, 1, 0, 0], [3, 3, 2, 1, 2, 1]])
    gates = np.concatenate([np.zeros((1, 2, 9)), rng.standard_normal((3, 2, 9))])
    up = rng.standard_normal(2)
    _, kept = net.forward(gates, index, keep=True)
    g, _ = net.backward(up, kept)
    for name in ("u", "bn", "wa", "ba", "va", "wo", "bo"):
        flat, at = net.p[name].reshape(-1), rng.integers(net.p[name].size)
        old, e = flat[at], 1e-4
        flat[at] = old + e
        high = net.forward(gates, index) @ up
        flat[at] = old - e
        low = net.forward(gates, index) @ up
        flat[at] = old
        assert abs((high - low) / (2 * e) - g[name].reshape(-1)[at]) < 1e-3 * max(1, abs(g[name].reshape(-1)[at])), name


def test_windows_cover_the_whole_text():
    s = X.Settings()
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        index, owner = X.window_index(np.arange(1, n + 1), np.array([0, n]), s)
        assert set(index[index > 0].tolist()) == set(range(1, n + 1))
        assert len(index) == 0 or (np.diff(index[:, 0]) == s.stride).all()


def test_late_words_count():
    rng = np.random.default_rng(2)
    net = X.train(*corpus(150, rng), SMALL)
    clean = " ".join(corpus(2, rng)[0][1].split() * 30)
    low, high = X._Scorer(net).scores([clean, clean + " zorkface and zorkling blarghead"])
    assert high > low + 0.2


def test_inside_of_long_words_counts():
    """A run of 5,000 letters is read whole: a toxic stretch anywhere in it changes the score."""
    rng = np.random.default_rng(4)
    net = X.train(*corpus(150, rng), SMALL)
    run = "".join(rng.choice(list("aeioutrnsl"), 5000))
    assert "".join(w[: X.PART_STRIDE] for w in X.words_of(run)).startswith(run[:4980]) and X.words_of(run)[-1].endswith(run[-4:])
    rise = []
    for at in (6, 800, 2501, 2502, 2503, 4980):
        plain, marked = X._Scorer(net).scores([run, run[:at] + "zorkfaceblarghead" + run[at + 17 :]])
        assert marked != plain, at
        rise.append(marked - plain)
    assert np.mean(rise) > 0.02


def test_awkward_rows_and_held_out(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (8, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = X.score_documents(df, labels, SMALL).collect()
    assert len(out) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert len({r.score for r in out if r.doc_id == 5}) == 1
    assert X.score_documents(empty(spark), labels.where("false"), SMALL).count() == 0
    assert X.drop_toxic(df, labels, SMALL).columns == df.columns


def test_query_on_rows_held_out(spark):
    """The registered query, with its own parameters, on the labelled rows that it must not learn from."""
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect()}
    rows = queries.op2_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    p, y = np.array([r.score for r in held]), np.array([toxic[r.doc_id] for r in held])
    print("held out:", len(held), "AUC", auc(y, p), "recall", (p[y == 1] >= 0.3).mean(), "false", (p[y == 0] >= 0.3).mean())
    assert auc(y, p) > 0.94 and (p[y == 1] >= 0.3).mean() > 0.85 and (p[y == 0] >= 0.3).mean() < 0.03


def test_held_out_accuracy():
    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT d.doc_id, coalesce(text, ''), toxic FROM '{sf}/documents.parquet' d JOIN '{sf}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    held = [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]
    train = [r for r, h in zip(rows, held, strict=True) if not h]
    toxic, clean = [r for r in train if r[2]], [r for r in train if not r[2]][:900]
    net = X.train([r[1] for r in toxic + clean], [r[2] for r in toxic + clean], X.Settings(steps=200))
    test = [r for r, h in zip(rows, held, strict=True) if h]
    p, y = X._Scorer(net).scores([r[1] for r in test]), np.array([r[2] for r in test])
    assert auc(y, p) > 0.9
    assert (p[y == 1] >= 0.3).mean() > 0.75 and (p[y == 0] >= 0.3).mean() < 0.05
