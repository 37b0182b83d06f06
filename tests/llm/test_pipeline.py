import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import test_decontaminate
import test_mixing
import test_neardup
from helpers import awkward, empty, shingles, similarity

import corpus_pipeline as P
from lattica.llm import queries, tokens, toxicity

SF = "/root/testdata/sf0.001"
SMALL = toxicity.Settings(steps=60)


@pytest.fixture
def small_network(monkeypatch):
    fitted = toxicity.fitted
    monkeypatch.setattr(toxicity, "fitted", lambda docs, labels, s=None: fitted(docs, labels, SMALL))


def mixed_by_hand(rows):
    """Ids of the mix: whole documents of which a pass takes at least half."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    groups = defaultdict(list)
    for i, _, source in rows:
        groups[source].append(i)
    target, out = test_mixing.reshared({s: sum(size[i] for i in ids) for s, ids in groups.items()}), []
    for s, ids in groups.items():
        at, owed, total = 0, int(target[s]), sum(size[i] for i in ids)
        for i in sorted(ids, key=lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)):
            for left in (owed - at, owed - total - at):
                out += [i] if size[i] and 2 * min(size[i], left) >= size[i] else []
            at += size[i]
    return out


def test_run_against_brute_force(spark, small_network):
    """The whole pipeline, stage by stage in plain Python."""
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    net = toxicity.fitted(docs, labels)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    rows = [r for r, p in zip(rows, toxicity._Scorer(net).scores([t or "" for _, t, _ in rows]), strict=True) if p < toxicity.THRESHOLD]
    kept = {i for i, _, _, keep in test_neardup.brute([(i, t or "") for i, t, _ in rows]) if keep}
    rows = [r for r in rows if r[0] in kept]
    leaked = {i for i, *_ in test_decontaminate.brute([(i, t) for i, t, _ in rows], [(r.item_id, r.text) for r in items.collect()])}
    text = {i: t for i, t, _ in rows}
    ids = sorted(mixed_by_hand([r for r in rows if r[0] not in leaked]))
    encoder, want, start = tokens.WordEncoder(queries.tokenizer_path()), [], 0
    for i in ids:
        raw = encoder.tokenizer.encode(text[i] or "", add_special_tokens=False).ids + [tokens.END_ID]
        want.append((i, start, len(raw), zlib.crc32(np.array(raw, "<u4").tobytes())))
        start += len(raw)
    got = P.run(spark, SF)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == want and len(want) > 100


def test_stages(spark, small_network, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns, name
        if name == "near-duplicates":
            kept = [shingles(texts[r.doc_id]) for r in docs.collect()]
            having = {}
            for i, s in enumerate(kept):
                for g in s:
                    having.setdefault(g, []).append(i)
            close = {(a, b) for ids in having.values() for n, a in enumerate(ids) for b in ids[n + 1 :]}
            assert not [p for p in close if similarity(kept[p[0]], kept[p[1]]) >= 0.8]
    # Toxic, repeated and leaked documents went; the mix repeats; files hold the mix.
    assert counts[0] > counts[1] * 0.99 and counts[1] > counts[2] >= counts[3] and counts[1] > 0.8 * counts[0]
    assert counts[4] > counts[3] and counts[5] == counts[4]


def test_awkward_rows(spark, small_network):
    """Nulls, repeats and clashing columns go through every stage, toxicity first."""
    docs = awkward(spark)
    for name, stage in P.STAGES:
        columns, docs = docs.columns, stage(spark, docs, SF)
        assert docs.count() > 0, name
        assert name == "token ids" or docs.columns == columns, name


def test_empty_table(spark, small_network):
    docs = empty(spark)
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name


def test_near_duplicates_of_nulls(spark):
    docs = awkward(spark)
    kept = P.keep_one_of_each_class(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 6, 7, 8, None], key=repr)


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id with different texts go by their own class; null ids go too."""
    a, b, c = ("one two three four five six", "alpha beta gamma delta epsilon zeta", "a text that only one row has")
    rows = [(5, a), (7, a), (3, b), (5, b), (9, c), (None, c), (None, "null ids"), (None, "null ids"), (8, None), (None, "")]
    kept = P.keep_one_of_each_class(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(5, a), (3, b), (9, c), (None, "null ids"), (None, "null ids"), (8, None)], key=repr)
