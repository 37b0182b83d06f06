import zlib

import numpy as np
import pytest
from helpers import AWKWARD, awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import queries
from lattica.llm import tokens as X

PATH = queries.tokenizer_path()
ENCODER = X.WordEncoder(PATH, limit=500)
LETTERS = st.sampled_from(list("abcAZ 'sdt09.,!<|>\n\t\r\x0b\x1c éÉßÿµ²½¿«日İſ́ 😀") + ["'ll", " the ", "<|endoftext|>", "réeux"])


def plain(text):
    return ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(LETTERS, max_size=25).map("".join), max_size=4))
def test_pieces_equal_the_tokenizer(texts):
    for t, raw in zip(texts, ENCODER.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == plain(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([8, 1]), st.integers(1, 70))
def test_file_round_trip(ids, plane_bits, block):
    raw = np.array(ids, "<u4")
    cut = len(ids) // 3
    data = X.encode_file([5, -7], [cut, len(ids) - cut], raw, plane_bits, block)
    docs, counts, back = X.decode_file(data)
    assert docs.tolist() == [5, -7] and counts.tolist() == [cut, len(ids) - cut] and back.tolist() == ids


def test_planes_are_transposed():
    planes = X.to_planes(np.array([1, 256, 65536, 1 << 31], "<u4"), 8)
    assert planes.tolist() == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 128]]
    bits = X.to_planes(np.array([1, 2, 3], "<u4"), 1)
    assert bits.shape == (32, 1) and bits[0, 0] == 0b101 and bits[1, 0] == 0b110


def test_broken_file():
    with pytest.raises(ValueError):
        X.decode_file(b"x" * 40)


@pytest.mark.parametrize("plane_bits", [8, 1])
def test_rows(spark, monkeypatch, plane_bits):
    df = awkward(spark)
    got = sorted((r.doc_id if r.doc_id is not None else X.NO_ID, r.start, r.n_tokens, r.ids_crc32) for r in X.encode_and_read_back(df, PATH, plane_bits=plane_bits, partitions=3).collect())
    want, start = [], 0
    for i, t, *_ in sorted(((X.NO_ID if r[0] is None else r[0], r[1]) for r in AWKWARD), key=lambda r: r[0]):
        ids = np.array([*plain(t or ""), 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert X.encode_and_read_back(empty(spark), PATH).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_token_ids(spark, sf).collect()}
    start = 0
    for d in docs:
        ids = np.array([*plain(d.text or ""), 1], "<u4")
        assert got[d.doc_id] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_other_tokenizer_rules_encode_whole_texts(tmp_path):
    """A file whose rules differ from those of the short way gives that file's own ids."""
    import json

    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    rules = json.loads(Tokenizer.from_file(path).to_str())
    assert X.splits_by_words(rules) and X.WordEncoder(path).by_words
    rules["normalizer"]["normalizers"] = rules["normalizer"]["normalizers"][:2]
    other = f"{tmp_path}/cased.json"
    with open(other, "w") as f:
        json.dump(rules, f)
    encoder, tokenizer = X.WordEncoder(other), Tokenizer.from_file(other)
    texts = ["Upper and lower Case", "", "It's 2024, ok?", "\u65e5\u672c"]
    assert not encoder.by_words
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
