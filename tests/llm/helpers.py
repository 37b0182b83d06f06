"""Brute-force counterparts and awkward rows shared by the tests."""

import collections
import re

import pyarrow.compute as pc
import pyarrow as pa

#: Nulls, empty and blank texts, ties, repeats, a very long text, odd characters.
AWKWARD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "s1"),
    (2, None, None, None),
    (3, "", "en", "s1"),
    (4, "   \n\t ", "en", "s2"),
    (5, "ALPHA beta gamma delta epsilon zeta eta theta", "en", "s2"),
    (5, "ALPHA beta gamma delta epsilon zeta eta theta", "en", "s2"),
    (6, "word " * 30_000, "de", "s1"),
    (7, "İstanbul É ß 日本 \U0001f600 a\x00b <|endoftext|> it's", "xx", None),
    (8, "one", "en", "s3"),
    (None, "a row without an id", "en", "s3"),
    (9, "one", "en", "s3"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def awkward(spark, ids=True):
    """The rows with columns whose names clash with ones that operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([r for r in AWKWARD if ids or r[0] is not None], SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in ("digest", "keep_id", "score", "cls", "key", "size", "bytes", "h", "src", "row", "position", "n_chars")])


def empty(spark):
    return awkward(spark).where("false")


def words(text):
    return re.findall(rb"[0-9a-z_\x80-\xff]+", pc.utf8_lower(pa.array([text or ""]))[0].as_py().encode())


def shingles(text, width=5):
    w = words(text)
    if len(w) < width:
        return collections.Counter([tuple(w)] if w else [])
    return collections.Counter(zip(*(w[i:] for i in range(width))))


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)
