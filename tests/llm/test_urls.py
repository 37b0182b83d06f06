import re

from oracle import connect, same
from pyspark.sql import functions as F

from lattica.llm import queries
from lattica.llm import urls as X

PAGES = [
    (1, "http://A.Example.NET/en/x?q#f"), (2, "https://example.net/de/"), (3, "http://x.example.com/de/1"), (4, "http://org/fr/a"), (5, "http://aorg/fr/a"), (6, "http://a.org/frx"),
    (7, None), (8, "no scheme"), (9, "http://host"), (10, "http://net"), (11, "http://net/"), (12, "x://y.com/a://b"), (13, "http://www.bad.com/p/?utm_source=f&b=1#t"), (14, "https://bad.com/p?b=1"),
    (15, "http://bad.com/p"), (16, "http://bad.com/p"), (None, "http://bad.com/q"), (17, "http://h?x/y"), (18, "http://h#/y"), (19, "://n.net/z"), (20, ""), (21, "http://É.net/A"), (22, "a\nb://c.net/d\ne?f"),
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(h + p, v) for h, p, v in X.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
    return host, path, rule, verdict


def test_awkward_rows(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS path", "3 AS canonical", "4 AS block", "5 AS w0")
    listed = spark.createDataFrame([("http://BAD.com/p?b=1",), ("http://bad.com/p?b=1",), (None,), ("nothing",), ("http://bad.com/q/",)], "url string")
    got = X.judge_urls(df, listed).collect()
    assert len(got) == len(PAGES)
    for r, url in ((r, dict(PAGES)[r.page_id]) for r in got):
        host, path, rule, verdict = brute(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == (verdict or ("block" if r.listed else "allow"))
    assert {r.page_id for r in got if r.listed} == {13, 14, None}
    assert X.judge_urls(df.where("false"), listed).count() == 0
    assert not [r for r in X.judge_urls(df, listed.where("false")).collect() if r.listed]


def test_filter_has_no_false_negatives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("canonical"))
    rows = X.build_filter(listed, 90)
    probe = spark.range(30_000).select("id", F.concat(F.lit("h/"), F.col("id").cast("string")).alias("canonical"))
    joined = probe.withColumn("block", X._block(F.col("canonical"), 90)).join(rows, "block", "left")
    passes = F.lit(True)
    for i, m in enumerate(X._word_masks(F.col("canonical"))):
        passes = passes & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(m) == m)
    hits = [r.id for r in joined.where(passes).select("id").collect()]
    assert len([i for i in hits if i < 3000]) == 3000 and len(hits) < 3000 + 27_000 * 0.02


def test_blocks_joined_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame(PAGES, "page_id long, url string")
    want = sorted(map(repr, X.judge_urls(df, df).collect()))
    monkeypatch.setattr(X, "BROADCAST_BLOCKS", 0)
    assert sorted(map(repr, X.judge_urls(df, df).collect())) == want


def test_list_of_another_table(spark):
    """A list that shares nothing with the pages but a few URLs; and one cut by words of hosts."""
    df = spark.createDataFrame(PAGES, "page_id long, url string")
    foreign = spark.range(20_000).select(F.concat(F.lit("https://h"), F.col("id").cast("string"), F.lit(".example.com/p")).alias("address"))
    listed = foreign.union(spark.createDataFrame([("http://bad.com/p",), ("http://host",)], "address string"))
    assert {r.page_id for r in X.judge_urls(df, listed, listed_col="address").collect() if r.listed} == {9, 15, 16}
    hosts = ["http://best-casino.com/", "http://casinos.org", "http://occasino.com/", "http://x.ads.net/q", "http://heads.com", None, "spam"]
    urls = spark.createDataFrame([(h,) for h in hosts], "url string")
    assert [r.url for r in X.listed_by_word(urls).collect()] == ["http://best-casino.com/", "http://casinos.org", "http://x.ads.net/q"]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    same(queries.op9_url_filter(spark, sf), connect(sf), queries.ORACLE_SQL["op9_url_filter"])
