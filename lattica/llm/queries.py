"""The registered queries of this subpackage: opN_<name>, and pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontaminate, exact_dedup, html_text, licenses, mixing, neardup, sharding, tokens, toxicity, urls

#: Folder of public tokenizer files; a parameter of the operators, never copied.
TOKENIZER = "word_bpe_49k.json"
#: Text of a shard in op7_sharding.
SHARD_BYTES = 1 << 20

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_by_arrival(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assign(_table(spark, sf_dir, "documents"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_and_read_back(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.listed_by_word(pages))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_html_text": op3_html_text,
    "op4_mixing": op4_mixing,
    "op5_token_ids": op5_token_ids,
    "op6_licenses": op6_licenses,
    "op7_sharding": op7_sharding,
    "op8_decontaminate": op8_decontaminate,
    "op9_url_filter": op9_url_filter,
    "op10_near_dedup": op10_near_dedup,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CANONICAL = """
    concat(regexp_replace(host, '^(www|m)[.]', ''), regexp_replace(path, '/+$', ''),
        CASE WHEN clean <> '' THEN concat('?', clean) ELSE '' END)
"""
_URLS = f"""
    WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
    p AS (SELECT page_id,
        translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)', 1) AS path,
        regexp_replace(regexp_replace(regexp_extract(url, '(?s)^.*?://[^?#]*[?]([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&+', '') AS clean FROM u),
    c AS (SELECT page_id, host, path, {_CANONICAL} AS canonical FROM p),
    rules(rule, rhost, rpath, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
    listed AS (SELECT DISTINCT canonical FROM c WHERE canonical <> '' AND regexp_matches(host, '(^|[.-])({'|'.join(urls.LISTED_WORDS)})([.-]|$)')),
    m AS (SELECT c.*, (SELECT max_by(struct_pack(rule, v), length(rule)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS r, canonical IN (SELECT canonical FROM listed) AS listed FROM c)
    SELECT page_id, host, path, r.rule AS rule, coalesce(r.v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM m
"""

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)
    """,
    "op4_mixing": f"""
        WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE concat('0', source) END AS src,
            ('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:15])::BIGINT AS key,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
        s AS (SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src) AS place FROM d GROUP BY src),
        w AS (SELECT src, source_size, [3.0, 1.0, 2.0][1 + (place - 1) % 3]::DOUBLE AS weight, [0.5, 0.0, -0.5][1 + (place - 1) % 3]::DOUBLE AS tilt, source_size * 2.0::DOUBLE AS cap FROM s),
        o AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS owed,
            sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing FROM w),
        f AS (SELECT *, owed * weight / sharing > cap AS capped FROM o),
        first AS (SELECT owed AS f_owed, sharing AS f_sharing FROM f WHERE NOT capped ORDER BY sharing DESC LIMIT 1),
        t AS (SELECT src, source_size, tilt, CASE WHEN capped THEN cap ELSE least(f_owed * weight / f_sharing, cap) END AS target FROM f LEFT JOIN first ON true),
        p AS (SELECT d.*, t.*, coalesce(sum(size) OVER (PARTITION BY d.src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN t USING (src)),
        k AS (SELECT *, greatest(least(size, floor(target)::BIGINT - start), 0) AS one, greatest(least(size, floor(target)::BIGINT - source_size - start), 0) AS two FROM p)
        SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
            CASE WHEN one > 0 THEN CASE WHEN tilt = 0 THEN start / target ELSE ((1 + tilt) - sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * (start / target), 0))) / (2 * tilt) END END AS first_position,
            CASE WHEN two > 0 THEN CASE WHEN tilt = 0 THEN (start + source_size) / target ELSE ((1 + tilt) - sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * ((start + source_size) / target), 0))) / (2 * tilt) END END AS second_position
        FROM k
    """,
    "op7_sharding": f"""
        WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes, ('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:15])::BIGINT AS h FROM documents),
        b AS (SELECT n AS d, h >> (60 - n)::BIGINT AS prefix, sum(bytes) <= {SHARD_BYTES} OR min(h) = max(h) AS fits FROM d, range(61) r(n) GROUP BY ALL),
        l AS (SELECT doc_id, bytes, h, min(b.d) AS depth FROM (SELECT DISTINCT doc_id, bytes, h FROM d) x, b WHERE b.fits AND b.prefix = x.h >> (60 - b.d)::BIGINT GROUP BY ALL),
        s AS (SELECT d.doc_id, d.bytes, l.depth, right(lpad(bin(d.h), 60, '0'), 60)[1:l.depth] AS shard FROM d JOIN l ON d.doc_id IS NOT DISTINCT FROM l.doc_id AND d.bytes = l.bytes)
        SELECT doc_id, bytes, shard, depth::BIGINT AS depth, count(*) OVER (PARTITION BY shard) AS shard_docs, sum(bytes) OVER (PARTITION BY shard)::BIGINT AS shard_bytes FROM s
    """,
    "op9_url_filter": _URLS,
}
