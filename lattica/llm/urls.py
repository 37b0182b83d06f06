"""URL filters: longest-match host and path rules, then a list of URLs behind a blocked Bloom filter.

The filter is a table of 512-bit blocks, each eight longs. A listed canonical URL sets
eight bits of the one block that its hash names, so a probe reads one block. Blocks are
built by a grouped bit-or and probed by an equi-join on the block number; the filter is
broadcast only while its counted blocks stay under ``BROADCAST_BLOCKS``. URLs that pass
are joined with the list itself, which removes false positives; all others skip that join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.workspace import Workspace

#: (host, path, verdict); a rule fits its host and all subdomains.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# Words of host names that lists of unwanted sites are made by.
LISTED_WORDS = (
    "ads", "adserver", "adult", "affiliate", "bets", "betting", "bingo", "casino", "casinos", "cialis", "clickbait", "coupons", "crack", "cracked", "doubleclick",
    "escort", "escorts", "gambling", "hentai", "jackpot", "keygen", "loans", "lottery", "malware", "nude", "payday", "pharma", "phishing", "pills", "poker", "popunder",
    "porn", "porno", "roulette", "sex", "slots", "spam", "spammer", "spyware", "torrent", "torrents", "tracker", "tracking", "viagra", "warez", "webcam", "xxx",
)
WORDS, PROBES = 8, 8
URLS_PER_BLOCK = 32
#: 64 bytes each and an 8-byte number: 36 MB.
BROADCAST_BLOCKS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*(/[^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without a leading www. or m., path without trailing slashes, query without utm_*; no scheme or fragment."""
    host = F.regexp_replace(host_of(url), r"\A(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/+\z", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(\A|&)utm_[^&]*", ""), r"\A&+", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path`` text, and its verdict; null where none fits.

    Rules of equal length: the first in code-point order.
    """
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(0)), F.lit(n_blocks))


def _bits(url: Column) -> list[Column]:
    """Eight bit places of 0..511, nine bits each of a second and third hash."""
    first, second = F.xxhash64(url, F.lit(1)), F.xxhash64(url, F.lit(2))
    return [F.call_function("shiftright", first if k < 4 else second, F.lit(9 * (k % 4))).bitwiseAND(F.lit(511)) for k in range(PROBES)]


def _word_masks(url: Column) -> list[Column]:
    places = _bits(url)
    masks = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for p in places:
            inside = F.call_function("shiftright", p, F.lit(6)) == w
            mask = mask.bitwiseOR(F.when(inside, F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")))
        masks.append(mask)
    return masks


def build_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w7) over the column ``canonical`` of the list."""
    rows = listed.select(_block(F.col("canonical"), n_blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_word_masks(F.col("canonical")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, listed.

    A rule's verdict stands; a URL that no rule fits is blocked when its canonical form
    equals that of a listed URL and allowed otherwise. A null URL, or one without
    ``://``, has an empty host and path, fits no rule and is never listed. Repeated pages
    and repeated list entries change nothing; other columns are ignored.
    """
    ws = Workspace(pages.sparkSession, "urls")
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    wanted = ws.stage(listed.select(canonical(F.col(listed_col).cast("string")).alias("canonical")).where("canonical != ''").distinct(), "listed")
    n_blocks = max(1, wanted.count() // URLS_PER_BLOCK)
    blocks = ws.stage(build_filter(wanted, n_blocks), "filter")
    masks = _word_masks(F.col("canonical"))
    probe = rows.withColumn("block", _block(F.col("canonical"), n_blocks)).join(F.broadcast(blocks) if n_blocks <= BROADCAST_BLOCKS else blocks, "block", "left")
    passes = F.lit(True)
    for i, m in enumerate(masks):
        passes = passes & (F.coalesce(F.col(f"w{i}"), F.lit(0).cast("long")).bitwiseAND(m) == m)
    # One pass over the table; only possible hits are joined with the list.
    probed = ws.stage(probe.select(*rows.columns, (passes & (F.col("host") != "")).alias("maybe")), "probed")
    hits = probed.where("maybe").join(wanted.withColumn("listed", F.lit(True)), "canonical", "left").select(*rows.columns, F.coalesce("listed", F.lit(False)).alias("listed"))
    rest = probed.where("not maybe").select(*rows.columns, F.lit(False).alias("listed"))
    judged = hits.unionAll(rest)
    return ws.finish(judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed"))


def listed_by_word(urls: DataFrame, words: Sequence[str] = LISTED_WORDS, url_col: str = "url") -> DataFrame:
    """A list cut from any table of URLs: those with one of ``words`` between the dots and
    hyphens of their host."""
    return urls.select(url_col).where(F.arrays_overlap(F.split(host_of(F.col(url_col).cast("string")), "[.-]"), F.array(*map(F.lit, words))))
