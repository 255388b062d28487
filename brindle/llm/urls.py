"""URL filter: a blocked Bloom filter of listed URLs in front of an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.catalog import query
from brindle.session import table

#: (verdict, host, path): the host and its subdomains, paths that start with the path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A listed host has one of these words as a label, or as a label's part between hyphens.
LISTED_WORDS = ("casino", "bets", "pills", "adult", "spam", "ads")
TRACKING = "^(utm_[a-z]*|ref|fbclid|gclid)="
#: The filter never has more blocks than this: 8 bytes of bits each, so its broadcast is bounded.
MAX_BLOCKS = 1 << 20
BITS_PER_KEY, PROBES = 16, 4
MAX_RULES = 1000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without its last ``/`` and the sorted query parameters without tracking ones."""
    params = F.split(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit("")), "&")
    params = F.array_sort(F.filter(params, lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", ""), tail)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null. A rule is written host + path;
    of equally long ones the one with the longer host wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; put single URLs into the listed table")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _shifted(by: Column) -> Column:
    """1 << by for a column of shift widths (the DataFrame function takes only a fixed width)."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), by)


def bloom_mask(key: Column) -> Column:
    """The bits that a key sets in its 64-bit block."""
    h = F.xxhash64(key, F.lit("mask"))
    mask = None
    for i in range(PROBES):
        bit = _shifted(F.pmod(F.shiftright(h, 6 * i), F.lit(64)).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def bloom_blocks(listed: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """A blocked Bloom filter as rows (block, bits): each key sets its bits in one 64-bit block, so a
    probe reads one row. At most MAX_BLOCKS rows, whatever the list's length; a longer list only
    raises the share of false positives, which the exact join removes."""
    blocks = 1
    while blocks < min(MAX_BLOCKS, max(1, n * BITS_PER_KEY // 64)):
        blocks *= 2
    rows = listed.select(_block(F.col(key), blocks).alias("block"), bloom_mask(F.col(key)).alias("bits"))
    return rows.groupBy("block").agg(F.bit_or("bits").alias("bits")), blocks


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url"
) -> DataFrame:
    """Add host, path, rule and verdict to ``pages``.

    The longest fitting rule decides; without one, a URL whose canonical form is in ``listed``
    (column ``canonical``) is blocked and any other allowed. Only URLs that no rule decides and that
    the Bloom filter passes are shuffled for the exact join.

    A null URL, or one without ``://``, has empty host and path, fits no rule and is allowed. Repeated
    rows are judged each on its own, repeated list entries count once, an empty list blocks nothing,
    and columns named like the outputs are replaced.
    """
    listed = listed.select("canonical").where(F.col("canonical").isNotNull() & (F.col("canonical") != "")).distinct()
    bits, blocks = bloom_blocks(listed, "canonical", listed.count())
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = judged.withColumns({"_rule": rule_for(F.col("host"), F.col("path"), rules), "_key": canonical(F.col(url))})
    judged = judged.withColumns({"_block": _block(F.col("_key"), blocks), "_mask": bloom_mask(F.col("_key"))})
    bits = bits.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    probed = judged.join(F.broadcast(bits), "_block", "left")  # MAX_BLOCKS rows at most
    probed = probed.withColumn("_maybe", F.col("_rule").isNull() & (F.col("host") != "") & F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)))
    out = [*keep, "host", "path", F.col("_rule.rule").alias("rule")]
    clear = probed.where(~F.col("_maybe")).select(*out, F.coalesce("_rule.verdict", F.lit("allow")).alias("verdict"))
    exact = listed.select(F.col("canonical").alias("_key"), F.lit(True).alias("_hit"))
    possible = probed.where("_maybe").join(exact, "_key", "left")
    possible = possible.select(*out, F.when(F.col("_hit"), "block").otherwise("allow").alias("verdict"))
    return clear.unionByName(possible)


def listed_urls(pages: DataFrame, words: Sequence[str] = LISTED_WORDS, url: str = "url") -> DataFrame:
    """Canonical URLs whose host has one of ``words`` as a label or a part of one: the list that the query
    filters by, since the given tables bring none."""
    return pages.where(host_of(F.col(url)).rlike(f"(^|[.-])({'|'.join(words)})([.-]|$)")).select(canonical(F.col(url)).alias("canonical"))


_SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), ''), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]*|ref|fbclid|gclid)='))) AS params
  FROM pages),
keyed AS (
  SELECT *, host || regexp_replace(path, '/$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS key FROM parts),
listed AS (SELECT DISTINCT key FROM keyed WHERE regexp_matches(host, '(^|[.-])(casino|bets|pills|adult|spam|ads)([.-]|$)') AND key <> ''),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM keyed) k JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT k.page_id, k.host, k.path, b.rule,
  coalesce(b.verdict, CASE WHEN k.host <> '' AND l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed k LEFT JOIN best b ON b.host = k.host AND b.path = k.path LEFT JOIN listed l ON l.key = k.key
"""


@query("op6_url_filter", _SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")
