"""URL filtering: allow and block rules by host and path, and a list of blocked URLs.

A URL is reduced to a canonical form (see ``canonical``).  The listed forms fill a
*blocked Bloom filter*: a hash names one block of 256 bits, and eight more slices of
hash bits set two bits in each of its four words.  A page whose bits are not all set is
not listed; the others are possible hits and go to an exact join with the list, which
removes the false ones.  Filter and list are tables: Spark broadcasts them if their
measured size allows that and otherwise joins by shuffle.

A rule fits its host and all subdomains when the path starts with the rule's; the longest
fitting rule decides (of equally long ones, the first by name), else the list does.  A
url that is null or has no ``://`` has an empty host and path and is allowed.

Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatledger.llm.common import Scratch

BITS_PER_URL = 16
WORDS = 4
#: Query parameters that do not name a document; fixed values.
TRACKING = r"(utm_[^=&]*|ref|fbclid|gclid|mc_eid|igshid)(=[^&]*)?"
#: Words in host names of unwanted sites.
UNWANTED = ("adult", "bets", "casino", "pills")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def _ascii_lower(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ``://``, null without one."""
    return F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.char_length(url)))


def host(url: Column) -> Column:
    return _ascii_lower(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path that equivalent URLs share: without scheme, user, usual port,
    ``www.``, fragment, tracking parameters and closing slashes; parameters in order."""
    name = F.regexp_replace(F.regexp_replace(host(url), r"^[^@]*@", ""), r"(:80|:443|\.)$", "")
    name = F.regexp_replace(name, r"^www\.", "")
    place = F.regexp_replace(F.regexp_replace(path(url), "/{2,}", "/"), "/$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}$"))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when(
        F.locate("://", url) > 0, F.concat(name, place, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    )


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(F.lit("bits"), key)

    def bit(i: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63))).cast("int"))

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def bloom_filter(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """``block, w0 .. w3``: the blocks of the filter that have bits set."""
    rows = keys.select(_block(F.col(column), blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col(column)))])
    return rows.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def listed(pages: DataFrame, listed_urls: DataFrame) -> DataFrame:
    """``pages`` with ``listed``: whether the canonical form of ``url`` is that of one of
    ``listed_urls(url)``."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    urls = listed_urls.select(canonical(F.col("url")).alias("key_")).where("key_ IS NOT NULL").distinct()
    urls = scratch.write(urls, "listed")
    blocks = max(1, -(-urls.count() * BITS_PER_URL // (64 * WORDS)))
    bloom = scratch.write(bloom_filter(urls, "key_", blocks), "bloom")
    rows = pages.withColumn("key_", canonical(F.col("url")))
    rows = rows.withColumn("block", _block(F.col("key_"), blocks)).join(bloom, "block", "left")
    hit = F.lit(True)
    for i, mask in enumerate(_masks(F.col("key_"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    rows = rows.withColumn("possible_", F.coalesce(hit & F.col("key_").isNotNull(), F.lit(False)))
    rows = scratch.write(rows.drop("block", *[f"w{i}" for i in range(WORDS)]), "probed")
    sure = rows.where("NOT possible_").withColumn("listed", F.lit(False))
    exact = urls.withColumn("listed", F.lit(True))
    checked = rows.where("possible_").join(exact, "key_", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return sure.unionByName(checked).drop("key_", "possible_")


def judge(pages: DataFrame, listed_urls: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits), ``listed`` and
    ``verdict`` (allow or block).  Columns of these names are replaced."""
    inner = ("host", "path", "rule", "listed", "verdict", "key_", "block", "possible_", "w0", "w1", "w2", "w3")
    rows = listed(pages.drop(*inner), listed_urls)
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rule = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule = F.when(fits, r.name) if rule is None else rule.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    if rule is None:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", by_list)
    return rows.withColumn("rule", rule).withColumn("verdict", verdict.otherwise(by_list))


def unwanted_urls(pages: DataFrame, words: Sequence[str] = UNWANTED) -> DataFrame:
    """The list made of a crawl itself: URLs whose host name has an unwanted word."""
    return pages.select("url").where(host(F.col("url")).rlike(rf"(^|[.-])({'|'.join(words)})([.-]|$)"))


ORACLE = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, rest,
    translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '') AS query
  FROM cut
), forms AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'),
      lambda p: p <> '' AND NOT regexp_full_match(p, '(utm_[^=&]*|ref|fbclid|gclid|mc_eid|igshid)(=[^&]*)?'))), '&') AS kept
  FROM parts
), keys AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN
    regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), '(:80|:443|\.)$', ''), '^www\.', '')
    || regexp_replace(regexp_replace(path, '/{2,}', '/', 'g'), '/$', '')
    || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS key
  FROM forms
), fitting AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM keys
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN key IN (SELECT key FROM keys WHERE key IS NOT NULL AND regexp_matches(host, '(^|[.-])(adult|bets|casino|pills)([.-]|$)'))
    THEN 'block' ELSE 'allow' END AS verdict
FROM fitting
"""
