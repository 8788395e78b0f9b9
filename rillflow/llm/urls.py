"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 256-bit blocks.  An URL sets eight bits of one block, so a
probe is one equi-join on the block number and four bit tests.  Only possible hits
go on to the exact hash join with the list, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import store

#: Filter bits for each listed URL; with eight bits set in a 256-bit block some 0.1 % false hits.
BITS_PER_URL = 16
BLOCK_BITS = 256
#: The filter is broadcast up to this size (40 bytes a block), and joined by a shuffle beyond.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls on ``host`` or a subdomain of it whose path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One form of an URL's variants: no scheme, query or fragment, no leading ``www.``, no final ``.html`` or slashes."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(\.html)?/*\z", ""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (ties: the earlier one), null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _bits(url: Column) -> list[Column]:
    """Masks of the four 64-bit words of an URL's block: two bits in each."""
    h = F.xxhash64(url, F.lit("bits"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.call_function("shiftrightunsigned", h, F.lit(6 * i)).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(4)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of ``listed.url``: (block, w0, w1, w2, w3), at most ``blocks`` rows; each task's part is combined by bit_or."""
    rows = listed.select(F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_bits(F.col("url")))))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every page.

    ``listed`` has one column, ``url``, of canonical URLs to block where no rule fits;
    null or empty ones are ignored.  A null url has an empty host and path and no
    listed form, so it is allowed unless a rule fits.  Urls of any length are judged
    whole.  Repeated rows are judged alike; with an empty list or without rules the other
    part decides; an empty table gives an empty result.  Other columns of both tables,
    also such with the names of the result's, are left out.
    """
    listed = store(listed.select("url").where(F.coalesce(F.col("url") != "", F.lit(False))).distinct(), "listed-urls")
    blocks = max(1, -(-listed.count() * BITS_PER_URL // BLOCK_BITS))
    bloom = bloom_blocks(listed, blocks)
    bloom = F.broadcast(bloom) if blocks * 40 <= BROADCAST_BYTES else bloom
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), canonical(F.col("host"), F.col("path")).alias("url"))
    probed = judged.withColumn("block", F.pmod(F.xxhash64("url"), F.lit(blocks))).join(bloom, "block", "left")
    hit = F.col("ruled").isNull()
    for i, mask in enumerate(_bits(F.col("url"))):
        hit &= F.coalesce(F.col(f"w{i}").bitwiseAND(mask) == mask, F.lit(False))
    probed = probed.withColumn("hit", hit)
    columns = ["page_id", "host", "path", "rule"]
    clear = probed.where(~F.col("hit")).select(*columns, F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    exact = listed.withColumnRenamed("url", "listed").hint("shuffle_hash")
    possible = probed.where("hit").join(exact, F.col("url") == F.col("listed"), "left")
    return clear.unionByName(possible.select(*columns, F.when(F.col("listed").isNotNull(), "block").otherwise("allow").alias("verdict")))


#: The contract's rules: fixed values.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def spam_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs of pages whose html is marked by runs of symbols (``***``, ``%%%`` or ``!!``).

    A stand-in for an outside block list, which the tables don't have; ``filter_urls`` takes any.
    """
    spam = F.col("html").contains("***") | F.col("html").contains("%%%") | F.col("html").contains("!!")
    return pages.where(spam).select(canonical(*host_and_path(F.col("url"))).alias("url"))


def page_verdicts(pages: DataFrame) -> DataFrame:
    """Every page judged by RULES and by the list of the corpus's own spam URLs: all variants of a listed URL are blocked."""
    return filter_urls(pages, RULES, spam_urls(pages))


ORACLE = """
WITH p AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p
), c AS (
  SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '(\\.html)?/*\\z', '') AS url,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM h
), s AS (
  SELECT DISTINCT url FROM c WHERE contains(html, '***') OR contains(html, '%%%') OR contains(html, '!!')
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN s.url IS NOT NULL AND c.url <> '' THEN 'block' ELSE 'allow' END AS verdict
FROM c LEFT JOIN s ON c.url = s.url
"""
