"""URL filters: rules first, then a blocked Bloom filter before an exact hash join with the listed canonical URLs.

The filter is a table: one row a 512-bit block, eight long words, each listed URL setting one bit in each word of its block. It is built with
bit_or, which combines on the map side, and probed by a join on the block number, so a URL touches one row. What it lets through meets the list
itself in a hash join on the canonical URL, which removes false positives. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import table

#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
BITS_PER_URL = 16
#: Blocks of up to so many bytes go to every executor; a larger filter is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., m. or amp., path without index page, .html and closing slashes; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(?:www|m|amp)\.", ""), F.regexp_replace(path, r"(?:/index)?(?:\.html?)?/*$", "")))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    fits: Column | None = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        told = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        match = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits = F.when(match, told) if fits is None else fits.when(match, told)
    return fits if fits is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _places(key: str, blocks: int) -> list[Column]:
    h, g = F.xxhash64(key), F.xxhash64(F.lit("bits"), F.col(key))
    return [F.pmod(h, F.lit(blocks)).alias("block"), *(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * j).bitwiseAND(63).cast("int")).alias(f"m{j}") for j in range(8))]


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w7) of the listed keys."""
    return listed.select(*_places(key, blocks)).groupBy("block").agg(*(F.bit_or(f"m{j}").alias(f"w{j}") for j in range(8)))


def in_list(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """rows plus boolean listed: whether key is in listed[key]. A null key is not. listed may repeat keys.

    The number of listed keys sizes the filter; only that number reaches the driver.
    """
    listed = listed.select(key).where(F.col(key).isNotNull()).distinct()
    blocks = max(1, -(-listed.count() * BITS_PER_URL // 512))
    table_ = bloom_blocks(listed, key, blocks)
    if blocks * 72 <= BROADCAST_BYTES:
        table_ = F.broadcast(table_)
    own = rows.select(F.struct("*").alias("row"), F.col(key).alias("key"))
    block, *masks = _places("key", blocks)
    # rows without a key, and below those that the filter stops, get a key of their own that meets nothing and lies anywhere
    nowhere = F.xxhash64("row")
    probed = own.select("row", "key", F.when(F.col("key").isNull(), F.pmod(nowhere, F.lit(blocks))).otherwise(block).alias("block"), *masks).join(table_, "block", "left")
    maybe = F.coalesce(F.col("key").isNotNull() & F.expr(" and ".join(f"(w{j} & m{j}) = m{j}" for j in range(8))), F.lit(False))
    passed = probed.select("row", F.when(maybe, F.concat(F.lit("="), F.col("key"))).otherwise(nowhere.cast("string")).alias("asked"))
    told = listed.select(F.concat(F.lit("="), F.col(key)).alias("asked"), F.lit(True).alias("hit"))
    return passed.join(told, "asked", "left").select("row.*", F.coalesce("hit", F.lit(False)).alias("listed"))


def judged(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page; listed has a column canonical.

    A rule decides where one fits; else a listed canonical URL is blocked and any other allowed. A null url, or one without ``://``, has an empty
    host and path, fits no rule, is not listed and so is allowed.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    keyed = parts.select("*", rule_for(F.col("host"), F.col("path"), rules).alias("r"), canonical(F.col("host"), F.col("path")).alias("canonical"))
    found = in_list(keyed, listed, "canonical")
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def mirrored(pages: DataFrame) -> DataFrame:
    """The list that the query uses: canonical URLs under which two or more urls are stored."""
    urls = pages.where("url is not null").select("url", canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("canonical")).distinct()
    return urls.where("canonical is not null").groupBy("canonical").agg(F.count("*").alias("n")).where("n > 1").select("canonical")


def op9_urls(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, mirrored(pages))


QUERIES = {"op9_urls": op9_urls}
ORACLE_SQL = {
    "op9_urls": r"""
with p as (select page_id, case when url like '%://%' then substr(url, instr(url, '://') + 3) else '' end as rest, url from pages),
q as (select page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
c as (select *, case when host <> '' then regexp_replace(host, '^(www|m|amp)\.', '') || regexp_replace(path, '(/index)?(\.html?)?/*$', '') end as canonical from q),
l as (select canonical from (select distinct url, canonical from c where canonical is not null) group by 1 having count(*) > 1),
r as (select c.*, case
  when (host = 'example.org' or host like '%.example.org') and path like '/en/1%' then 'example.org/en/1'
  when (host = 'example.org' or host like '%.example.org') and path like '/es/%' then 'example.org/es/'
  when (host = 'com' or host like '%.com') and path like '/fr/%' then 'com/fr/'
  when (host = 'com' or host like '%.com') and path like '/de/%' then 'com/de/'
  when (host = 'org' or host like '%.org') and path like '/%' then 'org/' end as rule from c)
select page_id, host, path, rule, case rule when 'example.org/en/1' then 'block' when 'example.org/es/' then 'block' when 'com/de/' then 'block'
  when 'com/fr/' then 'allow' when 'org/' then 'allow'
  else case when canonical in (select canonical from l) then 'block' else 'allow' end end as verdict from r
"""
}
