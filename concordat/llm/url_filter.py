"""URL filter: rules of an operator of the crawl first, else a list of canonical URLs behind a blocked Bloom filter.

A URL's host is what stands after its first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; its path goes
on up to ``?``, ``#`` or the end. A rule (host, path, verdict) fits its host and all subdomains of it, if the path starts
with the rule's; the longest rule that fits decides (of equally long ones that with the longer host, then the first).

Where no rule fits, the list decides. Its entries are canonical URLs (:func:`canonical`): ``host/`` lists a host with all
its subdomains, ``host/path?query`` one page however it is spelt. A URL is looked up by its own canonical form and by
every suffix of its host. The look-up is a blocked Bloom filter, 512 bits a block and one bit in each of a block's eight
words, so one row tells whether a key may be listed. The filter has ``BITS`` bits an entry up to ``MAX_BLOCKS`` blocks (8 MB
of bits, which is what bounds its broadcast); a longer list only lets more keys pass. Keys that pass meet the list in
an exact hash join, so false positives never reach the result, whatever the filter's size.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule, are not listed, and are allowed. Repeated rows
and ids stay as they are: verdicts belong to URLs. A key that a third of all URLs share is a few bytes a different URL
on one side of a join, which adaptive execution splits. Other columns of the table are carried through only where named.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concordat.llm.common import small, table, written

BITS, BLOCK_BITS, MAX_BLOCKS = 12, 512, 1 << 17
LONGEST_HOST = 253  # of the domain name system; no longer name can be listed as a site
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the query (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
# Names of sites that the query's list is about.
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def site(host: Column) -> Column:
    """The host without a default port behind it, and without ``www.`` or ``m.`` before two labels or more."""
    return F.regexp_replace(F.regexp_replace(host, r":(?:80|443)?\z", ""), r"^(?:www|m)\.([^.]+\.)", "$1")


def canonical(url: Column) -> Column:
    """Scheme, fragment, default port, ``www.``, ``.html``, closing slashes and tracking parameters gone, other parameters sorted; null for a URL without a host."""
    plain = F.regexp_replace(path(url), r"(?:/index)?(?:\.html)?/*\z", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_[^=]*|ref)(?:=|\z)"))), "&")
    plain = F.concat(site(host(url)), F.when(plain == "", "/").otherwise(plain))
    return F.when(host(url) != "", F.concat(plain, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def keys(host: Column, canonical: Column) -> Column:
    """What a URL may be listed under: its canonical form, and its host and every suffix of it of two labels or more and ``LONGEST_HOST`` characters at most."""
    labels = F.split(F.right(site(host), F.lit(LONGEST_HOST + 1)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")))
    suffixes = F.filter(suffixes, lambda s: F.length(s) <= LONGEST_HOST + 1)
    return F.array_compact(F.array_distinct(F.concat(F.array(canonical), F.when(canonical.isNotNull(), suffixes).otherwise(F.array(F.lit(None).cast("string"))))))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The deciding rule as ``host`` plus ``path``, and its verdict; both null where none fits. Rules are a short list of the operator's own."""
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and the bit it has in each word of the block."""
    h = F.xxhash64(key, F.lit(1))
    return F.pmod(F.xxhash64(key), F.lit(blocks)), [_one(F.shiftrightunsigned(h, 6 * i).bitwiseAND(63)) for i in range(8)]


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def bloom(listed: DataFrame, entries: int) -> tuple[DataFrame, int]:
    """The filter of ``listed`` (key): a row per block that has bits (block, w0 to w7), and the number of blocks."""
    blocks = min(MAX_BLOCKS, max(1, math.ceil(entries * BITS / BLOCK_BITS)))
    block, bits = _bits(F.col("key"), blocks)
    rows = listed.select(block.alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(bits)))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8))), blocks


def passed(asked: DataFrame, filter_rows: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``asked`` (key and others) whose key has all its bits set."""
    block, bits = _bits(F.col("key"), blocks)
    met = asked.withColumn("block", block).join(F.broadcast(filter_rows), "block")  # MAX_BLOCKS rows of 72 bytes at most
    every = F.lit(True)
    for i, bit in enumerate(bits):
        every = every & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    return met.where(every).select(*asked.columns)


def listed_urls(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The different ``url`` of ``urls`` that ``listed`` (key: canonical URLs) has."""
    listed = written(listed.select("key").where("key IS NOT NULL").distinct(), "listed-urls")
    filter_rows, blocks = bloom(listed, listed.count())
    asked = urls.select("url", F.explode(keys(host(F.col("url")), canonical(F.col("url")))).alias("key"))
    possible = passed(asked, filter_rows, blocks).distinct()
    return possible.join(listed.hint("shuffle_hash"), "key", "left_semi").select("url").distinct()


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns of every row with host, path, rule (null if none fits) and verdict ("allow" or "block")."""
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = pages.select(*kept, F.col(url).cast("string").alias("url"))
    rows = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    open_urls = rows.where("rule IS NULL AND host <> ''").select("url")
    blocked = written(listed_urls(open_urls, listed).withColumn("hit", F.lit(True)), "blocked-urls")
    asked = F.when(F.col("rule").isNull(), F.col("url"))
    out = rows.withColumn("asked", asked).join(small(blocked.withColumnRenamed("url", "asked")), "asked", "left")
    verdict = F.coalesce("ruled", F.when(F.col("hit"), "block").otherwise("allow"))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "host", "path", "rule", verdict.alias("verdict"))


def list_of(pages: DataFrame, names: list[str]) -> DataFrame:
    """The query's list, from the table itself: the sites of ``names`` (a name and the two labels behind it) and the canonical URLs of their pages."""
    at = site(host(F.col("url")))
    domain = F.regexp_extract(at, rf"(?:^|\.)((?:{'|'.join(names)})\.[^.]+\.[^.]+)\z", 1)
    found = pages.select(domain.alias("domain"), canonical(F.col("url")).alias("own")).where("domain <> ''")
    return found.select(F.explode(F.array(F.concat("domain", F.lit("/")), F.col("own"))).alias("key"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, list_of(pages, LISTED_NAMES), RULES)


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
OP12_SQL = f"""
WITH rules AS (SELECT * FROM (VALUES {_RULE_ROWS}) AS t(verdict, host, path)),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) AS query
  FROM (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
sited AS (SELECT *, regexp_replace(regexp_replace(host, ':(?:80|443)?\\z', ''), '^(?:www|m)\\.([^.]+\\.)', '\\1') AS site, regexp_replace(path, '(?:/index)?(?:\\.html)?/*\\z', '') AS plain,
    array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[^=]*|ref)(?:=|\\z)'))), '&') AS kept
  FROM parts),
full_urls AS (SELECT *, CASE WHEN host <> '' THEN site || CASE WHEN plain = '' THEN '/' ELSE plain END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END END AS own,
    regexp_extract(site, '(?:^|\\.)((?:{"|".join(LISTED_NAMES)})\\.[^.]+\\.[^.]+)\\z', 1) AS domain FROM sited),
listed AS (SELECT own AS key FROM full_urls WHERE domain <> '' UNION SELECT domain || '/' FROM full_urls WHERE domain <> ''),
asked AS (SELECT DISTINCT url, unnest(list_append(list_filter(list_transform(range(1, greatest(len(labels), 2)), lambda i: array_to_string(list_slice(labels, i, NULL), '.') || '/'), lambda s: length(s) <= {LONGEST_HOST + 1}), own)) AS key
  FROM (SELECT *, string_split(right(site, {LONGEST_HOST + 1}), '.') AS labels FROM full_urls WHERE host <> '')),
blocked AS (SELECT DISTINCT url FROM asked WHERE key IN (SELECT key FROM listed)),
ruled AS (
  SELECT DISTINCT p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.host, p.path)
SELECT f.page_id, f.host, f.path, r.rule, coalesce(r.verdict, CASE WHEN b.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM full_urls f LEFT JOIN ruled r ON f.host = r.host AND f.path = r.path LEFT JOIN blocked b ON f.url = b.url
"""
