"""URL filters: a blocked Bloom filter before an exact hash join.

A page's canonical URL, its host and path without what often varies (``www.`` or ``m.`` ahead, ``/`` or ``.html`` at the end,
scheme, query and fragment), is looked up in a list of canonical URLs. A blocked Bloom filter of the list goes to all tasks: a
URL's bits lie in one 64-bit block, found by the same hash, so a probe is one look and one mask. Only possible hits leave the
rest, and an exact hash join with the list removes false positives; both sides of it are salted, so that a URL that a third of
all pages have is dealt out. Pages without a possible hit are not shuffled. URLs are taken apart once: host, path, rule and key
are written, and the two branches read them.

The filter has at most ``MOST_BLOCKS`` blocks, so its size is bounded whatever the list's; a longer list gets more false
positives, which the join removes. Rules (host, path prefix, verdict) are a short parameter and branches of one ``CASE``.

The list of the registered query is made of the pages themselves, by a rule on their markup: pages whose adverts hold a fourth
of the article's characters or more.

Built-in functions only. Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is
not listed. Repeated rows and a null ``page_id`` are judged one by one. Listed nulls are ignored, repeated entries count once;
an empty list blocks nothing. The longest rule that fits wins; of equally long ones the one with the longer host, then the one
that blocks. Columns of ``pages`` may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import ascii_lower, written

#: host, path prefix, verdict.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Blocks of 64 bits; bits a key; bits set by a key.
MOST_BLOCKS, BITS, PROBES = 1 << 18, 12, 4
#: Over how many partitions the join deals a URL.
SALTS = 8


def host(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, ascii_lower(F.regexp_extract(F.substring(url, at + 3, F.char_length(url)), r"^[^/?#]*+", 0))), F.lit(""))


def path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.regexp_replace(F.substring(url, at + 3, F.char_length(url)), r"^[^/?#]*+", "")
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^?#]*+", 0)), F.lit(""))


def canonical(host_: Column, path_: Column) -> Column:
    """Null where there is no host."""
    return F.when(host_ != "", F.concat(F.regexp_replace(host_, r"^(www|m)\.", ""), F.regexp_replace(path_, r"(/|\.html)\z", "")))


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(blocks - 1)).cast("int")


def _mask(h: Column) -> Column:
    out = F.lit(0).cast("long")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """One row: the filter of column ``key`` as an array of blocks."""
    h = F.xxhash64("key")
    made = keys.select(_block(h, blocks).alias("block"), _mask(h).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("mask"))
    # at most as many rows as blocks
    every = keys.sparkSession.range(0, blocks, 1, 1).select(F.col("id").cast("int").alias("block")).join(made, "block", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))), lambda x: x["mask"]).alias("filter"))


def may_hold(filter_: Column, h: Column, blocks: int) -> Column:
    """Of a key's hash; names the filter once."""
    return F.get(filter_, _block(h, blocks)).bitwiseAND(_mask(h)) == _mask(h)


def fitting(host_: Column, path_: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block")):
        fits = ((host_ == h) | F.endswith(host_, F.lit("." + h))) & F.startswith(path_, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, url: str = "url", carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``carry`` columns of ``pages`` with host, path, rule and verdict. listed: column ``key``, canonical URLs."""
    urls = written(listed.filter("key IS NOT NULL AND key <> ''").select("key").distinct())
    n, blocks = urls.count(), 64
    while blocks < MOST_BLOCKS and blocks * 64 < n * BITS:
        blocks *= 2
    names = [f"__c{i}" for i in range(len(carry))]
    held = pages.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(carry, names, strict=True)], host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    held = held.withColumns({"fit": fitting(F.col("host"), F.col("path"), rules), "key": canonical(F.col("host"), F.col("path"))})
    possible = may_hold(bloom(urls, blocks).scalar(), F.xxhash64("key"), blocks)
    # a rule decides whatever the list says
    held = written(held.withColumn("key", F.when(F.col("fit").isNull() & F.col("key").isNotNull() & possible, F.col("key"))))
    clear = held.filter("key IS NULL").withColumn("listed", F.lit(False))
    salt = F.pmod(F.xxhash64(*names, "host", "path", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    entries = urls.select(F.col("key").alias("entry"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("dealt"))
    asked = held.filter("key IS NOT NULL").withColumn("salt", salt)
    hit = asked.join(entries, (asked["key"] == entries["entry"]) & (asked["salt"] == entries["dealt"]), "left").withColumn("listed", F.col("entry").isNotNull())
    out = clear.select(*names, "host", "path", "fit", "listed").unionAll(hit.select(*names, "host", "path", "fit", "listed"))
    verdict = F.coalesce("fit.verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*[F.col(x).alias(c) for c, x in zip(carry, names, strict=True)], "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


def advert_heavy(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Canonical URLs (``key``) of the pages whose adverts hold a fourth of the article's characters or more."""
    adverts = F.char_length(F.array_join(F.regexp_extract_all(F.col(html), F.lit(r'<div class="ad">([^<]*)</div>'), F.lit(1)), ""))
    article = F.split_part(F.split_part(F.col(html), F.lit("<article>"), F.lit(2)), F.lit("</article>"), F.lit(1))
    article = F.char_length(F.regexp_replace(article, "<[^>]*>", ""))
    some = pages.filter((adverts > 0) & (4 * adverts >= article))
    return some.select(canonical(host(F.col(url)), path(F.col(url))).alias("key"))


def query(pages: DataFrame) -> DataFrame:
    """``op3_url_filter``."""
    return judged(pages, advert_heavy(pages))


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = rf"""
WITH rules(h, p, v) AS (VALUES {_RULES_SQL}),
pg AS (SELECT row_number() OVER () AS k, page_id, html, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
cn AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)\z', '') END AS u,
         length(array_to_string(regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1), '')) AS ads,
         length(regexp_replace(split_part(split_part(html, '<article>', 2), '</article>', 1), '<[^>]*>', '', 'g')) AS article FROM pg),
fit AS (SELECT k, h || p AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS n
        FROM pg JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
listed AS (SELECT DISTINCT u FROM cn WHERE u <> '' AND ads > 0 AND 4 * ads >= article)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN listed.u IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM cn LEFT JOIN (SELECT * FROM fit WHERE n = 1) f USING (k) LEFT JOIN listed ON listed.u = cn.u
"""
