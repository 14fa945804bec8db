"""URL filters: rules by host and path, and a block list behind a blocked Bloom filter [DataFrame functions only].

Listed canonical URLs are hashed into a filter that is sized from their number; it passes every listed URL and about one
in a hundred others. Only what passes is joined with the list itself, which removes the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import LOWER, UPPER, read

#: (host, path start, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Hosts whose pages make up the list of the registered query.
LISTED_HOSTS = ("ads-track.example.com", "adult-x.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org")
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Without scheme, query, fragment, a leading www. and trailing slashes."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def fits(host: Column, rule_host: str) -> Column:
    return (host == rule_host) | host.endswith("." + rule_host)


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, blocks: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``; ``listed`` holds host and path of listed URLs.

    A null url, or one without ``://``, has an empty host and path; it is allowed unless the empty URL is listed. Rows
    are kept as they are, repeated page_ids and null page_ids too; other columns are ignored. An empty list blocks
    nothing beyond the rules. ``blocks`` sets the filter's size, which is else that of the list."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    seen = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule = lambda value: F.coalesce(*[F.when(fits(F.col("host"), h) & F.col("path").startswith(p), F.lit(value(h, p, v))) for h, p, v in ranked])
    seen = seen.withColumn("rule", rule(lambda h, p, v: h + p)).withColumn("_ruled", rule(lambda h, p, v: v)).withColumn("_url", canonical(F.col("host"), F.col("path")))
    urls = listed.select(canonical(F.col("host"), F.col("path")).alias("_url")).distinct()
    probe = bloom.sifted(seen, urls, "_url", blocks).withColumn("_maybe", F.col("_maybe") & F.col("_ruled").isNull())
    sure = probe.filter(~F.col("_maybe")).select("page_id", "host", "path", "rule", F.coalesce("_ruled", F.lit("allow")).alias("verdict"))
    found = probe.filter("_maybe").join(urls.withColumn("_in", F.lit(True)), "_url", "left")
    return sure.unionByName(found.select("page_id", "host", "path", "rule", F.when(F.col("_in"), "block").otherwise("allow").alias("verdict")))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: every page on one of LISTED_HOSTS or below it."""
    pages = read(spark, sf_dir, "pages")
    parts = pages.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    hit = F.lit(False)
    for h in LISTED_HOSTS:
        hit = hit | fits(F.col("host"), h)
    return filter_urls(pages, parts.filter(hit))


def _sql() -> str:
    ranked = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fit = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    case = lambda value: "CASE " + " ".join(f"WHEN {fit(*r[:2])} THEN '{value(r)}'" for r in ranked) + " END"
    parts = PARTS.replace("(?s)", "")
    listed = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in LISTED_HOSTS)
    return f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{parts}', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
             coalesce(regexp_extract(url, '{parts}', 2, 's'), '') AS path FROM pages),
c AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') AS u FROM p),
l AS (SELECT DISTINCT u FROM c WHERE {listed})
SELECT page_id, host, path, {case(lambda r: r[0] + r[1])} AS rule,
  coalesce({case(lambda r: r[2])}, CASE WHEN u IN (SELECT u FROM l) THEN 'block' ELSE 'allow' END) AS verdict
FROM c
"""


ORACLE = _sql()
