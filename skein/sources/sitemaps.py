"""Sitemaps: XML and text documents, nested traversal, discovery."""

from __future__ import annotations

import gzip
import itertools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import urls as U
from skein.operators import frontier as R
from skein.operators import predicates as P

CHANGES = ("always", "hourly", "daily", "weekly", "monthly", "yearly", "never")
_ENTRY = "array<struct<loc: string, lastmod: string, changefreq: string, priority: string>>"
_URLSET = f"url {_ENTRY}, _bad string"
_INDEX = f"sitemap {_ENTRY}, _bad string"


def unpacked(body: Column) -> Column:
    """Bytes as text; gzip is told by content, not by name, and unpacked by a pandas function only where it occurs."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(b):
            try:
                return gzip.decompress(b).decode("utf-8", "replace")
            except (OSError, EOFError):
                return None

        return s.map(one, na_action="ignore")

    return F.when(F.hex(F.substring(body, 1, 2)) == "1F8B", run(body)).otherwise(F.decode(body, "UTF-8"))


def sitemap_bodies(files: DataFrame, url: Column | str = "path") -> DataFrame:
    """files as binaryFile reads them -> sitemap_url, body as text, gzip unpacked."""
    return files.select((F.col(url) if isinstance(url, str) else url).alias("sitemap_url"), unpacked(F.col("content")).alias("body"))


def sitemap_requests(roots: DataFrame, entries: DataFrame, store: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """The requests of a sitemap loader: expand_sitemaps() as seq, url, unique_key, request_id, one of each key."""
    found = expand_sitemaps(roots, entries, store, **options).select(F.col("loc").alias("url")).distinct()
    return R.first_seen(R.with_keys(found.withColumn("seq", F.xxhash64("url"))))


def sitemap_entries(docs: DataFrame) -> DataFrame:
    """docs(sitemap_url, body as text) -> origin_sitemap, kind (url or sitemap), loc, lastmod, changefreq, priority.

    Malformed XML gives nothing, as do entries without loc; unknown values of lastmod, changefreq, priority are null."""
    body = F.regexp_replace(F.regexp_replace("body", r"^\s*(<\?xml[^>]*\?>)?", ""), r"(</?)[A-Za-z0-9]+:(loc|lastmod|changefreq|priority|url|sitemap|urlset|sitemapindex)\b", "$1$2")
    docs = docs.withColumn("_x", U.trimmed(body))
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    urls = docs.where(F.col("_x").rlike(r"^(<!--.*?-->\s*)*<urlset")).select("sitemap_url", F.lit("url").alias("kind"), F.from_xml("_x", _URLSET, opts).alias("p")).select("sitemap_url", "kind", "p._bad", F.explode("p.url").alias("e"))
    nested = docs.where(F.col("_x").rlike(r"^(<!--.*?-->\s*)*<sitemapindex")).select("sitemap_url", F.lit("sitemap").alias("kind"), F.from_xml("_x", _INDEX, opts).alias("p")).select("sitemap_url", "kind", "p._bad", F.explode("p.sitemap").alias("e"))
    found = urls.unionByName(nested).where("_bad is null")
    change = F.lower(U.trimmed("e.changefreq"))
    when = F.coalesce(*[F.try_to_timestamp(U.trimmed("e.lastmod"), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd")])
    out = found.select(F.col("sitemap_url").alias("origin_sitemap"), "kind", U.trimmed("e.loc").alias("loc"), when.alias("lastmod"), F.when(change.isin(*CHANGES), change).alias("changefreq"), F.expr("try_cast(e.priority as double)").alias("priority"))
    return out.where("loc != ''")


def text_sitemap(docs: DataFrame) -> DataFrame:
    """docs(sitemap_url, body): one URL a line that isn't blank."""
    lines = docs.select(F.col("sitemap_url").alias("origin_sitemap"), F.explode(F.split("body", r"\r\n|\r|\n")).alias("l"))
    return lines.select("origin_sitemap", U.trimmed("l").alias("loc")).where("loc != ''")


def expand_sitemaps(roots: DataFrame, entries: DataFrame, store: Callable[[DataFrame], DataFrame], *, max_depth: int | None = None, strategy: str = "same-hostname", include: list | None = None, exclude: list | None = None, nested_filter: Column | None = None) -> DataFrame:
    """roots(sitemap_url), entries as of sitemap_entries() -> loc entries reached, each sitemap read once.

    Nested sitemaps and entries must satisfy the strategy seen from the sitemap that names them; nested sitemaps also
    nested_filter (a condition on loc), entries also include and exclude. No limit of depth unless asked for."""
    ok = entries.where(P.matches_strategy(F.lit(strategy), "loc", "origin_sitemap"))
    below = ok.where("kind = 'sitemap'")
    nested = (below if nested_filter is None else below.where(nested_filter)).select("origin_sitemap", F.col("loc").alias("child"))
    last = store(roots.select("sitemap_url").distinct())
    seen = last
    for _ in itertools.count() if max_depth is None else range(max_depth):
        found = last.join(nested, last["sitemap_url"] == nested["origin_sitemap"]).select(F.col("child").alias("sitemap_url")).distinct()
        last = store(found.join(seen, "sitemap_url", "left_anti"))
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return ok.where("kind = 'url'").where(P.matches_patterns("loc", include, exclude)).join(seen.withColumnRenamed("sitemap_url", "origin_sitemap"), "origin_sitemap", "left_semi")


def dropped_by_strategy(entries: DataFrame, strategy: str = "same-hostname") -> DataFrame:
    """How many entries of each sitemap the strategy drops."""
    bad = ~P.matches_strategy(F.lit(strategy), "loc", "origin_sitemap")
    return entries.groupBy("origin_sitemap").agg(F.count_if(bad).alias("dropped")).where("dropped > 0")


def common_names(urls: DataFrame, url: str = "url") -> DataFrame:
    """Where a host's sitemap usually lies."""
    return urls.select(F.explode(F.array(*[F.concat(U.origin(url), F.lit(n)) for n in ("/sitemap.xml", "/sitemap.txt")])).alias("sitemap_url")).distinct()


def discover_sitemaps(urls: DataFrame, robots: DataFrame, exists: DataFrame) -> DataFrame:
    """urls(url), robots(robots_url, sitemap_url), exists(url, status) -> host, sitemap_url.

    Per host: what robots.txt names; else given URLs that look like sitemaps; else those of three usual places that exist."""
    hosts = urls.select(U.hostname("url").alias("host"), U.origin("url").alias("origin"), "url").where("host is not null")
    named = robots.select(U.hostname("robots_url").alias("host"), "sitemap_url").join(hosts.select("host").distinct(), "host", "left_semi")
    looks = hosts.where(F.col("url").rlike(r"(?i)sitemap.*\.(xml|txt)(\.gz)?$")).select("host", F.col("url").alias("sitemap_url")).join(named.select("host").distinct(), "host", "left_anti")
    rest = hosts.select("host", "origin").distinct().join(named.unionByName(looks).select("host").distinct(), "host", "left_anti")
    tried = rest.select("host", F.explode(F.array(*[F.concat("origin", F.lit(n)) for n in ("/sitemap.xml", "/sitemap.txt", "/sitemap_index.xml")])).alias("sitemap_url"))
    there = exists.where("status between 200 and 299").select(F.col("url").alias("sitemap_url")).distinct()
    return named.unionByName(looks).unionByName(tried.join(there, "sitemap_url", "left_semi").select("host", "sitemap_url")).distinct()
