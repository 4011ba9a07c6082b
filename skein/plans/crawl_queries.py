"""Queries over URLs, predicates and the frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import urls as U
from skein.operators import frontier as R
from skein.operators import predicates as P
from skein.plans.registry import inline, query, table, values
from skein.sources.tables import stored

_ORG = "regexp_extract({}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


def org(u: str) -> str:
    return f"lower({_ORG.format(u)})"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def norm(u: str) -> str:
    q = f"array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&')"
    return f"{org(u)} || regexp_replace({path(u)}, '/$', '') || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END"


def short(x: str, n: int) -> str:
    return f"substr(regexp_replace(to_base64(unhex(sha256({x}))), '[+/=]', '', 'g'), 1, {n})"


def domain(h: str) -> str:
    return f"regexp_extract({h}, '([^.]+\\.[^.]+)$', 1)"


LINKS = "links AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)"
ABS = f"abs AS (SELECT page_id, base, {_ORG.format('base')} || href AS url FROM (SELECT * FROM links WHERE starts_with(href, '/')))"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("base"), F.explode(T.hrefs("html")).alias("href"))


def absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).select("page_id", "base", U.resolve_url("href", "base").alias("url"))


@query(f"WITH {LINKS} SELECT page_id, href, count(*) AS n FROM links GROUP BY ALL")
def links_extract(spark, sf_dir):
    return links(spark, sf_dir).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LINKS}, {ABS} SELECT page_id, lower({_ORG.format('url')}) || substr(url, length({_ORG.format('url')}) + 1) AS url, count(*) AS n FROM abs GROUP BY ALL")
def links_resolve(spark, sf_dir):
    return absolute(spark, sf_dir).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINKS}, {ABS},
k AS (SELECT *, {norm('url')} AS unique_key, CASE WHEN regexp_matches(url, '(?i)/the[^/]*$') THEN 'filters' END AS bad FROM abs),
a AS (SELECT DISTINCT {host('url')} AS host, unique_key FROM k WHERE bad IS NULL AND unique_key NOT IN (SELECT {norm('url')} FROM pages)),
s AS (SELECT {host('url')} AS host, bad FROM k WHERE bad IS NOT NULL)
SELECT host, 'accepted' AS reason, count(*) AS n FROM a GROUP BY host UNION ALL SELECT host, bad, count(*) FROM s GROUP BY ALL""")
def links_qualified(spark, sf_dir):
    """Links of pages, resolved, filtered, new ones deduplicated and counted by host and reason."""
    found = absolute(spark, sf_dir).withColumn("seq", F.col("page_id"))
    seen = R.with_keys(table(spark, sf_dir, "pages").select("url"))
    new, skipped = R.qualify(found, seen, P.EnqueueOptions(strategy="same-hostname", exclude=["**/the*"]))
    rows = new.select(U.hostname("url").alias("host"), F.lit("accepted").alias("reason")).unionByName(skipped.select(U.hostname("url").alias("host"), "reason"))
    return rows.groupBy("host", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT page_id, lower(regexp_extract(url, '^([a-z]+):', 1)) AS scheme, {host('url')} AS host, {path('url')} AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query, {org('url')} AS origin, {domain(host('url'))} AS domain, {org('url')} || '/robots.txt' AS robots FROM pages")
def url_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", U.scheme("url").alias("scheme"), U.hostname("url").alias("host"), U.path("url").alias("path"), U.query("url").alias("query"), U.origin("url").alias("origin"), U.registrable_domain(U.hostname("url")).alias("domain"), U.robots_url("url").alias("robots"))


@query(f"SELECT page_id, {norm('url')} AS unique_key, {short(norm('url'), 15)} AS request_id, 'POST|' || {short('page_id::VARCHAR', 8)} || '|' || {norm('url')} AS extended_key FROM pages")
def url_normalize(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    key = U.unique_key("url")
    return p.select("page_id", key.alias("unique_key"), U.request_id(key).alias("request_id"), U.unique_key("url", F.lit("post"), F.col("page_id").cast("string"), extended=True).alias("extended_key"))


@query(f"SELECT page_id, split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'pg=' || page_id || '&q=a+%26+b' || CASE WHEN contains(url, '#') THEN '#' || split_part(url, '#', 2) ELSE '' END AS url, string_split({path('url')}, '/')[2] AS first_segment FROM pages")
def url_search_params(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", U.with_search_params("url", F.create_map(F.lit("pg"), F.col("page_id").cast("string"), F.lit("q"), F.lit("a & b"))).alias("url"), U.url_components("url")[2].alias("first_segment"))


_STRATEGY_PAIRS = "pairs AS (SELECT a.page_id, a.url AS target, b.url AS base FROM pages a JOIN pages b ON b.page_id = a.page_id // 2)"


@query(f"""WITH {_STRATEGY_PAIRS} SELECT page_id, true AS s_all, {host('target')} = {host('base')} AS s_hostname, {domain(host('target'))} = {domain(host('base'))} AS s_domain, {org('target')} = {org('base')} AS s_origin FROM pairs""")
def filter_strategy(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    pairs = p.withColumn("half", F.expr("page_id div 2")).join(p.select(F.col("page_id").alias("half"), F.col("url").alias("base")), "half")
    return pairs.select("page_id", *[P.matches_strategy(F.lit(s), "url", "base").alias(f"s_{s.removeprefix('same-')}") for s in P.STRATEGIES])


@query("SELECT page_id, regexp_matches(url, '^https?://[^/]*\\.example\\.(org|com)/.*$') AS by_glob, regexp_matches(url, '/(en|de)/[0-9]+') AND NOT regexp_matches(url, '/[a-z]+/[^/]*9[^/]*$') AS included FROM pages")
def filter_patterns(spark, sf_dir):
    import re

    p = table(spark, sf_dir, "pages")
    return p.select("page_id", P.matches_patterns("url", ["http{s,}://*.example.{org,com}/**"]).alias("by_glob"), P.matches_patterns("url", [re.compile("/(en|de)/[0-9]+")], [re.compile("/[a-z]+/[^/]*9[^/]*$")]).alias("included"))


@query(f"""WITH {LINKS}, {ABS}, r AS (SELECT CASE WHEN page_id % 5 > 3 THEN 'depth' WHEN regexp_matches(url, '/[a-f][^/]*$') THEN 'robotsTxt' WHEN regexp_matches(url, '(?i)/t[^/]*$') THEN 'filters' WHEN length(url) % 7 = 0 THEN 'transform' END AS reason FROM abs)
SELECT coalesce(reason, 'none') AS reason, count(*) AS n FROM r GROUP BY ALL""")
def skip_reasons(spark, sf_dir):
    rows = absolute(spark, sf_dir).withColumn("depth", F.col("page_id") % 5).withColumn("ok", ~F.col("url").rlike("/[a-f][^/]*$"))
    reason = P.skip_reason(P.EnqueueOptions(strategy="same-hostname", exclude=["**/t*"], max_depth=3), depth="depth", allowed="ok", transform_skips=F.length("url") % 7 == 0)
    return rows.groupBy(F.coalesce(reason, F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_REDIRECTS = [(1, "http://a.example.com/x", "http://b.example.com/y", "same-domain"), (2, "http://a.example.com/x", "http://b.example.com/y", "same-hostname"), (3, "http://a.example.com/x", "https://a.example.com/x", "same-origin"), (4, "http://a.example.com/x", "https://a.example.com/x", "same-hostname"), (5, "http://a.example.com/x", None, "same-origin"), (6, "http://a.example.com/x", "http://c.org/", "all"), (7, "http://a.example.com/x", "http://a.example.com./", "same-hostname")]


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, true), (5, true), (6, true), (7, false)) t(id, stays)")
def redirect_filter(spark, sf_dir):
    return inline(spark, "id int, url string, loaded string, strategy string", _REDIRECTS).select("id", P.redirect_stays("url", "loaded", "strategy").alias("stays"))


@query("""WITH r AS (SELECT event_id, 200 + 100 * (event_id % 4)::INT + CASE WHEN event_id % 3 = 0 THEN 3 ELSE 0 END AS status, CASE event_type WHEN 'error' THEN 'Proxy responded with 502' WHEN 'click' THEN 'read ECONNRESET' ELSE event_type END AS message, ['text/html', 'image/png', 'application/json'][(event_id % 3 + 1)::INT] AS kind FROM events)
SELECT event_id, status IN (401, 403, 429) AS blocked, status >= 500 AS failed, regexp_matches(message, 'ECONNRESET|ECONNREFUSED|Proxy responded with') AS proxy, kind <> 'image/png' OR status IN (408, 429, 500, 502, 503, 504) AS mime_ok, CASE WHEN event_id % 11 = 0 THEN false WHEN event_id % 13 = 0 THEN true ELSE event_id % 6 < 3 END AS retryable FROM r""")
def response_predicates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    rows = e.select(i, (F.lit(200) + 100 * (i % 4) + F.when(i % 3 == 0, 3).otherwise(0)).alias("status"), F.when(F.col("event_type") == "error", "Proxy responded with 502").when(F.col("event_type") == "click", "read ECONNRESET").otherwise(F.col("event_type")).alias("message"), F.element_at(F.array(*map(F.lit, ("text/html", "image/png", "application/json"))), (i % 3 + 1).cast("int")).alias("kind"))
    return rows.select("event_id", P.is_blocked_status("status").alias("blocked"), P.is_error_status("status").alias("failed"), P.is_proxy_error("message").alias("proxy"), P.allowed_mime("kind", "status").alias("mime_ok"), P.is_retryable(i % 11 == 0, i % 13 == 0, i % 6).alias("retryable"))


_AFTER = [(1, "120"), (2, "0"), (3, "-5"), (4, "soon"), (5, "Mon, 01 Jan 2024 00:01:00 GMT"), (6, "Mon, 01 Jan 2023 00:01:00 GMT"), (7, "1.5"), (8, None)]


@query("SELECT * FROM (VALUES (1, 120000), (2, NULL), (3, NULL), (4, NULL), (5, 60000), (6, NULL), (7, NULL), (8, NULL)) t(id, delay_ms)")
def retry_after(spark, sf_dir):
    return inline(spark, "id int, value string", _AFTER).select("id", U.retry_after_ms("value", F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("delay_ms"))


@query("SELECT * FROM (VALUES (1, 'us er', 'p@ss', 'proxy.example.com', '8000'), (2, '', '', 'proxy.example.com', NULL)) t(id, username, password, hostname, port)")
def proxy_parts(spark, sf_dir):
    rows = inline(spark, "id int, url string", [(1, "http://us%20er:p%40ss@proxy.example.com:8000"), (2, "http://proxy.example.com")])
    return rows.select("id", U.proxy_info("url").alias("p")).select("id", "p.username", "p.password", "p.hostname", "p.port")


@query(f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN {org('url')} WHEN 1 THEN NULL ELSE {org('url')} END AS base FROM pages")
def base_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    s = F.element_at(F.array(*map(F.lit, ("same-hostname", "same-domain", "same-origin"))), (F.col("page_id") % 3 + 1).cast("int"))
    return p.select("page_id", U.filter_base_url(s, "url", F.lit("http://elsewhere.invalid/")).alias("base"))


@query(f"WITH k AS (SELECT page_id, {norm('url')} AS unique_key FROM (SELECT page_id, {_ORG.format('url')} AS url FROM pages)) SELECT min(page_id) AS seq, unique_key, {short('unique_key', 15)} AS request_id FROM k GROUP BY unique_key")
def request_list_first(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), U.origin("url").alias("url"))
    return R.request_list(p).select("seq", "unique_key", "request_id")


@query(f"WITH k AS (SELECT page_id, {norm('url')} AS unique_key FROM (SELECT page_id, {_ORG.format('url')} AS url FROM pages)) SELECT page_id AS seq, unique_key || '-' || (row_number() OVER (ORDER BY page_id) - 1) AS unique_key FROM k")
def request_list_all(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), U.origin("url").alias("url"))
    return R.request_list(p, keep_duplicates=True).select("seq", "unique_key")


@query("SELECT o_custkey % 2 = 0 AS known, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders) GROUP BY ALL")
def new_vs_seen(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unique_key")).distinct()
    seen = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("unique_key")).distinct()
    new, known = R.split_known(asked, seen)
    return new.select(F.lit(False).alias("known")).unionByName(known.select(F.lit(True).alias("known"))).groupBy("known").agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT o_orderkey, sum((o_orderkey % 3 = 0)::INT) OVER (ORDER BY o_orderkey) AS used, o_orderkey % 3 = 0 AS is_new FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey >= (SELECT min(o_orderkey) FROM r WHERE is_new AND used = 101) THEN 'limit' END AS reason FROM r")
def enqueue_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3 == 0).alias("is_new"))
    return R.within_budget(rows, 100, order="o_orderkey").select("o_orderkey", "reason")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS front, CASE WHEN event_id % 7 = 0 THEN -event_id ELSE event_id END AS at FROM events WHERE event_id % 5 <> 0 AND event_id % 11 <> 0")
def queue_order(spark, sf_dir):
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(i, i.alias("seq"), (i % 7 == 0).alias("forefront"), (i % 5 == 0).alias("handled"), (i % 11 == 0).alias("in_progress"))
    return R.serving_order(rows).select("event_id", "front", "at")


@query("""WITH RECURSIVE l AS (SELECT o_orderkey AS src, (o_orderkey * 7 + 3) % 5000 AS dst FROM orders UNION ALL SELECT o_orderkey, o_orderkey + 1 FROM orders WHERE o_orderkey % 3 = 0),
w(key, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT l.dst, w.depth + 1 FROM w JOIN l ON l.src = w.key WHERE w.depth < 4)
SELECT key AS unique_key, min(depth) AS depth FROM w GROUP BY key""")
def depth_waves(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    edges = o.select(F.col("o_orderkey").alias("src"), ((F.col("o_orderkey") * 7 + 3) % 5000).alias("dst")).unionByName(o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst")))
    return R.waves(spark.range(1, 2).select(F.col("id").alias("unique_key")), edges, 4, stored)


@query("SELECT count(*) AS n, count_if(forefront) AS front FROM (SELECT c_custkey AS k, false AS forefront FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, true FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0)")
def tandem_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unique_key"))
    both = R.tandem(c.where("unique_key % 3 = 0"), c.where("unique_key % 2 = 0").withColumn("forefront", F.lit(False)))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if("forefront").alias("front"))


@query("SELECT count(*) AS total, count_if(event_type = 'purchase') AS handled, count_if(event_type <> 'purchase') AS pending FROM events")
def request_counts(spark, sf_dir):
    return R.counts(table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "purchase", F.col("ts")).alias("handled_at")))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN 'new' || c_custkey ELSE c_name END AS value FROM customer WHERE c_custkey % 6 <> 0 OR c_custkey % 4 = 0")
def journal_shadow(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    base = c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    journal = c.where("c_custkey % 6 = 0").select(F.col("c_custkey").alias("key"), F.lit(1).alias("seq"), F.lit(None).cast("string").alias("value")).unionByName(c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("key"), F.lit(2).alias("seq"), F.concat(F.lit("new"), F.col("c_custkey").cast("string")).alias("value")))
    return R.shadowed(base, journal)


@query(f"SELECT {host('url')} AS host, count(*) AS n, list_sort(list(page_id)) AS pages FROM pages GROUP BY ALL")
def pages_by_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(U.hostname("url").alias("host")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("page_id")).alias("pages"))


_RESOLVE = [("../c?x=1#f", "http://h.com/a/b/d", "http://h.com/a/c?x=1#f"), ("./e", "http://h.com/a/b", "http://h.com/a/e"), ("//o.com/p", "https://h.com/a", "https://o.com/p"), ("?q=2", "http://h.com/a/b?z", "http://h.com/a/b?q=2"), ("#top", "http://h.com/a?z", "http://h.com/a?z#top"), ("", "http://h.com/a?z#f", "http://h.com/a?z"), ("HTTP://H.com:80", "http://x.y/", "http://h.com/"), ("mailto:a@b.c", "http://x.y/", "mailto:a@b.c"), ("/../../x", "http://h.com/a/b", "http://h.com/x"), ("a", None, None)]


@query("WITH " + values("t", "href, base, url", _RESOLVE) + " SELECT href, url FROM t")
def resolve_cases(spark, sf_dir):
    return inline(spark, "href string, base string, want string", _RESOLVE).select("href", U.resolve_url("href", "base").alias("url"))


@query("SELECT conv_id, turn, role, coalesce(CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' END, 'default') AS route FROM conversations")
def route_lookup(spark, sf_dir):
    from skein.operators.router import Router

    r = Router()
    r.handler("user", timeout_s=10)(lambda df: df)
    r.handler("assistant")(lambda df: df)
    r.default_handler(lambda df: df)
    return r.table(table(spark, sf_dir, "conversations"), "role").select("conv_id", "turn", "role", "route")


@query("SELECT role AS handler, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY ALL")
def route_handlers(spark, sf_dir):
    from skein.operators.router import Router

    r = Router()
    count = lambda df: df.groupBy(F.col("role").alias("handler")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    r.handler("user")(count)
    r.default_handler(count)
    return r.run(table(spark, sf_dir, "conversations"), "role")
