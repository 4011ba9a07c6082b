"""Queries over datasets, stores, statistics, errors, loads and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import errors as E
from skein.operators import frontier as R
from skein.operators import stats as S
from skein.operators.datasets import Dataset, KeyValueStore, chunks
from skein.plans.registry import inline, query, table
from skein.streaming import folds


def _orders(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), "o_custkey", "o_totalprice", "o_orderstatus"), "seq")


@query("SELECT o_orderkey AS seq, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 120")
def ds_page(spark, sf_dir):
    return _orders(spark, sf_dir).page(120, 50).select("seq", "o_custkey")


@query("SELECT o_orderkey AS seq, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 50 OFFSET 20")
def ds_page_desc(spark, sf_dir):
    return _orders(spark, sf_dir).page(20, 50, desc=True).select("seq", "o_custkey")


@query("SELECT count(*) AS total, least(100, greatest(0, count(*) - 7)) AS count, 7 AS \"offset\", 100 AS \"limit\", false AS \"desc\" FROM orders")
def ds_envelope(spark, sf_dir):
    return _orders(spark, sf_dir).envelope(7, 100)


@query("SELECT o_orderkey AS seq, round(o_totalprice * 2, 2) AS double_price FROM orders WHERE o_orderkey % 2 = 0")
def ds_map(spark, sf_dir):
    return _orders(spark, sf_dir).map(lambda r, i: {"seq": i, "double_price": round(r["o_totalprice"] * 2, 2)} if i % 2 == 0 else None, "seq long, double_price double")


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def ds_reduce(spark, sf_dir):
    return _orders(spark, sf_dir).reduce(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("SELECT o_custkey, array_to_string(list(o_orderstatus ORDER BY o_orderkey), '') AS value FROM orders GROUP BY o_custkey")
def ds_fold(spark, sf_dir):
    return _orders(spark, sf_dir).fold(["o_custkey"], F.lit(""), lambda a, x: F.concat(a, x), F.col("o_orderstatus"))


@query("SELECT page_id AS seq, lang FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.')) AS lang FROM pages)")
def ds_unwind(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.split(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), r"\.").alias("lang"))
    return Dataset(p).unwind("lang")


@query("SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS a FROM orders WHERE o_orderkey % 2 = 0")
def ds_clean(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("a"), F.lit("hidden").alias("#b"))
    return Dataset(o).clean()


_ITEMS = "CASE event_id % 3 WHEN 0 THEN '{\"id\":' || event_id || ',\"name\":\"n\"}' WHEN 1 THEN '{\"id\":' || event_id || ',\"age\":' || event_id % 50 || '}' ELSE '{\"id\":' || event_id || '}' END"


@query("SELECT event_id AS seq, event_id::VARCHAR AS id, CASE WHEN event_id % 3 = 0 THEN 'n' END AS name, CASE WHEN event_id % 3 = 1 THEN (event_id % 50)::VARCHAR END AS age FROM events")
def ds_export_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.expr(_ITEMS).alias("item"))
    return Dataset(e).table("item", collect_all=True)


@query("SELECT o_orderkey AS seq, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders")
def ds_chunks(spark, sf_dir):
    return chunks(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq")), 1000)


_KVS = "WITH r AS (SELECT 'key-' || user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS value FROM events), l AS (SELECT key, arg_max(coalesce(value, '#'), seq) AS value FROM r GROUP BY key) "


def _store(spark: SparkSession, sf_dir: str) -> KeyValueStore:
    e = table(spark, sf_dir, "events")
    return KeyValueStore(e.select(F.col("event_id").alias("seq"), F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("key"), F.when(F.col("event_type") != "error", F.encode("event_type", "UTF-8")).alias("value"), F.lit("text/plain; charset=utf-8").alias("content_type")))


@query(_KVS + "SELECT key, value AS text FROM l WHERE value <> '#'")
def kvs_latest(spark, sf_dir):
    return _store(spark, sf_dir).parsed().select("key", "text")


@query(_KVS + "SELECT key, strlen(value)::BIGINT AS size FROM l WHERE value <> '#' AND starts_with(key, 'key-1') ORDER BY key LIMIT 20")
def kvs_list_prefix(spark, sf_dir):
    return _store(spark, sf_dir).list_keys("key-1", limit=20).select("key", F.col("size").cast("long").alias("size"))


_JOBS = "jobs AS (SELECT event_id, event_id * 10 AS start_ms, event_id * 10 + floor(value * 10)::BIGINT AS end_ms, CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'discard' ELSE 'finish' END AS outcome, event_id % 4 AS retry_count FROM events)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i, (i * 10).alias("start_ms"), (i * 10 + F.floor(F.col("value") * 10)).alias("end_ms"), F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "discard").otherwise("finish").alias("outcome"), (i % 4).alias("retry_count"))


@query(f"""WITH {_JOBS}, a AS (SELECT count_if(outcome = 'finish') AS finished, count_if(outcome = 'fail') AS failed, count_if(outcome <> 'discard' AND retry_count > 0) AS retried, min(end_ms - start_ms) FILTER (outcome = 'finish') AS min_ms, max(end_ms - start_ms) FILTER (outcome = 'finish') AS max_ms, (sum(end_ms - start_ms) FILTER (outcome = 'finish'))::BIGINT AS finished_ms, (sum(end_ms - start_ms) FILTER (outcome = 'fail'))::BIGINT AS failed_ms FROM jobs)
SELECT *, floor(finished_ms / finished + 0.5)::BIGINT AS avg_finished_ms, floor(failed_ms / failed + 0.5)::BIGINT AS avg_failed_ms, floor(finished / 10.0 + 0.5)::BIGINT AS finished_per_minute, floor(failed / 10.0)::BIGINT AS failed_per_minute, finished_ms + failed_ms AS total_ms, finished + failed AS total, 600000::BIGINT AS runtime_ms FROM a""")
def run_stats(spark, sf_dir):
    return S.run_statistics(_jobs(spark, sf_dir), 0, 600_000)


@query(f"WITH {_JOBS}, n AS (SELECT retry_count, count(*) AS n FROM jobs WHERE outcome <> 'discard' GROUP BY ALL) SELECT list(n ORDER BY retry_count) AS histogram FROM n")
def retry_histogram(spark, sf_dir):
    return S.retry_histogram(_jobs(spark, sf_dir))


@query("SELECT 395 + event_id % 10 AS status, count(*) AS n FROM events WHERE 395 + event_id % 10 BETWEEN 400 AND 599 GROUP BY ALL")
def status_counts(spark, sf_dir):
    return S.status_counts(table(spark, sf_dir, "events").select((F.col("event_id") % 10 + 395).alias("status")))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(i.alias("seq"), F.when(i % 3 == 0, "TypeError").otherwise("Error").alias("name"), F.when(i % 5 == 0, "E1").alias("code"), F.concat(F.lit("request "), (i % 4).cast("string"), F.lit(" of the page failed\nmore")).alias("message"), F.when(i % 7 != 0, F.concat(F.lit("Error: x\n    at run (/app/src/main.js:"), (i % 2).cast("string"), F.lit(":5)\n    at go (/b.js:1:2)"))).alias("stack"))


_GROUPS = """g AS (SELECT CASE WHEN event_id % 7 <> 0 THEN '/app/src/main.js:' || event_id % 2 || ':5' ELSE 'missing stack trace' END AS stack_key, CASE WHEN event_id % 5 = 0 THEN 'E1' ELSE 'missing error code' END AS code_key, CASE WHEN event_id % 3 = 0 THEN 'TypeError' ELSE 'Error' END AS name_key, 'request ' || event_id % 4 || ' of the page failed' AS message_key, count(*) AS n, min(event_id) AS first_seq FROM events WHERE event_type = 'error' GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {_GROUPS} SELECT * FROM g")
def error_groups(spark, sf_dir):
    return E.error_groups(_errors(spark, sf_dir))


@query(f"WITH {_GROUPS} SELECT * FROM g ORDER BY n DESC, stack_key, code_key, name_key, message_key LIMIT 3")
def top_errors(spark, sf_dir):
    return E.top_errors(E.error_groups(_errors(spark, sf_dir)), 3)


@query(f"WITH {_GROUPS} SELECT stack_key, code_key, name_key, CASE WHEN count(*) > 1 THEN 'request _ of the page failed' ELSE min(message_key) END AS message_key, sum(n)::BIGINT AS n FROM g GROUP BY 1, 2, 3")
def error_templates(spark, sf_dir):
    return E.message_templates(_errors(spark, sf_dir))


@query("SELECT count(*) AS n, count(DISTINCT message) AS messages FROM (SELECT event_type AS message FROM events UNION ALL SELECT 'cause of ' || event_type FROM events)")
def error_causes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    rows = e.select(F.col("event_id").alias("seq"), none.alias("name"), none.alias("code"), F.col("event_type").alias("message"), none.alias("stack"), F.array(F.struct(none.alias("name"), none.alias("code"), F.concat(F.lit("cause of "), F.col("event_type")).alias("message"), none.alias("stack"))).alias("causes"))
    return E.unrolled(rows).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("message").alias("messages"))


_SAMPLES = "s AS (SELECT ['memory', 'cpu', 'eventLoop'][(event_id % 3 + 1)::INT] AS signal, epoch_us(ts) // 1000 AS at_ms, event_type = 'error' AS is_overloaded, event_id FROM events)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.element_at(F.array(*map(F.lit, ("memory", "cpu", "eventLoop"))), (i % 3 + 1).cast("int")).alias("signal"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("at_ms"), (F.col("event_type") == "error").alias("is_overloaded"))


@query(f"""WITH {_SAMPLES}, g AS (SELECT *, greatest(1, at_ms - lag(at_ms) OVER (PARTITION BY signal ORDER BY at_ms, is_overloaded)) AS gap FROM s),
r AS (SELECT signal, round(sum(is_overloaded::INT * gap) / sum(gap), 3) AS actual_ratio FROM (SELECT signal, is_overloaded, CASE WHEN (lag(at_ms) OVER (PARTITION BY signal ORDER BY at_ms, is_overloaded)) IS NULL THEN NULL ELSE gap END AS gap FROM g) GROUP BY signal)
SELECT signal, actual_ratio, CASE signal WHEN 'memory' THEN 0.2 WHEN 'cpu' THEN 0.4 ELSE 0.6 END::DOUBLE AS limit_ratio, actual_ratio > CASE signal WHEN 'memory' THEN 0.2 WHEN 'cpu' THEN 0.4 ELSE 0.6 END AS is_overloaded FROM r""")
def load_signals(spark, sf_dir):
    return S.evaluate_load(_samples(spark, sf_dir))


@query("SELECT true AS is_system_idle")
def system_status(spark, sf_dir):
    rows = inline(spark, "signal string, at_ms long, is_overloaded boolean", [("cpu", 0, True), ("cpu", 1000, False), ("cpu", 2000, False), ("memory", 0, False), ("memory", 4000, False)])
    return S.system_status(S.evaluate_load(rows, window_ms=5000))


@query("SELECT event_type, round(sum(value * (event_id % 5)) / sum(event_id % 5), 6) AS average FROM events GROUP BY event_type")
def load_weighted_avg(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("w", F.col("event_id") % 5)
    return S.weighted_average(rows, "value", "w", ["event_type"]).select("event_type", F.round("average", 6).alias("average"))


@query("WITH n AS (SELECT event_type, epoch_us(ts) // 1000000 AS at_s, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, at_s, n, sum(n) OVER w::BIGINT AS n_60, sum(n) OVER w >= 2 AS blocked FROM n WINDOW w AS (PARTITION BY event_type ORDER BY at_s RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)")
def rate_last_60s(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_s"))
    return S.rate_last_minute(e, ["event_type"], "at_s", 2)


@query("WITH n AS (SELECT user_id AS id, epoch_us(ts) // 1000000 AS at_s, round(sum(value), 2) AS bytes FROM events GROUP BY ALL) SELECT id, at_s, round(sum(bytes) OVER (PARTITION BY id ORDER BY at_s RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) / least(10, at_s - min(at_s) OVER (PARTITION BY id) + 1), 4) AS speed FROM n")
def download_speed(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_s")).agg(F.round(F.sum("value"), 2).alias("bytes"))
    return S.download_speed(e, 1.0).select("id", "at_s", F.round("speed", 4).alias("speed"))


@query("WITH n AS (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, epoch_us(h) // 1000000 AS at_s, n - coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY h), 0) AS delta FROM n")
def period_delta(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return S.period_delta(n, ["event_type"], "h", "n").select("event_type", F.unix_seconds(F.col("h").cast("timestamp")).alias("at_s"), "delta")


@query("SELECT o_orderkey AS seq, (row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS pick FROM orders")
def session_round_robin(spark, sf_dir):
    return S.round_robin(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq")), 7)


@query("SELECT count(*) AS item_count, min(o_orderdate) AS created_at, max(o_orderdate) AS modified_at FROM orders")
def ds_info(spark, sf_dir):
    return Dataset(table(spark, sf_dir, "orders"), "o_orderkey").info("o_orderdate")


@query("WITH e AS (SELECT user_id AS domain, event_id AS seq, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT seq, max(at_ms - i * 3600000) OVER (PARTITION BY domain ORDER BY i) + i * 3600000 AS fetch_at FROM e")
def crawl_delay_schedule(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("domain"), F.col("event_id").alias("seq"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("at_ms"))
    return folds.crawl_delay_schedule(e, 3_600_000).select("seq", "fetch_at")


@query("""WITH e AS (SELECT user_id AS key, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT key, least(coalesce(min(i) FILTER (ok), 99), 4) AS stop, count(*) AS c FROM e GROUP BY key), g AS (SELECT key, least(stop, c) AS attempts FROM f)
SELECT g.key, attempts, attempts - 1 AS retry_count, CASE WHEN e.ok THEN 'done' WHEN attempts = 4 THEN 'failed' ELSE 'pending' END AS state FROM g JOIN e ON e.key = g.key AND e.i = attempts""")
def retry_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok"), F.lit(False).alias("no_retry"))
    return folds.retry_outcomes(e)


@query("SELECT user_id AS domain, rank() OVER (ORDER BY max(event_id)) AS turn FROM events GROUP BY user_id")
def fair_domains(spark, sf_dir):
    free = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("domain")).agg(F.max("event_id").alias("throttled_until"))
    return R.place(free, "throttled_until", "turn").select("domain", (F.col("turn") + 1).alias("turn"))


# The folds in SQL: a key's events are numbered, and a recursive query takes one of each key at a time.
_SESSION_SQL = """WITH RECURSIVE e AS (SELECT user_id AS k, event_id AS seq, epoch_us(ts) // 1000000 AS at_s, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS i FROM events),
f AS (SELECT k, 0::BIGINT AS i, NULL::BIGINT AS seq, 0::DOUBLE AS score, 0::BIGINT AS usage, at_s AS since, false AS retired FROM e WHERE i = 1
UNION ALL SELECT k, i, seq, score, usage, since, retired OR score >= 3 OR usage >= 50 OR at_s - since >= 3000
FROM (SELECT e.k, e.i, e.seq, e.at_s, CASE WHEN e.bad THEN f.score + 1 ELSE greatest(0, f.score - 0.5::DOUBLE) END AS score, f.usage + 1 AS usage, f.since, f.retired FROM f JOIN e ON e.k = f.k AND e.i = f.i + 1))
SELECT k AS session_id, seq, score, usage, NOT retired AS usable FROM f WHERE i > 0"""

_THROTTLE_SQL = """WITH RECURSIVE e AS (SELECT user_id AS k, event_id AS seq, epoch_us(ts) // 1000 // 10000 AS now, event_type AS t, 3000 + event_id % 5000 AS value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 // 10000, event_id) AS i FROM events),
f AS (SELECT k, 0::BIGINT AS i, NULL::BIGINT AS seq, 0::BIGINT AS until, 0::BIGINT AS decays, 0::BIGINT AS n, 0::BIGINT AS since, 0::BIGINT AS latest, 0::BIGINT AS next_free, -1::BIGINT AS crawl, 0::BIGINT AS now FROM e WHERE i = 1
UNION ALL SELECT k, i, seq, CASE WHEN bump THEN now + delay ELSE until END, CASE WHEN bump THEN now + 2 * delay ELSE decays END, n,
CASE t WHEN 'error' THEN CASE WHEN since = 0 THEN now ELSE since END WHEN 'click' THEN since WHEN 'signup' THEN since ELSE 0 END, CASE WHEN t = 'error' THEN now ELSE latest END,
CASE WHEN t = 'click' AND crawl > 0 THEN now + crawl ELSE next_free END, CASE WHEN t = 'signup' AND crawl < 0 THEN value ELSE crawl END, now
FROM (SELECT *, least(60000, 2000 * (1::BIGINT << greatest(0, least(n - 1, 20))::INT)) AS delay FROM (SELECT e.k, e.i, e.seq, e.now, e.t, e.value, f.until, f.decays, f.since, f.latest, f.next_free, f.crawl, e.t = 'error' AND e.now >= f.until AS bump,
CASE WHEN e.t = 'error' AND e.now >= f.until THEN CASE WHEN e.now >= f.decays THEN 1 ELSE f.n + 1 END ELSE f.n END AS n FROM f JOIN e ON e.k = f.k AND e.i = f.i + 1)))
SELECT k AS domain, seq, n AS n429, until AS backoff_until, greatest(0, greatest(until, next_free) - now) AS wait_ms, since <> 0 AND now - latest <= 900000 AND now - since > 900000 AS stalled FROM f WHERE i > 0"""

_LIFECYCLE_SQL = """WITH RECURSIVE e AS (SELECT user_id AS k, event_id AS seq, ['add', 'fetch', 'handle', 'reclaim'][(event_id % 4 + 1)::INT] AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT k, 0::BIGINT AS i, NULL::BIGINT AS seq, '' AS state, 0::BIGINT AS fetches, true AS valid FROM e WHERE i = 1
UNION ALL SELECT k, i, seq, coalesce(goes, state), fetches + (goes = 'in_progress' AND goes IS NOT NULL)::INT, goes IS NOT NULL OR (op = 'add' AND state <> '')
FROM (SELECT e.k, e.i, e.seq, e.op, f.state, f.fetches, CASE WHEN f.state = '' AND e.op = 'add' THEN 'pending' WHEN f.state = 'pending' AND e.op = 'fetch' THEN 'in_progress' WHEN f.state = 'in_progress' AND e.op = 'handle' THEN 'handled' WHEN f.state = 'in_progress' AND e.op = 'reclaim' THEN 'pending' END AS goes
FROM f JOIN e ON e.k = f.k AND e.i = f.i + 1))
SELECT k AS key, seq, state, fetches, valid FROM f WHERE i > 0"""

_SCALE_SQL = """WITH RECURSIVE e AS (SELECT user_id % 8 AS k, event_id AS seq, event_id * 37 % 201 AS current, event_type <> 'error' AS idle, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS i FROM events),
f AS (SELECT k, 0::BIGINT AS i, NULL::BIGINT AS seq, 1::BIGINT AS d FROM e WHERE i = 1
UNION ALL SELECT e.k, e.i, e.seq, CASE WHEN idle AND d < 200 AND current >= floor(d * 0.9::DOUBLE) THEN least(200, d + ceil(d * 0.05::DOUBLE)::BIGINT) WHEN NOT idle AND d > 1 THEN greatest(1, d - ceil(d * 0.05::DOUBLE)::BIGINT) ELSE d END FROM f JOIN e ON e.k = f.k AND e.i = f.i + 1)
SELECT k AS pool, seq, d AS desired FROM f WHERE i > 0"""

_REUSE_SQL = """WITH RECURSIVE e AS (SELECT user_id % 8 AS k, event_id AS seq, epoch_us(ts) // 1000000 // 8 AS at_s, event_type AS t, row_number() OVER (PARTITION BY user_id % 8 ORDER BY epoch_us(ts) // 1000000 // 8, event_id) AS i FROM events),
f AS (SELECT k, 0::BIGINT AS i, NULL::BIGINT AS seq, -1::BIGINT AS session, 0::DOUBLE AS score, 0::BIGINT AS usage, 0::BIGINT AS since, true AS retired FROM e WHERE i = 1
UNION ALL SELECT k, i, seq, session, score, usage, since, t = 'purchase' OR score >= 3 OR usage >= 50
FROM (SELECT k, i, seq, t, session, since, CASE t WHEN 'purchase' THEN score + 3 WHEN 'error' THEN score + 1 ELSE greatest(0, score - 0.5::DOUBLE) END AS score, usage + (t <> 'purchase')::INT AS usage
FROM (SELECT e.k, e.i, e.seq, e.t, f.session + fresh::INT AS session, CASE WHEN fresh THEN 0 ELSE f.score END AS score, CASE WHEN fresh THEN 0 ELSE f.usage END AS usage, CASE WHEN fresh THEN e.at_s ELSE f.since END AS since
FROM (SELECT f.*, e.i AS ei, f.retired OR e.at_s - f.since >= 3000 AS fresh FROM f JOIN e ON e.k = f.k AND e.i = f.i + 1) f JOIN e ON e.k = f.k AND e.i = f.ei)))
SELECT k AS pool, seq, session, score, usage FROM f WHERE i > 0"""


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_s"), F.when(F.col("event_type") == "error", "bad").otherwise("good").alias("op"))


@query(_SESSION_SQL)
def session_scores(spark, sf_dir):
    return folds.fold_batch(session_events(spark, sf_dir), "session_id", ["at_s", "seq"], folds.session_step, folds.SESSION_OUT)


@query(_REUSE_SQL)
def session_reuse(spark, sf_dir):
    """One session at a time until it fails; at an eighth of the events' time, so that sessions last some requests."""
    op = F.when(F.col("event_type") == "purchase", "retire").when(F.col("event_type") == "error", "bad").otherwise("good")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("pool"), F.col("event_id").alias("seq"), F.expr("unix_seconds(cast(ts as timestamp)) div 8").alias("at_s"), op.alias("op"))
    return folds.fold_batch(e, "pool", ["at_s", "seq"], folds.reuse_step, folds.REUSE_OUT)


@query(_THROTTLE_SQL)
def throttle_states(spark, sf_dir):
    """Events at a ten-thousandth of their time, so that back-offs overlap."""
    kind = F.when(F.col("event_type") == "error", "429").when(F.col("event_type") == "click", "fetch").when(F.col("event_type") == "signup", "delay").otherwise("ok")
    at = F.expr("unix_micros(cast(ts as timestamp)) div 1000 div 10000")
    value = F.when(kind == "delay", (3000 + F.col("event_id") % 5000).cast("double"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("domain"), F.col("event_id").alias("seq"), at.alias("at_ms"), kind.alias("event"), value.alias("value"))
    return folds.fold_batch(e, "domain", ["at_ms", "seq"], folds.throttle_step, folds.THROTTLE_OUT)


@query(_LIFECYCLE_SQL)
def request_lifecycle(spark, sf_dir):
    op = F.element_at(F.array(*map(F.lit, ("add", "fetch", "handle", "reclaim"))), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"))
    return folds.fold_batch(e, "key", ["seq"], folds.lifecycle_step, folds.LIFECYCLE_OUT)


@query(_SCALE_SQL)
def autoscaling(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("pool"), F.col("event_id").alias("seq"), (F.col("event_id") * 37 % 201).alias("current"), (F.col("event_type") != "error").alias("idle"))
    return folds.fold_batch(e, "pool", ["seq"], folds.autoscale_step, folds.SCALE_OUT)
