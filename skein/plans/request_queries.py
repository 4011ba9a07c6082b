"""Queries over requests: states, a queue's journal, session picks, batches of additions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import requests as Q
from skein.plans.registry import query, table

_PAIRS = ", ".join(f"('{s}', '{t}')" for s, then in Q.NEXT_STATES.items() for t in then)
_STATES = ", ".join(f"'{s}'" for s in Q.NEXT_STATES)


@query(f"""WITH m AS (SELECT user_id AS key, event_id AS seq, [{_STATES}][(event_id * 5 % 8 + 1)::INT] AS state FROM events),
b AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY key ORDER BY seq), 'unprocessed') AS before FROM m)
SELECT key, seq, state, before, (before, state) IN (SELECT (p.a, p.b) FROM (VALUES {_PAIRS}) p(a, b)) AS valid FROM b""")
def request_states(spark, sf_dir):
    state = F.element_at(F.array(*map(F.lit, Q.NEXT_STATES)), (F.col("event_id") * 5 % 8 + 1).cast("int"))
    return Q.request_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), state.alias("state")))


_JOURNAL = "j AS (SELECT event_id // 4 AS key, event_id AS seq, CASE event_type WHEN 'click' THEN 'fetch' WHEN 'purchase' THEN 'handle' WHEN 'error' THEN 'reclaim' ELSE 'add' END AS op, value > 50 AS forefront FROM events)"
# The journal taken row by row: what a later row does depends on what was there before it.
_QUEUE = f"""{_JOURNAL}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM j),
f AS (SELECT key, 0::BIGINT AS i, 'none' AS state, 0::BIGINT AS seq, false AS forefront FROM n WHERE i = 1
UNION ALL SELECT n.key, n.i,
CASE WHEN f.state = 'none' THEN CASE WHEN n.op = 'add' THEN 'pending' ELSE 'none' END WHEN f.state = 'handled' THEN 'handled' WHEN n.op = 'fetch' THEN 'busy' WHEN n.op = 'handle' THEN 'handled' WHEN n.op = 'reclaim' THEN 'pending' ELSE f.state END,
CASE WHEN (f.state = 'none' AND n.op = 'add') OR (f.state IN ('pending', 'busy') AND n.op = 'reclaim') THEN n.seq ELSE f.seq END,
CASE WHEN (f.state = 'none' AND n.op = 'add') OR (f.state IN ('pending', 'busy') AND n.op = 'reclaim') THEN n.forefront ELSE f.forefront END FROM f JOIN n ON n.key = f.key AND n.i = f.i + 1),
q AS (SELECT key, state = 'handled' AS handled, state = 'busy' AS in_progress, forefront, seq FROM f WHERE state <> 'none' QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1)"""


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    op = F.when(t == "click", "fetch").when(t == "purchase", "handle").when(t == "error", "reclaim").otherwise("add")
    return Q.queue_state(table(spark, sf_dir, "events").select(F.expr("event_id div 4").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("value") > 50).alias("forefront")))


@query(f"WITH RECURSIVE {_QUEUE} SELECT key, handled, in_progress, CASE WHEN NOT handled THEN forefront END AS forefront, CASE WHEN NOT handled THEN seq END AS seq FROM q")
def queue_state(spark, sf_dir):
    open_ = ~F.col("handled")
    return _state(spark, sf_dir).withColumn("forefront", F.when(open_, F.col("forefront"))).withColumn("seq", F.when(open_, F.col("seq")))


@query(f"WITH RECURSIVE {_QUEUE} SELECT count(*) FILTER (handled) AS handled, count(*) FILTER (NOT handled) AS pending, count(*) FILTER (in_progress) AS in_progress, count(*) FILTER (NOT handled AND NOT in_progress) = 0 AS is_empty, count(*) FILTER (NOT handled) = 0 AS is_finished FROM q")
def queue_counts(spark, sf_dir):
    return Q.queue_counts(_state(spark, sf_dir))


@query(f"WITH RECURSIVE {_QUEUE} SELECT key, forefront, seq FROM q WHERE NOT handled AND NOT in_progress ORDER BY CASE WHEN forefront THEN 0 ELSE 1 END, CASE WHEN forefront THEN -seq ELSE seq END LIMIT 700")
def queue_head(spark, sf_dir):
    return Q.queue_head(_state(spark, sf_dir), 700).select("key", "forefront", "seq")


@query("WITH p AS (SELECT o_orderkey AS seq, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) SELECT seq, CASE WHEN p < 100 THEN p ELSE ('0x' || substr(md5(seq::VARCHAR || ':7'), 1, 8))::BIGINT % 100 END AS pick FROM p")
def session_random(spark, sf_dir):
    return Q.random_picks(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq")), 100, seed=7)


@query("""WITH r AS (SELECT o_orderkey AS seq, o_custkey AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS is_new FROM orders),
c AS (SELECT *, sum(is_new::INT) OVER (ORDER BY seq) AS n FROM r) SELECT seq, key, p // 1000 AS batch, p < 1000 AS is_first, is_new, is_new AND n <= 600 AS added FROM c""")
def batched_adds(spark, sf_dir):
    return Q.batched_adds(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("key")), 1000, 600)
