"""Ordered folds per key, each one pure function step(state, event) -> state, output, for batch and for streams.

A key's events are folded in order. In a batch, sorted rows of a key pass through a generator one Arrow batch at a
time, so a key that holds a third of the rows takes one task's time but never its memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Step = Callable[[dict | None, dict], tuple[dict, dict | None]]


def fold_batch(events: DataFrame, key: str, order: list[str], step: Step, schema: str) -> DataFrame:
    """Outputs of step over the events of each key in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last, names = None, object(), [x.split()[0] for x in schema.split(",")]
        for b in batches:
            out = []
            for e in b.to_dict("records"):
                if e[key] != last:
                    state, last = None, e[key]
                state, row = step(state, e)
                if row is not None:
                    out.append(row)
            yield pd.DataFrame(out, columns=names)

    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def processor(key: str, order: list[str], step: Step, schema: str, state_schema: str) -> type[StatefulProcessor]:
    """The same step as a processor for transformWithStateInPandas; state_schema: DDL of the state's fields."""
    fields = [x.split()[0] for x in state_schema.split(",")]
    names = [x.split()[0] for x in schema.split(",")]

    class Fold(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("state", state_schema)

        def handleInputRows(self, key_values: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
            state = dict(zip(fields, self.state.get(), strict=True)) if self.state.exists() else None
            every = pd.concat(list(rows)).sort_values(order)
            out = []
            for e in every.to_dict("records"):
                state, row = step(state, e)
                if row is not None:
                    out.append(row)
            if state is not None:
                self.state.update(tuple(state[f] for f in fields))
            yield pd.DataFrame(out, columns=names)

        def close(self) -> None:
            pass

    return Fold


def fold_stream(events: DataFrame, key: str, order: list[str], step: Step, schema: str, state_schema: str) -> DataFrame:
    p = processor(key, order, step, schema, state_schema)()
    return events.groupBy(key).transformWithStateInPandas(statefulProcessor=p, outputStructType=schema, outputMode="Append", timeMode="None")


# Session scores and limits.
MAX_SCORE, GOOD, BAD, MAX_USAGE, MAX_AGE_S = 3.0, 0.5, 1.0, 50, 3000
SESSION_STATE = "score double, usage long, since double, retired boolean"
SESSION_OUT = "session_id long, seq long, score double, usage long, usable boolean"


def session_step(state: dict | None, e: dict) -> tuple[dict, dict]:
    """e(session_id, seq, at_s, op good|bad|retire). Good lowers the score, bad raises it, both count a use."""
    s = dict(state) if state else {"score": 0.0, "usage": 0, "since": float(e["at_s"]), "retired": False}
    usable = lambda: not s["retired"] and s["score"] < MAX_SCORE and s["usage"] < MAX_USAGE and e["at_s"] - s["since"] < MAX_AGE_S
    if e["op"] == "retire":
        s["retired"], s["score"] = True, s["score"] + (0 if s["retired"] else MAX_SCORE)
    else:
        s["usage"] += 1
        s["score"] = max(0.0, s["score"] - GOOD) if e["op"] == "good" else s["score"] + BAD
    s["retired"] = s["retired"] or not usable()
    return s, {"session_id": e["session_id"], "seq": e["seq"], "score": s["score"], "usage": s["usage"], "usable": usable()}


REUSE_STATE = "session long, " + SESSION_STATE
REUSE_OUT = "pool long, seq long, session long, score double, usage long"


def reuse_step(state: dict | None, e: dict) -> tuple[dict, dict]:
    """e(pool, seq, at_s, op good|bad|retire): a pool's requests keep to one session until it can't be used, and then
    take a new one, numbered from 0. A session that ran out by age is noticed when the next request comes."""
    s = dict(state) if state else None
    if s is None or s["retired"] or e["at_s"] - s["since"] >= MAX_AGE_S:
        s = {"session": s["session"] + 1 if s else 0, "score": 0.0, "usage": 0, "since": float(e["at_s"]), "retired": False}
    inner, _ = session_step({k: s[k] for k in ("score", "usage", "since", "retired")}, e | {"session_id": 0})
    s |= inner
    return s, {"pool": e["pool"], "seq": e["seq"], "session": s["session"], "score": s["score"], "usage": s["usage"]}


# Back-off of a domain that answers 429.
BASE_MS, MOST_MS, STALL_MS = 2000, 60_000, 900_000
THROTTLE_STATE = "backoff_until long, decays_at long, n429 long, limited_since long, limited_last long, next_free long, crawl_delay long"
THROTTLE_OUT = "domain long, seq long, n429 long, backoff_until long, wait_ms long, stalled boolean"


def throttle_step(state: dict | None, e: dict) -> tuple[dict, dict]:
    """e(domain, seq, at_ms, event 429|ok|fetch|delay, value ms or None). One bump per back-off; the count starts anew after
    as long again; the first declared crawl delay stays; wait_ms: how long the next fetch has to wait."""
    s = dict(state) if state else {"backoff_until": 0, "decays_at": 0, "n429": 0, "limited_since": 0, "limited_last": 0, "next_free": 0, "crawl_delay": -1}
    now, value = int(e["at_ms"]), e.get("value")
    value = None if value is None or value != value else int(value)
    if e["event"] == "429":
        s["limited_last"] = now
        s["limited_since"] = s["limited_since"] or now
        if now >= s["backoff_until"]:
            s["n429"] = 1 if now >= s["decays_at"] else s["n429"] + 1
            delay = min(MOST_MS, value if value is not None else BASE_MS << min(s["n429"] - 1, 20))
            s["backoff_until"], s["decays_at"] = now + delay, now + 2 * delay
    elif e["event"] == "ok":
        s["limited_since"] = 0
    elif e["event"] == "delay" and s["crawl_delay"] < 0 and value is not None:
        s["crawl_delay"] = value
    elif e["event"] == "fetch" and s["crawl_delay"] > 0:
        s["next_free"] = now + s["crawl_delay"]
    free = max(s["backoff_until"], s["next_free"])
    stalled = s["limited_since"] != 0 and now - s["limited_last"] <= STALL_MS and now - s["limited_since"] > STALL_MS
    return s, {"domain": e["domain"], "seq": e["seq"], "n429": s["n429"], "backoff_until": s["backoff_until"], "wait_ms": max(0, free - now), "stalled": stalled}


# States a request goes through, and the state an operation leads to.
TRANSITIONS = {("", "add"): "pending", ("pending", "fetch"): "in_progress", ("in_progress", "handle"): "handled", ("in_progress", "reclaim"): "pending"}
LIFECYCLE_STATE = "state string, fetches long"
LIFECYCLE_OUT = "key long, seq long, state string, fetches long, valid boolean"


def lifecycle_step(state: dict | None, e: dict) -> tuple[dict, dict]:
    """e(key, seq, op add|fetch|handle|reclaim). What the state doesn't allow changes nothing and is not valid; adding
    a key again isn't an error."""
    s = dict(state) if state else {"state": "", "fetches": 0}
    to = TRANSITIONS.get((s["state"], e["op"]))
    valid = to is not None or (e["op"] == "add" and s["state"] != "")
    if to is not None:
        s["state"], s["fetches"] = to, s["fetches"] + (e["op"] == "fetch")
    return s, {"key": e["key"], "seq": e["seq"], "state": s["state"], "fetches": s["fetches"], "valid": valid}


# The autoscaler's bounds and steps.
SCALE = {"low": 1, "high": 200, "step": 0.05, "use": 0.9}
SCALE_STATE = "desired long"
SCALE_OUT = "pool long, seq long, desired long"


def autoscale_step(state: dict | None, e: dict) -> tuple[dict, dict]:
    """e(pool, seq, current, idle): desired concurrency goes up by 5 % when it's used and the system is idle, down when
    it isn't."""
    d = state["desired"] if state else SCALE["low"]
    by = -int(-d * SCALE["step"] // 1)
    if e["idle"] and d < SCALE["high"] and e["current"] >= int(d * SCALE["use"]):
        d = min(SCALE["high"], d + by)
    elif not e["idle"] and d > SCALE["low"]:
        d = max(SCALE["low"], d - by)
    return {"desired": d}, {"pool": e["pool"], "seq": e["seq"], "desired": d}


def retry_outcomes(attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """attempts(key, seq, ok, no_retry) -> key, attempts, retry_count, state done|failed|pending: the first success, the
    first error that forbids retries or the error after max_retries ends a request; later rows don't count."""
    n = F.col("n")
    firsts = attempts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "ok", "no_retry"))).alias("a"))
    last = F.aggregate("a", F.struct(F.lit(0).alias("n"), F.lit("pending").alias("s")), lambda s, x: F.when(s["s"] != "pending", s).otherwise(F.struct((s["n"] + 1).alias("n"), F.when(x["ok"], F.lit("done")).when(x["no_retry"] | (s["n"] >= max_retries), F.lit("failed")).otherwise(F.lit("pending")).alias("s"))))
    return firsts.select("key", last.alias("r")).select("key", F.col("r.n").alias("n"), F.col("r.s").alias("state")).select("key", n.cast("long").alias("attempts"), F.greatest(n - 1, F.lit(0)).cast("long").alias("retry_count"), "state")


def crawl_delay_schedule(requests: DataFrame, delay_ms: int, by: str = "domain", at: str = "at_ms", order: str = "seq") -> DataFrame:
    """When each request may be fetched if fetches of a domain are delay_ms apart: max over earlier ones of their time
    and the delays since."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(at, order)
    i = F.row_number().over(w)
    rows = requests.withColumn("_i", i)
    run = F.max(F.col(at) - F.col("_i") * delay_ms).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("fetch_at", run + F.col("_i") * delay_ms).drop("_i")


def new_requests(requests: DataFrame, ttl: str = "1 day", at: str = "ts") -> DataFrame:
    """Streaming deduplication by unique_key within a watermark, so that state stays bounded."""
    return requests.withWatermark(at, ttl).dropDuplicatesWithinWatermark(["unique_key"])


def fetch_counts(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Streaming counts of outcomes in tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "outcome").count()
