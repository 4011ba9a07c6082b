"""Run statistics, load signals, rates and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Share of overloaded time from which a signal counts as overloaded.
RATIOS = {"memory": 0.2, "eventLoop": 0.6, "cpu": 0.4, "storage": 0.3}


def js_round(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + 0.5)


def run_statistics(jobs: DataFrame, run_start_ms: int, now_ms: int) -> DataFrame:
    """jobs(start_ms, end_ms, outcome finish|fail|discard, retry_count) -> one row.

    Least and greatest durations are of finished jobs. Averages that round to 0 and rates of an instant are null
    (infinite). Finished per minute is rounded, failed per minute rounded down. Discarded jobs don't count."""
    took = F.col("end_ms") - F.col("start_ms")
    fin, bad = F.col("outcome") == "finish", F.col("outcome") == "fail"
    a = jobs.agg(
        F.count_if(fin).alias("finished"), F.count_if(bad).alias("failed"), F.count_if((fin | bad) & (F.col("retry_count") > 0)).alias("retried"),
        F.min(F.when(fin, took)).alias("min_ms"), F.max(F.when(fin, took)).alias("max_ms"),
        F.coalesce(F.sum(F.when(fin, took)), F.lit(0)).alias("finished_ms"), F.coalesce(F.sum(F.when(bad, took)), F.lit(0)).alias("failed_ms"),
    )
    minutes = F.lit((now_ms - run_start_ms) / 60000)
    mean = lambda s, n: F.when(F.col(n) > 0, F.when(js_round(F.col(s) / F.col(n)) > 0, js_round(F.col(s) / F.col(n))))
    rate = lambda f, n: F.when(minutes > 0, f(F.col(n) / minutes))
    return a.withColumns({"avg_finished_ms": mean("finished_ms", "finished"), "avg_failed_ms": mean("failed_ms", "failed"), "finished_per_minute": rate(js_round, "finished"), "failed_per_minute": rate(F.floor, "failed"), "total_ms": F.col("finished_ms") + F.col("failed_ms"), "total": F.col("finished") + F.col("failed"), "runtime_ms": F.lit(now_ms - run_start_ms).cast("long")})


def retry_histogram(jobs: DataFrame) -> DataFrame:
    """One row: histogram, jobs by number of retries, without gaps. Counts are partial before they meet."""
    n = jobs.where("outcome in ('finish', 'fail')").groupBy("retry_count").count()
    m = n.agg(F.map_from_entries(F.collect_list(F.struct("retry_count", "count"))).alias("m"), F.max("retry_count").alias("top"))
    return m.select(F.transform(F.sequence(F.lit(0), F.coalesce("top", F.lit(0)).cast("int")), lambda i: F.coalesce(F.element_at("m", i.cast(dict(n.dtypes)["retry_count"])), F.lit(0))).alias("histogram"))


def status_counts(responses: DataFrame, low: int = 400, high: int = 599) -> DataFrame:
    return responses.where(F.col("status").between(low, high)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def weighted_average(rows: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("average"))


def latest_window(samples: DataFrame, window_ms: int) -> DataFrame:
    """samples(signal, at_ms, ...) within window_ms of their signal's latest one."""
    last = samples.groupBy("signal").agg(F.max("at_ms").alias("_last"))
    return samples.join(last, "signal").where(F.col("_last") - F.col("at_ms") <= window_ms).drop("_last")


def evaluate_load(samples: DataFrame, thresholds: dict[str, float] | None = None, window_ms: int | None = None) -> DataFrame:
    """samples(signal, at_ms, is_overloaded) -> signal, actual_ratio, limit_ratio, is_overloaded.

    A sample weighs the time since the one before (1 ms at least); the first weighs nothing unless it's alone. The
    ratio is rounded to 3 places. Gaps come from a window per signal and minute and the last sample of earlier minutes."""
    rows = latest_window(samples, window_ms) if window_ms is not None else samples
    rows = rows.withColumn("_m", F.expr("at_ms div 60000"))
    ends = rows.groupBy("signal", "_m").agg(F.max("at_ms").alias("_end"))
    ends = ends.withColumn("_prev", F.lag("_end").over(Window.partitionBy("signal").orderBy("_m")))
    inside = F.lag("at_ms").over(Window.partitionBy("signal", "_m").orderBy("at_ms", "is_overloaded"))
    gaps = rows.withColumn("_in", inside).join(ends, ["signal", "_m"])
    before = F.coalesce("_in", "_prev")
    gaps = gaps.withColumn("_w", F.when(before.isNotNull(), F.greatest(F.col("at_ms") - before, F.lit(1))))
    over = F.col("is_overloaded").cast("int")
    limits = F.create_map(*[F.lit(x) for kv in (thresholds or RATIOS).items() for x in kv])
    out = gaps.groupBy("signal").agg(F.coalesce(F.sum(over * F.col("_w")) / F.sum("_w"), F.max(over).cast("double")).alias("_r"))
    out = out.select("signal", F.round("_r", 3).alias("actual_ratio"), F.coalesce(F.try_element_at(limits, F.col("signal")), F.lit(0.5)).alias("limit_ratio"))
    return out.withColumn("is_overloaded", F.col("actual_ratio") > F.col("limit_ratio"))


def system_status(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(F.coalesce(F.bool_and(~F.col("is_overloaded")), F.lit(True)).alias("is_system_idle"))


def rate_last_minute(events: DataFrame, by: list[str], at_s: str, most: int) -> DataFrame:
    """Per group and second: n_60, starts in the 60 seconds up to it; blocked when they reach most. Counted per second first."""
    n = events.groupBy(*by, at_s).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(at_s).rangeBetween(-59, 0)
    return n.withColumn("n_60", F.sum("n").over(w)).withColumn("blocked", F.col("n_60") >= most)


def download_speed(chunks: DataFrame, least: float, span_s: int = 10) -> DataFrame:
    """chunks(id, at_s, bytes): bytes a second over the last span_s seconds; slow when under least."""
    n = chunks.groupBy("id", "at_s").agg(F.sum("bytes").alias("bytes"))
    w = Window.partitionBy("id").orderBy("at_s")
    first = F.first("at_s").over(w.rowsBetween(Window.unboundedPreceding, 0))
    speed = F.sum("bytes").over(w.rangeBetween(1 - span_s, 0)) / F.least(F.lit(span_s), F.col("at_s") - first + 1)
    return n.withColumn("speed", speed).withColumn("slow", F.col("speed") < least)


def period_delta(counters: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(at)
    return counters.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def round_robin(rows: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """Adds pick 0 .. n-1 in turn by order."""
    from skein.operators.frontier import place

    return place(rows, order, "_p").withColumn("pick", F.pmod("_p", F.lit(n))).drop("_p")


def pool_counts(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count_if("usable").alias("usable"), F.count_if(~F.col("usable")).alias("retired"))
