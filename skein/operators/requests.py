"""A request's life: its states, a queue's journal, the session that serves it, batches of additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.frontier import place, serving_order

# The states of a request, each with those that may follow it. A request that was reclaimed starts again
# from `done`.
NEXT_STATES = {
    "unprocessed": ("before_nav", "request_handler", "error_handler", "skipped"),
    "before_nav": ("after_nav", "error_handler", "error", "skipped"),
    "after_nav": ("request_handler", "error_handler", "skipped"),
    "request_handler": ("done", "error_handler"),
    "error_handler": ("done", "error"),
    "done": ("before_nav", "request_handler", "error_handler", "skipped"),
    "error": ("error_handler",),
    "skipped": (),
}


def request_states(moves: DataFrame) -> DataFrame:
    """moves(key, seq, state) with before (the state that the row before left; `unprocessed` at first) and valid, whether
    state may follow it. A key's moves are ordered in one task."""
    before = F.coalesce(F.lag("state").over(Window.partitionBy("key").orderBy("seq")), F.lit("unprocessed"))
    allowed = F.create_map(*[x for s, then in NEXT_STATES.items() for x in (F.lit(s), F.array(*map(F.lit, then)) if then else F.array().cast("array<string>"))])
    out = moves.withColumn("before", before)
    return out.withColumn("valid", F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("before")), F.col("state")), F.lit(False)))


def queue_state(journal: DataFrame) -> DataFrame:
    """journal(seq, key, op add|fetch|handle|reclaim, forefront) -> a row for each added key: handled, in_progress,
    forefront, seq (its place in the order of serving, see frontier.serving_order).

    The first add counts, later ones find the request there. Whatever was handled stays so. The last of add, fetch and
    reclaim tells whether it is being worked on; a reclaim gives the request a new place. Only greatest and least places
    of a key count, so all of it is aggregated before the shuffle."""

    def at(op: str) -> Column:
        return F.when(F.col("op") == op, F.col("seq"))

    last = journal.groupBy("key").agg(
        F.min(at("add")).alias("_add"), F.max(at("fetch")).alias("_fetch"), F.max(at("handle")).alias("_handle"), F.max(at("reclaim")).alias("_back"),
        F.min_by("forefront", at("add")).alias("_add_front"), F.max_by("forefront", at("reclaim")).alias("_back_front"),
    )
    since = F.greatest("_add", "_back")
    moved = F.coalesce(F.col("_back") > F.col("_add"), F.lit(False))
    handled = F.coalesce(F.col("_handle") > F.col("_add"), F.lit(False))
    return last.where("_add is not null").select(
        "key", handled.alias("handled"), (~handled & F.coalesce(F.col("_fetch") > since, F.lit(False))).alias("in_progress"),
        F.coalesce(F.when(moved, F.col("_back_front")).otherwise(F.col("_add_front")), F.lit(False)).alias("forefront"), F.when(moved, F.col("_back")).otherwise(F.col("_add")).alias("seq"),
    )


def queue_counts(state: DataFrame) -> DataFrame:
    """One row of queue_state(): handled, pending, in_progress, is_empty (none to fetch), is_finished (nor worked on)."""
    handled, busy = F.count_if("handled"), F.count_if("in_progress")
    waiting = F.count_if(~F.col("handled") & ~F.col("in_progress"))
    return state.agg(handled.alias("handled"), (waiting + busy).alias("pending"), busy.alias("in_progress"), (waiting == 0).alias("is_empty"), (waiting + busy == 0).alias("is_finished"))


def queue_head(state: DataFrame, limit: int) -> DataFrame:
    """The next limit requests, as they are served. Takes the least rows of each task before they meet."""
    return serving_order(state).orderBy("front", "at").limit(limit)


def random_picks(requests: DataFrame, pool: int, seed: int = 0, order: str = "seq") -> DataFrame:
    """Adds pick, the session of each request: the first ones fill the pool with new sessions 0 .. pool - 1, later ones
    take any, told by a hash of order and seed, so reruns agree."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(order).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
    return place(requests, order, "_p").withColumn("pick", F.when(F.col("_p") < pool, F.col("_p")).otherwise(h % pool).cast("long")).drop("_p")


def batched_adds(requests: DataFrame, size: int = 1000, budget: int | None = None, key: str = "key", order: str = "seq") -> DataFrame:
    """requests(seq, key) as they are added in batches of size: batch, is_first (the batch that a caller waits for),
    is_new (first of its key) and added: new and among the first budget new ones. Others are left to a later call."""
    first = requests.groupBy(key).agg(F.min(order).alias("_first"))
    rows = place(requests, order, "_p").join(first, key).withColumn("is_new", F.col(order) == F.col("_first"))
    rows = rows.withColumn("batch", F.expr(f"_p div {size}")).withColumn("is_first", F.col("batch") == 0)
    if budget is None:
        return rows.withColumn("added", F.col("is_new")).drop("_p", "_first")
    edge = place(first, "_first", "_at").where(F.col("_at") == budget).agg(F.min("_first").alias("_edge"))
    inside = F.col("_edge").isNull() | (F.col(order) < F.col("_edge"))
    return rows.join(F.broadcast(edge)).withColumn("added", F.col("is_new") & inside).drop("_p", "_first", "_edge")  # one row
