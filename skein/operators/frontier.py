"""The URL frontier: request lists, deduplication, budgets, order of serving, and crawl waves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import urls as U
from skein.operators import predicates as P


def with_keys(sources: DataFrame, url: str = "url") -> DataFrame:
    """Adds unique_key (kept where it's given) and request_id."""
    own = F.col("unique_key") if "unique_key" in sources.columns else F.lit(None).cast("string")
    out = sources.withColumn("unique_key", F.coalesce(own, U.unique_key(url)))
    return out.withColumn("request_id", U.request_id("unique_key"))


def first_seen(rows: DataFrame, key: str = "unique_key", order: str = "seq") -> DataFrame:
    """The first row of each key by order, which no two rows of a key share. Aggregates before the shuffle, so a key that
    a third of the rows has costs little."""
    rest = [c for c in rows.columns if c != key]
    kept = rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return kept.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def request_list(sources: DataFrame, *, keep_duplicates: bool = False) -> DataFrame:
    """sources(seq, url, ...) as a list: first of each unique key. keep_duplicates: rows whose key is generated get
    their place among those kept as a suffix; given keys that repeat are still dropped."""
    given = F.col("unique_key").isNotNull() if "unique_key" in sources.columns else F.lit(False)
    rows = with_keys(sources.withColumn("_given", given))
    if not keep_duplicates:
        return first_seen(rows.drop("_given"))
    kept = first_seen(rows.where("_given")).unionByName(rows.where("not _given"))
    kept = place(kept, "seq", "_at")
    return kept.withColumn("unique_key", F.when(F.col("_given"), F.col("unique_key")).otherwise(F.concat_ws("-", "unique_key", "_at"))).withColumn("request_id", U.request_id("unique_key")).drop("_given", "_at")


def place(rows: DataFrame, order: str, name: str, per_task: int = 1 << 16) -> DataFrame:
    """Adds the place 0, 1, ... of a row by order (a number; nulls first, in any order among them).

    Rows go to at most 256 parts of about as many rows, cut at approximate quantiles, whatever values lie between: a row
    for each part is all that meets in one task. The driver sees the cuts.
    """
    at = F.col(order).cast("double")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(at, F.array(*[F.lit(i / 256) for i in range(1, 256)]), 10_000).alias("q")).first()
    parts = min(256, -(-seen["n"] // per_task))
    cuts = sorted({seen["q"][256 * i // parts - 1] for i in range(1, parts)}) if parts > 1 and seen["q"] else []
    part = F.when(at.isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= at)) if cuts else F.lit(0))
    inside = rows.withColumn("_b", part).withColumn(name, F.row_number().over(Window.partitionBy("_b").orderBy(F.col(order).asc_nulls_first())) - 1)
    if not cuts and rows.where(at.isNull()).isEmpty():
        return inside.drop("_b")
    earlier = rows.groupBy(part.alias("_b")).count()
    earlier = earlier.select("_b", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n"))
    return inside.join(F.broadcast(earlier), "_b").withColumn(name, F.col(name) + F.col("_n")).drop("_b", "_n")  # at most 257 rows


def requests_from_text(lines: DataFrame, text: str = "value", commas: bool = False, **shared: Column) -> DataFrame:
    """One request for each URL in the text of lines(seq, ...); shared: columns that all get."""
    out = lines.select("seq", F.posexplode(T.extract_urls(text, commas)).alias("i", "url"))
    return out.select((F.col("seq") * (1 << 20) + F.col("i")).alias("seq"), "url", *[c.alias(n) for n, c in shared.items()])


def list_download_url(url: Column | str) -> Column:
    """Spreadsheets of docs.google.com are read through their CSV export."""
    u = F.col(url) if isinstance(url, str) else url
    sheet = r"^(https://docs\.google\.com/spreadsheets/d/(?:\w|-)+)/?.*$"
    return F.when(u.rlike(sheet), F.concat(F.regexp_extract(u, sheet, 1), F.lit("/gviz/tq?tqx=out:csv"))).otherwise(u)


def split_known(requests: DataFrame, seen: DataFrame, key: str = "unique_key") -> tuple[DataFrame, DataFrame]:
    """(new, already present) by key."""
    keys = seen.select(key).where(F.col(key).isNotNull())
    return requests.join(keys, key, "left_anti"), requests.join(keys, key, "left_semi")


def within_budget(requests: DataFrame, budget: int, is_new: str = "is_new", order: str = "seq") -> DataFrame:
    """Adds reason: `limit` for rows that come when new rows have used up the budget; only new rows use it."""
    news = place(requests.where(F.col(is_new)).select(F.col(order).alias("_s")), "_s", "_at")
    edge = news.where(F.col("_at") == budget).agg(F.min("_s").alias("_edge"))
    # The first new row beyond the budget marks where adding stops: one number.
    return requests.join(F.broadcast(edge)).withColumn("reason", F.when(F.col("_edge").isNotNull() & (F.col(order) >= F.col("_edge")), F.lit("limit"))).drop("_edge")


def enqueue_budget(limit: int | None, most: int | None, handled: int, pending: int) -> int | None:
    """The lesser of an explicit limit and what is left of the crawl's maximum."""
    left = None if most is None else max(0, most - handled - pending)
    return min(x for x in (limit, left) if x is not None) if limit is not None or left is not None else None


def serving_order(queue: DataFrame) -> DataFrame:
    """queue(seq, forefront, handled, in_progress, ...): pending rows with sort keys front, at: forefront first, the
    latest of those leading, then by arrival. order by front, at serves them."""
    front = F.when(F.col("forefront"), F.lit(0)).otherwise(F.lit(1))
    return queue.where("not handled and not in_progress").withColumn("front", front).withColumn("at", F.when(F.col("forefront"), -F.col("seq")).otherwise(F.col("seq")))


def counts(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("handled_at").isNotNull()).alias("handled"), F.count_if(F.col("handled_at").isNull()).alias("pending"))


def request_options(sources: DataFrame, source: str = "source", label: str | None = None, user_data: str = "{}") -> DataFrame:
    """sources(seq, source): each a URL or a JSON object of a request -> seq, url, method, payload, unique_key, label,
    user_data (JSON). label and user_data hold for all rows; a row's own label and user data stand before them."""
    s = F.trim(source)
    own = F.when(s.startswith("{"), F.from_json(s, "url string, method string, payload string, uniqueKey string, label string, userData string"))
    mine = F.map_concat(F.from_json(F.lit(user_data), "map<string,string>"), F.create_map(F.lit("label"), F.lit(label)) if label is not None else F.create_map().cast("map<string,string>"))
    given = F.coalesce(F.from_json(own["userData"], "map<string,string>"), F.create_map().cast("map<string,string>"))
    named = F.when(own["label"].isNotNull(), F.create_map(F.lit("label"), own["label"])).otherwise(F.create_map().cast("map<string,string>"))
    # Of equal names the last counts.
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    data = over(over(mine, given), named)
    out = sources.select("seq", F.coalesce(own["url"], F.when(~s.startswith("{"), s)).alias("url"), F.upper(F.coalesce(own["method"], F.lit("GET"))).alias("method"), own["payload"].alias("payload"), own["uniqueKey"].alias("unique_key"), data.alias("_d"))
    return out.withColumn("label", F.col("_d")["label"]).withColumn("user_data", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("_d"))))).drop("_d")


def tandem(loader: DataFrame, queue: DataFrame) -> DataFrame:
    """Loader rows enter at the queue's front; keys the queue has stay the queue's."""
    new = loader.join(queue.select("unique_key"), "unique_key", "left_anti").withColumn("forefront", F.lit(True))
    return queue.unionByName(new, allowMissingColumns=True)


def shadowed(base: DataFrame, journal: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """base(key, value) as a transaction sees it: the journal's last value of a key stands before the stored one; null deletes."""
    last = journal.groupBy(key).agg(F.max_by("value", order).alias("_new")).withColumn("_in", F.lit(True))
    both = base.join(last, key, "full_outer").withColumn("value", F.when(F.col("_in"), F.col("_new")).otherwise(F.col("value")))
    return both.where("value is not null").select(key, "value")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows equally often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def waves(start: DataFrame, links: DataFrame, max_depth: int, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Breadth-first waves: start(unique_key), links(src, dst) -> unique_key, depth. store writes a wave and reads it
    back, so lineage doesn't grow. Each wave is one join and one anti join."""
    seen = store(start.select("unique_key").distinct().withColumn("depth", F.lit(0)))
    last = seen
    for depth in range(1, max_depth + 1):
        found = last.join(links, last["unique_key"] == links["src"]).select(F.col("dst").alias("unique_key")).distinct()
        last = store(found.join(seen.select("unique_key"), "unique_key", "left_anti").withColumn("depth", F.lit(depth)))
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen


def qualify(links: DataFrame, seen: DataFrame, options: P.EnqueueOptions) -> tuple[DataFrame, DataFrame]:
    """links(seq, url, base[, depth, robots_allowed]) -> (accepted, skipped with reason). Order of reasons: invalid
    (silent), depth, robotsTxt, filters, limit."""
    rows = with_keys(links.where(P.is_web("url")))
    depth, robots = ("depth" if "depth" in links.columns else None), ("robots_allowed" if "robots_allowed" in links.columns else None)
    rows = rows.withColumn("reason", P.skip_reason(options, depth=depth, allowed=robots))
    new, _ = split_known(first_seen(rows.where("reason is null")), seen)
    skipped = rows.where("reason is not null")
    if options.budget is not None:
        new = within_budget(new.drop("reason").withColumn("is_new", F.lit(True)), options.budget).drop("is_new")
        skipped, new = skipped.unionByName(new.where("reason is not null"), allowMissingColumns=True), new.where("reason is null")
    return new.drop("reason"), skipped
