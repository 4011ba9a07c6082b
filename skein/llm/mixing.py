"""Mixing sources to target weights with a van der Corput schedule of equal-token blocks (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import running_position, stored, word_count

#: Rows a generating task makes from one row of the schedule's outline.
CHUNK = 4096


def plan_targets(totals: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_words: int = 2048) -> DataFrame:
    """Targets by source: totals(key, source, source_size) -> one row a source.

    Sources in code-point order (null last) weigh as weights repeat. share times all sizes is dealt by weight; no
    target is above cap times its source's size and what is cut is dealt again by weight. Sources sorted by
    cap/weight fill in that order, so one prefix pass replaces the rounds. Adds target (double), take (whole words),
    rest (words of the last, partial pass), blocks (of the source), need (slots) and first_slot (needs of earlier sources).
    The windows run on one row a source.
    """
    ranked = totals.withColumn("_r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_r") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_r").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    ranked = ranked.select("*", F.coalesce(F.sum("_cap").over(fill), F.lit(0.0)).alias("_caps"), F.coalesce(F.sum("_w").over(fill), F.lit(0.0)).alias("_ws"), F.sum("_w").over(every).alias("_all_w"), (F.sum("source_size").over(every) * F.lit(float(share))).alias("_want"))
    free = F.col("_cap") * (F.col("_all_w") - F.col("_ws")) > (F.col("_want") - F.col("_caps")) * F.col("_w")
    ranked = ranked.withColumn("_free", free)
    level = F.min(F.when(F.col("_free"), F.struct(F.col("_ws"), F.col("_caps")))).over(every)
    ranked = ranked.withColumn("_level", level)
    spare = (F.col("_want") - F.col("_level._caps")) * F.col("_w") / (F.col("_all_w") - F.col("_level._ws"))
    out = ranked.withColumn("target", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), spare)))
    take, size = F.floor("target").cast("long"), F.col("source_size")
    out = out.withColumn("take", take).withColumn("passes", F.when(size > 0, F.expr("take div source_size")).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn("rest", F.col("take") - F.col("passes") * size).withColumn("blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
    out = out.withColumn("need", F.col("passes") * F.col("blocks") + F.expr(f"(rest + {block_words - 1}) div {block_words}"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("first_slot", F.coalesce(F.sum("need").over(before), F.lit(0))).withColumn("slots", F.sum("need").over(every))
    return out.select("key", "source", "source_size", "target", "take", "passes", "rest", "blocks", "need", "first_slot", "slots")


def schedule(plan: DataFrame, block_words: int = 2048) -> DataFrame:
    """The slots of the mix: slot (order of reading), key, rank (among the source's slots), block, pass, words.

    The sources' cumulative needs cut 0..2^m (2^m: the power of two not below all needs) into intervals; slot t
    belongs to the source whose interval holds t's van der Corput point, its m bits reversed. A source therefore
    makes its own slots from its interval, without a lookup; its first need slots in order of t are taken.
    """
    edges = plan.where("need > 0").withColumn("_m", F.when(F.col("slots") > 1, F.length(F.bin(F.col("slots") - 1))).otherwise(F.lit(0)))
    point = "cast((cast({} as decimal(19,0)) * cast(shiftleft(1L, _m) as decimal(19,0))) div slots as bigint)"
    edges = edges.withColumn("_lo", F.expr(point.format("first_slot"))).withColumn("_hi", F.expr(point.format("(first_slot + need)")))
    outline = edges.select("key", "need", "rest", "passes", "blocks", "source_size", "_m", "_lo", "_hi", F.explode(F.expr(f"sequence(_lo div {CHUNK}, (_hi - 1) div {CHUNK})")).alias("_c")).repartition("key", "_c")
    j = F.explode(F.expr(f"sequence(greatest(_lo, _c * {CHUNK}), least(_hi, (_c + 1) * {CHUNK}) - 1)")).alias("_j")
    slots = outline.select("key", "need", "rest", "passes", "blocks", "source_size", "_m", j)
    slots = slots.withColumn("slot", F.coalesce(F.conv(F.reverse(F.expr("lpad(bin(_j), _m, '0')")), 2, 10).cast("long"), F.lit(0)))
    slots = slots.withColumn("_b", F.expr("shiftright(slot, greatest(0, _m - 12))")).drop("_j", "_m")
    ranked = running_position(slots, "key", "_b", ["slot"]).withColumnRenamed("place", "rank").where("rank < need")
    ranked = ranked.withColumn("block", F.expr("rank % blocks")).withColumn("pass", F.expr("rank div blocks"))
    held = F.when(F.col("pass") < F.col("passes"), F.col("source_size")).otherwise(F.col("rest"))
    return ranked.select("slot", "key", "rank", "block", "pass", F.least(F.lit(block_words), held - F.col("block") * block_words).alias("words"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_words: int = 2048, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, slots, pieces) of the mix of docs.

    placed: a row a document in its source's shuffled order, with its place and the words before it. Documents are
    shuffled by md5 of seed and id, so reruns agree; repeated rows stay neighbours and are told apart by place.
    slots: see schedule(). pieces: a row for each slot and document that the slot reads, with from_word and to_word
    (of the document) and words. Null text or id: size 0, or an id as any other. An empty source has target 0.
    A source may hold a third of all rows: order is made by (source, hash bucket), the join is on (source, block).
    """
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    key = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"), word_count(F.col(text_col)).alias("size"), h.alias("_h"))
    rows = stored(rows.withColumn("bucket", F.expr("cast(conv(substring(_h, 1, 3), 16, 10) as int) div 4")), "mix")
    totals = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    plan = stored(plan_targets(totals, weights, share, cap, block_words), "targets")
    slots = stored(schedule(plan, block_words), "slots")
    placed = running_position(rows, "key", "bucket", ["_h", "doc_id", "size"], "size", plan.select("key", "source_size", "target", "take", "passes", "rest")).drop("_h")
    blocks = F.explode(F.expr(f"sequence(before div {block_words}, (before + size - 1) div {block_words})")).alias("block")
    cut = placed.where("size > 0").select("key", "bucket", "place", "doc_id", "source", "size", "source_size", "target", "before", blocks)
    start = F.col("block") * block_words
    lo = F.greatest(F.col("before"), start)
    hi = F.least(F.col("before") + F.col("size"), start + F.col("words"))
    # The slots' file is small for its rows (it packs well), so its size would let it be broadcast far beyond what that allows for.
    pieces = cut.join(slots.hint("merge"), ["key", "block"]).withColumn("from_word", lo - F.col("before")).withColumn("to_word", hi - F.col("before"))
    pieces = pieces.where("to_word > from_word").withColumn("words", F.col("to_word") - F.col("from_word"))
    return placed, slots, pieces


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    placed, _, pieces = mix_sources(docs, **options)
    keys = ["key", "bucket", "place", "doc_id", "size", "source_size", "target"]
    both = placed.select(*keys, F.lit(0).cast("long").alias("words")).unionByName(pieces.select(*keys, F.col("words").cast("long")))
    return both.groupBy(*keys).agg(F.sum("words").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def repeated_documents(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs as the mix reads them: each row as often as slots reach its first word, so 0 to cap times, columns as they were.

    Whole documents only: one that the end of its source's last pass cuts is taken whole. Rows sharing an id are
    taken alike. Empty texts hold no words of the mix; they stay once.
    """
    placed, _, pieces = mix_sources(docs.select(*{id_col, options.get("text_col", "text"), options.get("source_col", "source")}), id_col=id_col, **options)
    times = pieces.where("from_word = 0").groupBy("key", "bucket", "place", "doc_id").count().groupBy("doc_id").agg(F.max("count").alias("_times"))
    times = times.unionByName(placed.where("size = 0").select("doc_id", F.lit(1).cast("long").alias("_times"))).groupBy("doc_id").agg(F.max("_times").alias("_times"))
    held = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"))
    out = held.join(times.withColumnRenamed("doc_id", "_key"), F.col("_id").eqNullSafe(F.col("_key")))
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("_row.*")
