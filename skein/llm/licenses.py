"""Licence scan: ordered signature rules, gated by keywords, overlaps resolved (DataFrame functions only)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import stored
from skein.llm.license_rules import GATE, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
PRIORITIES = (4, 3, 2, 1)
_BREAKS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"


def _blanks(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


def words_joined(text: Column) -> Column:
    """Words in lower case (A-Z only), with one blank between, before and after; a blank for no words."""
    body = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))
    return F.when(body == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), body, F.lit(" ")))


def count_words(text: Column) -> Column:
    short = F.regexp_replace(text, f"{_BREAKS}*{_WORD}+", "x")
    # A letter a word and then, at most, breaks after the last word.
    return F.coalesce(F.octet_length(F.regexp_extract(short, "^x*", 0)), F.lit(0))


def detections(texts: DataFrame) -> DataFrame:
    """texts(k, norm): a row for each rule match that stands: k, rule, label, priority, start, end (words). k tells texts
    apart. A rule's pattern is tried only where the literal that all its matches hold is.

    Of overlapping matches, one within another's span goes if its priority isn't higher; of equal spans and
    priorities the earlier rule stays. A text's matches are found and ordered in rows, so long texts don't pile up.
    """
    listed = [{"rule": i, "label": a, "word": b, "re": f"(?<= )(?:{c})(?= )", "priority": d} for i, (a, b, c, d) in enumerate(rules())]
    given = F.from_json(F.lit(json.dumps(listed)), "array<struct<rule: int, label: string, word: string, re: string, priority: int>>")
    hit = F.filter(given, lambda r: F.contains(F.col("norm"), r["word"]) & F.rlike(F.col("norm"), r["re"]))
    found = texts.select("k", "norm", F.explode(hit).alias("r"))
    gaps = F.transform(F.split(F.col("norm"), F.col("r.re"), -1), lambda x: _blanks(x))
    spans = F.transform(F.regexp_extract_all(F.col("norm"), F.col("r.re"), F.lit(0)), lambda x: _blanks(x) + 1)
    parts = found.select("k", F.col("r.rule").alias("rule"), F.col("r.label").alias("label"), F.col("r.priority").alias("priority"), F.posexplode(F.arrays_zip(gaps.alias("gap"), spans.alias("n"))).alias("i", "p"))
    run = Window.partitionBy("k", "rule").orderBy("i")
    # Between two matches lie their gap's blanks and the blanks inside the matches before.
    start = F.sum("p.gap").over(run) + F.coalesce(F.sum(F.col("p.n") - 1).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - 1
    spots = parts.withColumn("start", start).where("p.n is not null").select("k", "rule", "label", "priority", "start", (F.col("start") + F.col("p.n")).alias("end"))
    before = Window.partitionBy("k").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for p in PRIORITIES:
        covered = F.when(F.col("priority") == p, F.coalesce(F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before) >= F.col("end"), F.lit(False))).otherwise(covered)
    # A stronger match of equal start that's no longer may come later in this order: equal spans only, and there priority leads.
    return spots.withColumn("_gone", covered).where("not _gone").drop("_gone")


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: places of BASE phrases in the words. labels adds those of the rules that stand. score: 0 without labels,
    half for base labels alone, else a quarter of the highest priority found, base at least. Null and empty texts: no
    words. Repeated rows get the same; ties don't matter; an empty table gives none; other columns aren't looked at.
    Only texts that pass the keyword gate are looked into. Rows are numbered and written once, so that copies of one
    text, maybe a third of all rows, never meet; the matches of a long text are rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    norm = F.when(F.col("text").rlike(f"(?i)(?:{GATE})"), words_joined(F.col("text")))
    rows = rows.select("doc_id", count_words(F.col("text")).cast("long").alias("n_words"), norm.alias("norm"), F.monotonically_increasing_id().alias("k"))
    rows = stored(rows, "words")
    phrase = "(?<= )(?:" + "|".join(BASE) + ")(?= )"
    n_base = F.when(F.col("norm").isNotNull(), F.size(F.regexp_extract_all("norm", F.lit(phrase), F.lit(0)))).otherwise(F.lit(0)).cast("long")
    found = F.col("n_base") > 0
    first = F.when(found, _blanks(F.split("norm", phrase, 2)[0]) - 1).cast("long")
    last = F.when(found, _blanks(F.regexp_extract("norm", f"(?s)^(.*){phrase}", 1)) - 1).cast("long")
    labels = F.array_compact(F.array(*[F.when(found & F.contains(F.col("norm"), F.lit(f" {p} ")), F.lit(name)) for p, name in BASE.items()]))
    based = rows.withColumn("n_base", n_base).withColumns({"first_word": first, "last_word": last, "_base": F.array_sort(labels)}).drop("norm")
    by_text = detections(rows.where("norm is not null").select("k", "norm")).groupBy("k").agg(F.collect_set("label").alias("_more"), F.max("priority").alias("_top"))
    out = based.join(by_text, "k", "left")
    every = F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    score = F.greatest(F.when(F.size("_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)), F.coalesce(F.col("_top") / 4.0, F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
