"""Similarity of URLs and the prediction of how a page is rendered."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import urls as U
from skein.operators.likeness import LIKE, alike_counts
from skein.sources.tables import stored

CLIENT, STATIC = "clientOnly", "static"


def jaro_winkler(a: str, b: str) -> float:
    """Equal texts are 1, also empty ones."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    m, t = len(hits), sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def similarity(a: list[str] | None, b: list[str] | None) -> float:
    """Share of path segments in the same place that are much alike (over 0.8); other hosts: 0. Lists as of url_components."""
    if a is None or b is None or a[0] != b[0]:
        return 0.0
    pairs = list(zip_longest(a[1:], b[1:], fillvalue=""))
    return sum(jaro_winkler(x, y) > LIKE for x, y in pairs) / len(pairs) if pairs else 1.0


def url_similarity(a: Column | str, b: Column | str) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(None if p is None else list(p), None if q is None else list(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(U.url_components(a), U.url_components(b))


#: Texts of a task's share of a comparison: those asked about, and those known.
BLOCK = (8192, 32768)
_COUNTS = "array<struct<kind: string, length: int, n: bigint>>"


def _key(label: object, host: Column) -> Column:
    return F.to_json(F.struct(label, host.alias("host")))


def _segments(pages: DataFrame, *more: str) -> DataFrame:
    return pages.select("key", *more, F.posexplode("own").alias("place", "segment"))


@dataclass
class RenderingModel:
    """Counts of the segments of all known pages, and weights of a logistic regression on the mean likeness to both kinds.

    Likeness goes by host and by segments in the same place, so counts by place give the means over all pages. The counts
    are tables; key: label and host.
    """

    pages: dict = field(default_factory=dict)  # label -> {kind: pages}
    known: DataFrame | None = None  # key, place, segment, counts: pages by kind and number of segments
    alike: DataFrame | None = None  # the same over all known segments much alike, for each known segment and the empty one
    shapes: DataFrame | None = None  # key, shapes: kind, length, n pages, blank: by place, those much like an empty segment
    weights: tuple[float, float, float] | None = None
    seen: dict = field(default_factory=dict, repr=False)

    def _host(self, label: str | None, host: str | None) -> tuple[dict, dict]:
        """({(kind, segments): pages}, {place: {segment: {(kind, segments): pages}}}) of one label and host, as read once."""
        if (label, host) not in self.seen:
            own = F.col("key") == _key(*[(F.lit(None).cast("string") if v is None else F.lit(v)).alias(k) for k, v in (("label", label), ("host", host))])
            lengths = {(s["kind"], s["length"]): s["n"] for r in self.shapes.where(own).collect() for s in r["shapes"]}
            places: dict = {}
            for r in self.known.where(own).collect():
                places.setdefault(r["place"], {})[r["segment"]] = {(c["kind"], c["length"]): c["n"] for c in r["counts"]}
            self.seen[label, host] = lengths, places
        return self.seen[label, host]

    def features(self, label: str | None, parts: list[str]) -> tuple[float, float]:
        """Of a single page; features_of() is for many."""
        sums = {STATIC: 0.0, CLIENT: 0.0}
        own, pages = parts[1:], self.pages.get(label, {})
        lengths, places = self._host(label, parts[0]) if parts and pages else ({}, {})
        for (kind, length), n in sorted(lengths.items(), key=lambda x: str(x[0][1])):
            longest, hits = max(len(own), length), 0
            for k in range(longest):
                segment = own[k] if k < len(own) else ""
                hits += sum(c.get((kind, length), 0) for other, c in places.get(k, {}).items() if jaro_winkler(segment, other) > LIKE) if k < length else n * (segment == "")
            sums[kind] += hits / longest if longest else n
        return tuple(sums[k] / pages[k] if k in pages else 0.0 for k in (STATIC, CLIENT))

    def _verdict(self, known: bool, x: float, y: float) -> tuple[str, float]:
        if self.weights is None or not known:
            return CLIENT, 1.0
        p = 1 / (1 + math.exp(-(self.weights[0] + self.weights[1] * x + self.weights[2] * y)))
        return (STATIC if p > 0.5 else CLIENT), 1.0 if abs(x - y) < 0.1 else 0.1

    def predict(self, label: str | None, parts: list[str]) -> tuple[str, float]:
        """Kind, and how probable a new detection should be made: 1 without knowledge of the label."""
        known = label in self.pages
        return self._verdict(known, *(self.features(label, parts) if known else (0.0, 0.0)))


def _counts(rows: list[Column]) -> Column:
    return F.sort_array(F.collect_list(F.struct(*rows))).cast(_COUNTS).alias("counts")


def alike_segments(asked: DataFrame, known: DataFrame, block: tuple[int, int] = BLOCK) -> DataFrame:
    """asked(key, place, segment), distinct -> with counts of the known segments of the same key and place that are much
    alike, summed by kind and length; without a row if there are none.

    A key and place with many segments is compared in blocks, each a group of its own: a task holds one at a time."""
    at = ["key", "place"]
    sizes = known.groupBy(*at).agg(F.ceil(F.count("*") / block[1]).cast("int").alias("nb"))
    sizes = sizes.join(asked.groupBy(*at).agg(F.ceil(F.count("*") / block[0]).cast("int").alias("na")), at)
    hashed = lambda n: F.pmod(F.xxhash64("segment"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, at).select(*at, "segment", hashed("na").alias("a"), every("nb").alias("b"))
    right = known.join(sizes, at).select(*at, "segment", "counts", every("na").alias("a"), hashed("nb").alias("b"))
    right = right.toDF(*[f"known_{c}" for c in right.columns])
    spark, keys = asked.sparkSession, [*at, "a", "b"]
    known_keys = [f"known_{k}" for k in keys]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        segments, lists = x.column("segment").combine_chunks(), y.column("known_counts").combine_chunks()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())) if len(lists) else np.zeros(0, int)
        flat = lists.flatten()
        kinds, lengths, pages = (flat.field(f) for f in ("kind", "length", "n"))
        names = list(zip(kinds.to_pylist(), lengths.to_pylist(), strict=True))
        classes = {c: k for k, c in enumerate(sorted(set(names)))}
        counts = np.zeros((len(lists), len(classes)), np.int64)
        if len(segments):
            np.add.at(counts, (row, [classes[c] for c in names]), pages.to_numpy())
        found = alike_counts(segments.to_pylist(), y.column("known_segment").to_pylist(), counts) if len(segments) and len(lists) else np.zeros((len(segments), len(classes)), np.int64)
        i, k = np.nonzero(found)
        order = list(classes)
        first = lambda c: pa.array([x.column(c)[0].as_py() if len(x) else None] * len(i), x.schema.field(c).type)
        return pa.table({"key": first("key"), "place": first("place"), "segment": segments.take(pa.array(i)), "kind": pa.array([order[c][0] for c in k], pa.string()), "length": pa.array([order[c][1] for c in k], pa.int32()), "n": pa.array(found[i, k], pa.int64())})

    schema = "key string, place int, segment string, kind string, length int, n bigint"
    found = left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *known_keys).groupBy(*known_keys)).applyInArrow(compare, schema)
    summed = found.groupBy(*at, "segment", "kind", "length").agg(F.sum("n").alias("n"))
    return summed.groupBy(*at, "segment").agg(_counts(["kind", "length", "n"]))


def features_of(pages: DataFrame, model: RenderingModel) -> DataFrame:
    """pages(key, own, label), distinct -> with x, y: the mean likeness to the known static and client-only pages."""
    segments = _segments(pages).distinct()
    new = segments.join(model.known.select("key", "place", "segment"), ["key", "place", "segment"], "left_anti").where("segment != ''")
    alike = model.alike.unionByName(alike_segments(new, model.known))
    found = _segments(pages, "own", "label").join(alike, ["key", "place", "segment"], "left").groupBy("key", "own", "label").agg(F.flatten(F.collect_list("counts")).alias("found"))
    own = F.size("own")

    def part(s: Column) -> Column:
        """What the known pages of one kind and length give to the sum."""
        none, add = F.lit(0).cast("long"), lambda a, v: a + v
        alike_ = F.aggregate(F.filter("found", lambda c: (c["kind"] == s["kind"]) & (c["length"] == s["length"])), none, lambda a, c: a + c["n"])
        # Places past the page's own end are empty there, places past the known pages' end are empty with them.
        ended = F.aggregate(F.slice(s["blank"], own + 1, F.greatest(s["length"] - own, F.lit(0))), none, add)
        both = s["n"] * F.size(F.filter("own", lambda v, i: (i >= s["length"]) & (v == "")))
        longest = F.greatest(own, s["length"])
        return F.when(longest > 0, (alike_ + ended + both) / longest).otherwise(s["n"].cast("double"))

    def mean(kind: str) -> Column:
        total = F.aggregate(F.filter("shapes", lambda s: s["kind"] == kind), F.lit(0.0), lambda a, s: a + part(s))
        of = {label: kinds[kind] for label, kinds in model.pages.items() if kind in kinds}
        known = F.coalesce(*[F.when(F.col("label").eqNullSafe(F.lit(label)), F.lit(n)) for label, n in of.items()], F.lit(None)) if of else F.lit(None)
        return F.coalesce(total / known, F.lit(0.0))

    return found.join(model.shapes, "key", "left").select("key", "own", "label", mean(STATIC).alias("x"), mean(CLIENT).alias("y"))


def _pages(df: DataFrame, *more: str) -> DataFrame:
    """df with key (null where there's no URL) and own, its segments."""
    df = df.withColumn("_p", U.url_components("url"))
    return df.select(*more, "label", F.when(F.col("_p").isNotNull(), _key("label", F.get("_p", F.lit(0)))).alias("key"), F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0))).alias("own"))


def train_predictor(results: DataFrame, block: tuple[int, int] = BLOCK) -> RenderingModel:
    """results(url, label, rendering_type), all of them. Counts and comparisons are tables, of which the driver holds none but
    pages by label (the number of labels is that of a crawl's handlers) and, as numbers, the distinct features."""
    parts = _pages(results, F.col("rendering_type").alias("kind")).where(F.col("key").isNotNull() & F.col("kind").isin(STATIC, CLIENT))
    grouped = stored(parts.groupBy("label", "key", "own", "kind").agg(F.count("*").alias("n")))
    model = RenderingModel()
    for label, kind, n in sorted(grouped.groupBy("label", "kind").agg(F.sum("n")).collect(), key=repr):
        model.pages.setdefault(label, {})[kind] = n
    length = F.size("own").alias("length")
    placed = _segments(grouped.select("key", "own", "kind", length, "n"), "kind", "length", "n").groupBy("key", "place", "segment", "kind", "length").agg(F.sum("n").alias("n"))
    model.known = stored(placed.groupBy("key", "place", "segment").agg(_counts(["kind", "length", "n"])))
    empty = model.known.select("key", "place", F.lit("").alias("segment"))
    model.alike = stored(alike_segments(model.known.select("key", "place", "segment").union(empty).distinct(), model.known, block))
    blank = model.alike.where("segment = ''").select("key", "place", F.explode("counts").alias("c")).select("key", "place", "c.kind", "c.length", F.col("c.n").alias("hits"))
    shapes = grouped.groupBy("key", "kind", length).agg(F.sum("n").alias("n"))
    spread = shapes.select("*", F.explode_outer(F.when(F.col("length") > 0, F.sequence(F.lit(0), F.col("length") - 1))).alias("place"))
    blanks = spread.join(blank, ["key", "kind", "length", "place"], "left").groupBy("key", "kind", "length", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("hits", F.lit(0)).alias("h")))), lambda v: v["h"]).alias("blank"))
    # In the order of the lengths' digits, so that sums come out the same each time.
    model.shapes = stored(blanks.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("length").cast("string").alias("o"), "kind", "length", "n", "blank"))), lambda s: s.dropFields("o")).alias("shapes")))
    if model.pages:
        known = features_of(grouped.select("key", "own", "label").distinct(), model)
        rows = grouped.join(known.drop("label"), ["key", "own"]).groupBy("x", "y", (F.col("kind") == STATIC).cast("double").alias("t")).agg(F.sum("n").cast("double").alias("n")).toArrow()
        x, y, t, n = (rows.column(c).to_numpy() for c in ("x", "y", "t", "n"))
        order = np.lexsort((t, y, x))
        x, y, t, n = x[order], y[order], t[order], n[order]
        w = np.zeros(3)
        for _ in range(300):
            e = n * (1 / (1 + np.exp(-(w[0] + w[1] * x + w[2] * y))) - t)
            w = w - 2.0 * np.array([e.sum(), (e * x).sum(), (e * y).sum()]) / n.sum()
        model.weights = tuple(w.tolist())
    return model


def predict(requests: DataFrame, model: RenderingModel) -> DataFrame:
    """requests(url, label) with rendering_type and detection_probability."""
    labels, verdict = set(model.pages), RenderingModel(weights=model.weights)._verdict

    @F.pandas_udf("struct<rendering_type: string, detection_probability: double>")
    def run(label: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([verdict(k in labels, a, b) for k, a, b in zip(label, x, y, strict=True)], columns=["rendering_type", "detection_probability"])

    if model.known is None:
        return requests.withColumn("_r", run("label", F.lit(0.0), F.lit(0.0))).select(*requests.columns, "_r.*")
    keyed = _pages(requests, *[F.col(c).alias(f"_{c}") for c in requests.columns])
    asked = features_of(keyed.where("key is not null").select("key", "own", "label").distinct(), model).drop("label")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = keyed.join(asked, ["key", "own"], "left").withColumn("_r", run("label", zero("x"), zero("y")))
    return out.select(*[F.col(f"_{c}").alias(c) for c in requests.columns], "_r.*")


def adaptive_plan(predicted: Column, http_ok: Column, checked: Column, equal: Column | None = None) -> Column:
    """What an adaptive crawl does with a page: static ones by HTTP if that succeeds and the check holds, else by browser."""
    fallback = F.when(~http_ok, F.lit("browser after http error")).when(~checked, F.lit("browser after check"))
    plan = F.when(predicted == STATIC, F.coalesce(fallback, F.lit("http"))).otherwise(F.lit("browser"))
    return F.when(equal.isNotNull(), F.concat(plan, F.when(equal, F.lit(", static")).otherwise(F.lit(", client only")))).otherwise(plan) if equal is not None else plan
