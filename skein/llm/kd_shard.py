"""K-d tree sharding: weighted medians along the widest metadata dimension (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import running_position, stored

#: A coordinate is a value scaled to HIGH bits with LOW bits of a hash of the row below it, so that ties can be split.
HIGH, LOW, BINS = 30, 31, 1 << 15


@dataclass
class Node:
    """leaves: shards below. lo, hi: the coordinates searched for the cut, before: weight of the node under lo."""

    leaves: int
    shard: int
    path: list = field(default_factory=list)  # (dimension, cut, side) from the root
    dim: int | None = None
    cut: int | None = None
    lo: int = 0
    hi: int = 1 << (HIGH + LOW)
    before: float = 0.0
    total: float = 0.0
    kids: tuple = ()


def _inside(node: Node, dims: list[str]) -> Column:
    tests = [(F.col(dims[d]) < cut) if left else (F.col(dims[d]) >= cut) for d, cut, left in node.path]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _label(nodes: list[Node], dims: list[str]) -> Column:
    """The number of the node of a row: nested tests, as deep as the tree."""
    def walk(paths: list[tuple[int, list]], depth: int) -> Column:
        if len(paths) == 1 and len(paths[0][1]) <= depth:
            return F.lit(paths[0][0])
        left = [p for p in paths if p[1][depth][2]]
        right = [p for p in paths if not p[1][depth][2]]
        d, cut, _ = paths[0][1][depth]
        if not left or not right:
            test = (F.col(dims[d]) < cut) if left else (F.col(dims[d]) >= cut)
            return F.when(test, walk(left or right, depth + 1))
        return F.when(F.col(dims[d]) < cut, walk(left, depth + 1)).otherwise(walk(right, depth + 1))

    return walk([(i, n.path) for i, n in enumerate(nodes)], 0)


def build_tree(rows: DataFrame, dims: list[str], shards: int, weight: str = "size", tolerance: float = 0.0005) -> list[Node]:
    """The leaves of the tree over rows(weight, *dims), dims being coordinates from 0 to 2^61.

    A node with k leaves is cut where its weight divides as k//2 to the rest, along the dimension whose values
    spread widest in it. Cuts come from histograms, refined around the cut until what can't be told apart weighs
    under tolerance of a leaf, or one coordinate is left. All nodes of a level share each pass and BINS bins, so the
    driver sees at most BINS sums (and a few for each node) whatever the number of rows.
    """
    root = Node(shards, 0)
    level, leaves = [root], []
    while level:
        leaves += [n for n in level if n.leaves == 1]
        level = [n for n in level if n.leaves > 1]
        if not level:
            break
        named = rows.withColumn("_node", _label(level, dims)).where("_node is not null")
        spread = named.groupBy("_node").agg(F.sum(weight).alias("w"), *[(F.max(F.shiftright(d, LOW)) - F.min(F.shiftright(d, LOW))).alias(f"_s{i}") for i, d in enumerate(dims)], *[F.min(d).alias(f"_l{i}") for i, d in enumerate(dims)], *[F.max(d).alias(f"_h{i}") for i, d in enumerate(dims)])
        found = {r["_node"]: r for r in spread.collect()}  # one row a node of the level: at most shards rows
        for i, n in enumerate(level):
            r = found.get(i)
            n.dim = 0 if r is None else max(range(len(dims)), key=lambda d: (r[f"_s{d}"], -d))
            n.total = 0.0 if r is None else float(r["w"])
            n.lo, n.hi = (0, 1) if r is None else (r[f"_l{n.dim}"], r[f"_h{n.dim}"] + 1)
        todo = list(range(len(level)))
        while todo:
            bins = max(64, BINS // len(todo))
            at, lo, step = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long")
            for i in todo:
                n, own = level[i], F.col("_node") == i
                at, lo, step = F.when(own, F.col(dims[n.dim])).otherwise(at), F.when(own, F.lit(n.lo)).otherwise(lo), F.when(own, F.lit(max(1, -(-(n.hi - n.lo) // bins)))).otherwise(step)
            binned = named.where(F.col("_node").isin(todo)).select("_node", weight, at.alias("_at"), lo.alias("_lo"), step.alias("_step"))
            bounds = reduce(lambda a, b: a | b, [(F.col("_node") == i) & (F.col("_at") >= level[i].lo) & (F.col("_at") < level[i].hi) for i in todo])
            sums = binned.where(bounds).groupBy("_node", F.expr("(_at - _lo) div _step").alias("_bin")).agg(F.sum(weight).alias("w"), F.min("_at").alias("lo"), F.max("_at").alias("hi")).collect()
            again = []
            for i in todo:
                n = level[i]
                want, acc = n.total * (n.leaves // 2) / n.leaves, n.before
                n.cut = n.hi
                for low, high, w in sorted((r["lo"], r["hi"], float(r["w"])) for r in sums if r["_node"] == i):
                    if acc + w < want:
                        acc += w
                        continue
                    if low < high and w > tolerance * n.total / n.leaves:
                        n.lo, n.hi, n.before = low, high + 1, acc
                        again.append(i)
                    else:
                        n.cut = high + 1 if acc + w - want < want - acc else low
                    break
            todo = again
        below = []
        for n in level:
            k = n.leaves // 2
            n.kids = (Node(k, n.shard, [*n.path, (n.dim, n.cut, True)]), Node(n.leaves - k, n.shard + k, [*n.path, (n.dim, n.cut, False)]))
            below += n.kids
        level = below
    return sorted(leaves, key=lambda n: n.shard)


def coordinates(rows: DataFrame, dims: dict[str, Column], row_hash: Column) -> DataFrame:
    """Adds a coordinate for each of dims: the value scaled between the table's least and largest, null as least."""
    ends = rows.select(*[f(c.cast("double")).alias(f"{k}{n}") for n, c in dims.items() for k, f in (("l", F.min), ("h", F.max))]).first()
    low = F.shiftright(row_hash, 64 - LOW).bitwiseAND((1 << LOW) - 1)
    out = {}
    for n, c in dims.items():
        lo, hi = ends[f"l{n}"] or 0.0, ends[f"h{n}"] or 0.0
        scaled = F.floor((F.coalesce(c.cast("double"), F.lit(lo)) - F.lit(lo)) / F.lit((hi - lo) or 1.0) * F.lit((1 << HIGH) - 1)).cast("long")
        out[n] = F.shiftleft(scaled, LOW) + low
    return rows.withColumns(out)


def _copies_apart(rows: DataFrame) -> DataFrame:
    """rows(_h, _row) with _h made different for rows that share it: by 0, 1, ... within them.

    Which of equal rows gets which number follows the files, but the rows are equal. One may be a third of all, so
    numbers come from parts of the copies.
    """
    again = stored(rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"), "copies")
    if again.isEmpty():
        return rows.drop("_row")
    same = rows.join(again, "_h", "left_semi").withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(1024)).cast("int"))
    numbered = running_position(same, "_h", "_part", ["_row"]).withColumn("_h", F.when(F.col("place") > 0, F.xxhash64("_h", "place")).otherwise(F.col("_h")))
    return stored(rows.join(again, "_h", "left_anti").drop("_row").unionByName(numbered.drop("_part", "place", "_row")), "shard")


def shard_documents(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, size (UTF-8 bytes + 8), text_crc32, law, shard, slot, grown_shard (null).

    The law is bytes: the leaves' sizes come near equal, as near as single documents allow. Dimensions: length of
    the text in characters (its logarithm), source and language (as hashes that keep equal values together), doc_id.
    Null and empty texts weigh 8; null values sort first. Ties of a dimension are told apart by a hash of the row, and
    repeated rows by the number of the copy, so they divide like others. An empty table gives none; other columns aren't
    looked at. slot: 0, 1, ... within a shard, by hash bucket and doc_id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(1 << 20)) if c in docs.columns else F.lit(0)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.length(text).alias("_len"), named("source").alias("_src"), named("lang").alias("_lang"))
    rows = rows.withColumns({"_h": F.xxhash64(F.col("doc_id"), F.col("size"), F.col("text_crc32")), "_row": F.monotonically_increasing_id()})
    rows = _copies_apart(stored(rows, "shard"))
    dims = {"_d0": F.log1p(F.col("_len")), "_d1": F.col("_src"), "_d2": F.col("_lang"), "_d3": F.col("doc_id")}
    rows = coordinates(rows, dims, F.col("_h"))
    leaves = build_tree(rows, list(dims), shards)
    out = rows.withColumn("shard", F.element_at(F.array(*[F.lit(n.shard) for n in leaves]), (_label(leaves, list(dims)) + 1)).cast("int"))
    out = out.withColumn("_b", F.shiftrightunsigned(F.col("_h"), 54).cast("int")).select("doc_id", "size", "text_crc32", "shard", "_b", "_h")
    out = running_position(out, "shard", "_b", ["_h", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
