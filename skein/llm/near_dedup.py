"""MinHash near-duplicate detection with b-bit signatures.

Texts with equal shingle sets become one class. Classes that share a band of MinHash minima are candidates; within
a bucket each class is compared with the bucket's most central class; what that leaves apart is compared throughout
in small buckets, and in large ones dealt anew by differences from the consensus. b-bit signatures (4 low bits a
minimum, 16 lanes a long) give a collision-corrected estimate by bit counts; what may pass is confirmed on full sets.
Where many pairs meet, parity bitmaps of the sets bound their difference from below, so that pairs which can't be
linked aren't made into rows (Sandes et al. 2020).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import sliced, stored
from skein.llm.wordhash import mixed, word_hashes

SHINGLE, ROWS, BANDS, BITS, LANES = 5, 6, 28, 4, 16
MINIMA = ROWS * BANDS
LONGS = -(-MINIMA // LANES)
_rng = np.random.Generator(np.random.PCG64(77))
FLIP = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
TIMES = _rng.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ROW_TIMES = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALT = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
PLACE = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(SHINGLE)], np.uint64)
#: Pairs whose estimate is below threshold - SLACK are let go: more than 6 deviations of an estimate over 168 minima.
SLACK = 0.17
#: Buckets up to this many classes are compared throughout by bitmaps if their components differ: at most so many
#: comparisons a row, whatever the size of a group. Larger ones are dealt anew, which finds the same links.
SMALL = 512
#: Parts that the members of a crowded bucket are dealt into where they meet what there is one of a bucket.
PARTS = 64
#: Longs of the parity bitmap of a set: bit h(e) is flipped by each element e.
PARITY = 16
#: Up to this many ids are broadcast (8 bytes each), more are joined by a shuffle.
FEW_IDS = 200_000


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the 5-word shingles of each text, A-Z lower-cased; of 1 to 4 words, one hash."""
    for words in word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]):
        n = len(words)
        if n >= SHINGLE:
            s = words[: n - SHINGLE + 1] * PLACE[0]
            for k in range(1, SHINGLE):
                s = s + words[k : n - SHINGLE + 1 + k] * PLACE[k]
            yield np.unique(mixed(s))
        elif n:
            yield mixed(np.array([np.sum(words * PLACE[:n]) + np.uint64(n)], np.uint64))
        else:
            yield words


def minima(shingles: np.ndarray) -> np.ndarray:
    """The MINIMA minima of a set, in blocks that stay in cache."""
    out, low = np.full(MINIMA, 0xFFFFFFFF, np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 512):
        np.minimum(out, ((low[i : i + 512, None] ^ FLIP) * TIMES).min(axis=0), out=out)
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """b low bits of each (scrambled) minimum, LANES of them in a long; spare lanes are 0 in all signatures."""
    lanes = np.zeros(LONGS * LANES, np.uint64)
    lanes[:MINIMA] = (m ^ (m >> np.uint32(15))) & np.uint32((1 << BITS) - 1)
    shifts = np.arange(LANES, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(lanes.reshape(LONGS, LANES) << shifts, axis=1).view(np.int64)


def parity(shingles: np.ndarray) -> np.ndarray:
    """PARITY longs: bits flipped by each element, at ten bits of its hash."""
    odd = np.bincount((shingles & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


SIGNATURE = "doc_id long, n_shingles long, cls binary, bands array<long>, sig array<long>, bits array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        n, cls, bands, sigs, bits = [], [], [], [], []
        for s in shingle_sets(batch.column(1).to_pylist()):
            n.append(len(s))
            cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            if len(s):
                m = minima(s)
                keys = mixed((mixed(m.reshape(BANDS, ROWS).astype(np.uint64)) * ROW_TIMES).sum(axis=1, dtype=np.uint64) + SALT)
                bands.append(keys.view(np.int64))
                sigs.append(packed(m))
                bits.append(parity(s))
            else:
                bands.append(None)
                sigs.append(None)
                bits.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *[pa.array(x, pa.list_(pa.int64())) for x in (sigs, bits)]], names=["doc_id", "n_shingles", "cls", "bands", "sig", "bits"])


def linked(i: int, a: int, b: int, percent: int = 85) -> bool:
    return 100 * i >= percent * (a + b - i)


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep, last, last_text = [], None, None
            for x, sy in zip(a, shingle_sets(b), strict=True):
                if x != last_text:
                    last_text, last = x, next(shingle_sets([x]))
                keep.append(linked(len(np.intersect1d(last, sy, assume_unique=True)), len(last), len(sy), percent) if len(last) and len(sy) else False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def estimate(x: str = "sig_a", y: str = "sig_b"):
    """Collision-corrected similarity from two packed signatures: (share of equal lanes - 2^-b) / (1 - 2^-b)."""
    differ = f"aggregate(zip_with({x}, {y}, (p, q) -> p ^ q), 0, (n, v) -> n + bit_count((v | shiftrightunsigned(v, 1) | shiftrightunsigned(v, 2) | shiftrightunsigned(v, 3)) & 1229782938247303441L))"
    return F.expr(f"((1 - ({differ}) / {MINIMA}D) - {1 / (1 << BITS)}D) / {1 - 1 / (1 << BITS)}D")


def may_link(percent: int, x: str = "_a", y: str = "_b"):
    """Whether sets may be linked, by sizes and parity bitmaps: bits that differ are no more than elements that only one
    of the sets has, so no link is lost."""
    apart = "(" + " + ".join(f"bit_count(bits{x}[{i}] ^ bits{y}[{i}])" for i in range(PARITY)) + ")"
    return F.expr(f"100 * (size{x} + size{y} - {apart}) >= {percent} * (size{x} + size{y} + {apart})")


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """edges(a, b) -> (node, root): the least node that each node reaches, for nodes of edges.

    Large-star and small-star rounds (Kiveris et al. 2014); each halves the depth or better. Neighbours are only
    reduced to their minimum, never gathered. Every round is written to the shared folder. rows: edges at most.
    """
    e = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", rows)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges", rows)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, rows: int) -> DataFrame:
    """The pairs(a, b) of class numbers, rows at most, that are links: first by estimate, then on the full sets."""
    sig = reps.select("node", "sig")
    near = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").where(estimate() >= F.lit(percent / 100 - SLACK))
    near = stored(near.select("a", "b"), "pairs", rows)
    full = near.join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_b").join(texts.toDF("a", "text_a"), "a")
    return stored(full.select("a", "b", "text_a", "text_b").mapInArrow(_confirmer(percent), "a long, b long").distinct(), "links", rows)


def _merged(comps: DataFrame | None, links: DataFrame, rows: int) -> DataFrame:
    """comps(node, root) after further links(a, b): components of the roots that links touch, put in for them."""
    if comps is None:
        return stored(connected_components(links, rows), "comps", rows)
    side = lambda df, c: df.join(comps.toDF(c, "_r"), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
    over = connected_components(side(side(links, "a"), "b"), rows).toDF("_n", "_to")
    old = comps.join(over, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_to", "root").alias("root"))
    new = over.join(comps, F.col("_n") == F.col("node"), "left_anti").select(F.col("_n").alias("node"), F.col("_to").alias("root"))
    return stored(old.unionByName(new), "comps", rows)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """center, node, text_c, text_n -> size of node's set and what only one of the two sets has."""
    for batch in sliced(batches):
        sizes, elements, last, mine = [], [], None, None
        for c, text_c, sn in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(3).to_pylist()), strict=True):
            if c != last or mine is None:
                last, mine = c, next(shingle_sets([text_c]))
            sizes.append(len(sn))
            elements.append(np.setxor1d(sn, mine, assume_unique=True).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(elements, pa.list_(pa.int64()))], names=["center", "node", "size", "elements"])


def _by_bucket(rows: DataFrame, one: DataFrame, how: str = "inner") -> DataFrame:
    """rows(bucket, node, ...) joined with one row a bucket, which goes to PARTS parts, so that no bucket is in one task."""
    parts = one.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("_part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int")).join(parts, ["bucket", "_part"], how).drop("_part")


def _finer(crowded: DataFrame, whole: DataFrame, marks: DataFrame, percent: int, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """crowded(bucket, center, node, root) -> links(a, b) of different roots, and (bucket, center, node) still to do.

    Sets are held as what they have different from their bucket's consensus (what most of it has; found as differences
    from center first). Let a set's excess be (100 + percent) * its differences - (100 - percent) * its size. Two sets
    whose excesses add up to 0 or less are linked, even if they share no difference. The main set, that of least excess,
    is compared with all, so it's linked with both of any such two; a set is apart if it's neither linked with that nor
    in its component. Of two sets of different components one is apart. If they are linked, they share more than
    (the other one's excess - the main set's) / (200 + 2 * percent) differences, one at least, and more than
    percent * a / (100 + percent) of the other one's a if the one apart is far, i.e. beyond the threshold from the
    consensus, too. So a prefix of a, the rest of a and one more, holds a shared one. Rare elements make the prefix, so
    what many have in common hardly meets. Elements that more than SMALL prefixes and sets apart have are buckets anew,
    smaller as all in them agree on one element more.
    """
    pairs = crowded.select("center", "node").distinct()
    full = pairs.join(whole.toDF("node", "text_n"), "node").join(whole.toDF("center", "text_c"), "center")
    parts = full.select("center", "node", "text_c", "text_n").mapInArrow(_differences, "center long, node long, size long, elements array<long>")
    held = crowded.join(parts.dropDuplicates(["center", "node"]), ["center", "node"])
    most = held.select("bucket", F.explode("elements").alias("e")).groupBy("bucket", "e").count().where("count > 1")
    most = most.join(held.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
    flips = most.where("2 * count > n").groupBy("bucket").agg(F.collect_list("e").alias("flip"))
    flip = F.coalesce("flip", F.array().cast("array<long>"))
    held = _by_bucket(held, flips, "left").select("bucket", "node", "root", "size", F.concat(F.array_except("elements", flip), F.array_except(flip, "elements")).alias("elements"))
    held = stored(held, "parts", rows, 20_000)

    def linked_sets(x: str, y: str):
        apart = F.size(f"elements_{x}") + F.size(f"elements_{y}") - 2 * F.size(F.array_intersect(f"elements_{x}", f"elements_{y}"))
        both = F.col(f"size_{x}") + F.col(f"size_{y}")
        return 100 * (both - apart) >= percent * (both + apart)

    excess = lambda x: f"{100 + percent} * size(elements{x}) - {100 - percent} * size{x}"
    mains = held.groupBy("bucket").agg(F.min_by(F.struct("node", "root", "size", "elements"), F.struct(F.expr(excess("")), "node")).alias("m"))
    mains = mains.select("bucket", F.col("m.node").alias("main"), F.col("m.root").alias("root_m"), F.col("m.size").alias("size_m"), F.col("m.elements").alias("elements_m"))
    seen = _by_bucket(held.withColumnsRenamed({"size": "size_n", "elements": "elements_n"}), mains)
    seen = seen.withColumn("near", linked_sets("n", "m")).withColumn("apart", (F.col("root") != F.col("root_m")) & ~F.col("near"))
    far = F.expr(f"{100 + percent} * size(elements_n) > {100 - percent} * (size_n + size_m + size(elements_m))")
    ahead = F.expr(f"size(elements_n) - (size(elements_n) * {percent} div {100 + percent})")
    wide = F.expr(f"size(elements_n) - (({excess('_n')} - ({excess('_m')})) div {200 + 2 * percent})")
    seen = seen.withColumns({"far": F.col("apart") & far, "odd": F.col("apart") & ~far, "prefix": ahead, "longer": wide, "width": F.size("elements_n")})
    seen = stored(seen.select("bucket", "node", "root", "near", "far", "odd", "prefix", "longer", "width", "main", "root_m"), "seen", rows)
    links = seen.where("near and root != root_m").select(F.col("node").alias("a"), F.col("main").alias("b"))
    each = seen.join(held.select("bucket", "node", F.explode("elements").alias("e")), ["bucket", "node"])
    # What a set shares with one of another component, of which one is apart. All other elements come first in order,
    # so they needn't be ranked one by one.
    often = each.groupBy("bucket", "e").agg(F.count("*").alias("often"), F.count_if("far").alias("n_far"), F.count_if("odd").alias("n_odd"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    often = often.where("often > 1 and n_far + n_odd > 0 and r0 != r1").drop("r0", "r1")
    own = Window.partitionBy("bucket", "node")
    place = F.row_number().over(own.orderBy("often", "e")) + F.col("width") - F.count("*").over(own)
    ranked = each.join(often, ["bucket", "e"]).withColumn("_n", place)
    ranked = ranked.withColumn("ahead", (F.col("_n") <= F.col("prefix")) & (F.col("n_far") > 0)).withColumn("wide", (F.col("_n") <= F.col("longer")) & (F.col("n_odd") > 0))
    ranked = ranked.where("ahead or wide or far or odd").select("bucket", "e", "node", "root", "ahead", "wide", "far", "odd")
    counts = [F.count_if(c).alias(f"n_{c}") for c in ("ahead", "wide", "far", "odd")]
    both = ranked.groupBy("bucket", "e").agg(*counts, F.min("root").alias("r0"), F.max("root").alias("r1"), F.bit_xor(F.xxhash64("node", "ahead", "wide")).alias("who"))
    both = both.withColumn("most", F.greatest(F.least("n_ahead", "n_far"), F.least("n_wide", "n_odd"))).where("most > 0 and r0 != r1")
    # One edit makes several elements that the same sets have: one of them stands for all.
    both = both.groupBy("bucket", "who", "n_ahead", "n_wide", "n_far", "n_odd", "most").agg(F.min("e").alias("e")).select("bucket", "e", "most")
    ranked = stored(ranked.join(both, ["bucket", "e"]), "finer", rows and 32 * rows)
    small = ranked.where(F.col("most") <= SMALL).join(marks, "node")
    renamed = lambda df, c: df.withColumnsRenamed({n: f"{n}_{c}" for n in df.columns if n not in ("bucket", "e", "most")}).withColumnRenamed(f"node_{c}", c)
    x, y = renamed(small.where("ahead or wide"), "a"), renamed(small.where("far or odd"), "b")
    # Prefixes of two far sets must meet; one of a set that isn't far may meet any element of a far one.
    meets = F.expr("root_a != root_b and ((far_b and ahead_a and (ahead_b or not far_a)) or (odd_b and wide_a))") & may_link(percent)
    met = x.join(y.drop("most"), ["bucket", "e"]).where(meets).select("bucket", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c: held.select("bucket", F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("elements").alias(f"elements_{c}"))
    found = met.join(side("a"), ["bucket", "a"]).join(side("b"), ["bucket", "b"]).where(linked_sets("a", "b"))
    again = ranked.where(F.col("most") > SMALL).select(F.xxhash64("bucket", "e").alias("bucket"), "node").distinct()
    again = again.join(again.groupBy("bucket").agg(F.min("node").alias("center")), "bucket")
    return stored(links.unionByName(found.select("a", "b")).distinct(), "links", rows), stored(again, "again", rows and 32 * rows)


def _components(rows: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, classes: int) -> DataFrame | None:
    """(node, root) for nodes with links among those that share a bucket of rows(bucket, node); classes: nodes."""
    root = F.coalesce("root", "node").alias("root")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    marks = reps.select("node", F.col("n_shingles").alias("size"), "bits")
    multi = stored(rows.join(sizes, "bucket"), "buckets", BANDS * classes)
    many = multi.count()
    multi = stored(multi.join(multi.groupBy("node").agg(F.sum("n").alias("score")), "node"), "scored", many)
    nodes = multi.select(F.col("node").alias("doc_id")).distinct()
    # Texts that will be compared are picked out once, so whole texts are shuffled once at most.
    whole = stored(texts.join(F.broadcast(nodes) if nodes.count() <= FEW_IDS else nodes, "doc_id", "left_semi"), "texts")
    leaders = multi.groupBy("bucket").agg(F.max(F.struct(F.col("score"), (-F.col("node")).alias("minus"))).alias("c")).select("bucket", (-F.col("c.minus")).alias("center"))
    star = multi.join(leaders, "bucket").where("node != center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    links = _confirmed(star, reps, whole, percent, many)
    comps = _merged(None, links, many)
    rooted = multi.join(comps, "node", "left").select("bucket", "node", "n", root)
    apart = rooted.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("bucket")
    left = stored(rooted.join(apart, "bucket").join(leaders, "bucket"), "left", many)
    few = left.where(F.col("n") <= SMALL)
    few = few.join(marks, "node").select("bucket", "node", "root", "size", "bits")
    one = lambda c: few.toDF("bucket", c, f"root_{c}", f"size_{c}", f"bits_{c}")
    tried = one("a").join(one("b"), "bucket").where(F.expr("a < b and root_a != root_b") & may_link(percent)).select("a", "b").distinct()
    links = _confirmed(tried, reps, whole, percent, many)
    if not links.isEmpty():
        comps = _merged(comps, links, many)
    # Buckets that share classes are dealt anew together, so that a pair isn't met again in each.
    crowded = left.where(F.col("n") > SMALL).select("center", "node").distinct()
    for _ in range(2):
        joint = crowded.join(crowded.groupBy("node").agg(F.min("center").alias("to")), "node").groupBy("center").agg(F.min("to").alias("to"))
        crowded = stored(crowded.join(joint, "center").select(F.col("to").alias("center"), "node").distinct(), "crowded", many)
    crowded = crowded.select(F.col("center").alias("bucket"), "center", "node")
    while (rest := crowded.count()) > 0:
        links, crowded = _finer(crowded.join(comps, "node", "left").select("bucket", "center", "node", root), whole, marks, percent, rest)
        if not links.isEmpty():
            comps = _merged(comps, links, many)
    return comps


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (least doc_id reachable over links), kept.

    Linked: 100 * intersection >= percent * union of the sets of 5-word shingles. Empty and null texts are linked
    with nothing. A row without doc_id is linked through an equal set only; its component_id is the least doc_id of
    that, else null, and it's kept then. Rows that share a doc_id and a text are kept alike.

    Ties don't matter, an empty table gives none, other columns aren't looked at. Work follows the number of rows: copies
    fold into classes first; a bucket gives each class one partner, the class that meets most others in its buckets.
    Buckets up to SMALL whose classes are still of several components are compared throughout, at most SMALL partners a
    class; larger ones are dealt into finer ones by what their classes have different from most, again and again until
    none is left. Either way finds all links of a bucket: SMALL decides on the work alone, see _finer.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_signatures, SIGNATURE), "signed")
    classes = signed.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
    count = signed.count()
    reps = stored(classes, "classes", count, 50_000)
    rows = reps.where("node is not null").select("node", F.explode("bands").alias("bucket"))
    comps = _components(rows, reps, texts.where("doc_id is not null"), percent, count)
    named = reps.select("cls", "node").join(comps, "node", "left").select("cls", F.coalesce("root", "node").alias("root"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cls")).alias("cls")).join(named, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def first_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of docs, all columns, of which one of each group of linked documents stays: that of the least id.

    Rows with one id count as one document; of rows without id, one of each equal text stays, unless
    a row with an id has that text.
    """
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent).where("kept").select("doc_id").distinct()
    held = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    some = held.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    # Rows without id: one of each equal text, unless a row with an id has it.
    digest = F.sha2(F.coalesce(F.col("_text"), F.lit("")).cast("binary"), 256)
    loose = held.where("doc_id is null").withColumn("_h", digest)
    have = held.where("doc_id is not null and _text is not null").select(digest.alias("_h")).join(loose.select("_h").distinct(), "_h", "left_semi")
    loose = loose.join(have, "_h", "left_anti").dropDuplicates(["_h"])
    return some.select("_row.*").unionByName(loose.select("_row.*"))
