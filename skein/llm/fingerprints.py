"""Document fingerprints from prefix polynomial hashes.

prefix[i] = sum of (c_j + 1) * B^j for j < i, mod the prime 2^31 - 1. Differences of two prefixes, brought to one
power, answer whether any two spans are equal; a second base makes the answer 62 bits long. Longest common
extensions follow by binary search. A fingerprint is the text's hash and the least of the hashes of its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.wordhash import mixed

PRIME = np.uint64((1 << 31) - 1)
BASES = (1_103_515_245, 747_796_405)
WINDOW, KEPT = 12, 64
#: Powers that a worker keeps for each base, 8 bytes each; those of longer texts are made for the text.
KEPT_POWERS = 1 << 18
_POWERS: dict[int, np.ndarray] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod 2^31 - 1 for x under 2^62, by shifts."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n-1 (at least), doubled as texts ask for more; up to KEPT_POWERS of them are kept."""
    p = _POWERS.get(base, np.ones(1, np.uint64))
    while len(p) < n:
        p = np.concatenate([p, _mod(p * np.uint64(pow(base, len(p), int(PRIME))))])
        if len(p) <= KEPT_POWERS:
            _POWERS[base] = p
    return p


class Prefix:
    """Prefix hashes of a text, by code points."""

    def __init__(self, text: str | np.ndarray, bases: tuple[int, ...] = BASES) -> None:
        self.points = code_points(text) if isinstance(text, str) else text
        self.bases = bases
        self.sums = []
        for b in bases:
            terms = _mod((self.points.astype(np.uint64) + np.uint64(1)) * powers(b, len(self.points))[: len(self.points)])
            self.sums.append(_mod(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])))

    def __len__(self) -> int:
        return len(self.points)

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """The hashes of [start, end) with the power of start still in them."""
        return tuple((int(s[end]) - int(s[start])) % int(PRIME) for s in self.sums)

    def equal(self, start: int, other: Prefix, at: int, length: int) -> bool:
        """Whether length code points from start equal those of other from at."""
        if start + length > len(self) or at + length > len(other):
            return False
        up = max(start, at)
        mine, its = self.span(start, start + length), other.span(at, at + length)
        return all(x * pow(b, up - start, int(PRIME)) % int(PRIME) == y * pow(b, up - at, int(PRIME)) % int(PRIME) for x, y, b in zip(mine, its, self.bases, strict=True))

    def extension(self, start: int, other: Prefix, at: int) -> int:
        """Code points that the texts share from start and at on: binary search over equal()."""
        low, high = 0, min(len(self) - start, len(other) - at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(start, other, at, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def windows(self) -> np.ndarray:
        """Hashes of all windows of WINDOW code points (of a shorter text, of all of it), free of their place."""
        n = len(self) - WINDOW + 1
        if n < 1:
            return mixed(np.array([int(self.sums[0][-1])], np.uint64)) if len(self) else np.empty(0, np.uint64)
        s = self.sums[0]
        inverse = powers(pow(self.bases[0], -1, int(PRIME)), n)[:n]
        return mixed(_mod(_mod(s[WINDOW:] + PRIME - s[:n]) * inverse))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sketch(prefix: Prefix) -> np.ndarray:
    """The KEPT least distinct window hashes, as 32 bits."""
    w = (prefix.windows() >> np.uint64(32)).astype(np.uint32)
    if len(w) > 4 * KEPT:
        few = w[w <= np.partition(w, 2 * KEPT)[2 * KEPT]]
        if len(found := np.unique(few)) >= KEPT:
            return found[:KEPT]
    return np.unique(w)[:KEPT]


def fingerprint(prefix: Prefix) -> str:
    """Code points and hashes of the whole text, then the sketch: n-h1-h2-s1s2..., all hex."""
    whole = prefix.span(0, len(prefix)) if len(prefix) else (0,) * len(prefix.bases)
    return "-".join([f"{len(prefix):x}", *[f"{h:08x}" for h in whole], sketch(prefix).astype(">u4").tobytes().hex()])


def likeness(a: str, b: str) -> float:
    """0 to 1: of the KEPT least window hashes of both texts together, the share that both have. 1 if equal."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition("-")[2]), ">u4") for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    both = np.union1d(x, y)[: min(KEPT, max(len(x), len(y)))]
    return float(np.isin(np.intersect1d(x, y), both).sum() / len(both))


ROUTED = "bucket int, wrap int, doc_id long, mark binary, packed binary"
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_prefix long"


def _bucket_of(ids: np.ndarray, missing: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """0 for null ids, else 1 + the number of edges not above the id."""
    return np.where(missing, 0, 1 + np.searchsorted(edges, ids, side="right")).astype(np.int32)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket, wrap, doc_id and mark: each with the next of its bucket; rows with wrap only serve as next."""
    names, kinds = zip(*[x.split() for x in OUT.split(", ")], strict=True)
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[k] for k in kinds]
    pack = zstandard.ZstdDecompressor()
    held = None

    def pair(row: tuple, nxt: tuple) -> tuple:
        _, _, doc_id, text, prefix, mark = row
        n = len(text)
        edited = text[: n - n // 2] + nxt[3][: n // 2]
        changed = Prefix(edited)
        own, other, new = mark, nxt[5], fingerprint(changed)
        return doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, new, likeness(own, new), likeness(own, other), prefix.extension(0, changed, 0)

    for batch in batches:
        out = []
        for bucket, wrap, doc_id, _, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            text = pack.decompress(packed, max_output_size=1 << 31).decode("utf-8", "surrogatepass") if packed else ""
            prefix = Prefix(text)
            row = (bucket, wrap, doc_id, text, prefix, fingerprint(prefix))
            if held is not None and held[0] == bucket and held[1] == 0:
                out.append(pair(held, row))
            held = row
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 256, most_buckets: int = 20_000) -> DataFrame:
    """Per row of docs: n_chars, fingerprint, the edited text's digest and fingerprint, and likenesses to it and the next.

    Next: by doc_id (null first), then by a digest of the text; after the last row, the first. Null counts as empty.
    Rows go to buckets of consecutive ids, cut at approximate quantiles; the first rows of a bucket go to the bucket
    before, too, so one pass over sorted buckets sees all neighbours. Texts are shuffled once, compressed. The driver
    holds the buckets' edges and first ids: at most most_buckets numbers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = rows.select("doc_id")
    count = ids.count()
    n = max(1, min(most_buckets, count // bucket_rows))
    cuts = ids.select(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), 10 * n).alias("q")).first()["q"] if n > 1 else []
    edges = np.unique(np.array(cuts or [], np.int64))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, missing = _ids(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(_bucket_of(v, missing, edges)), batch.column(0)], names=["bucket", "doc_id"])

    first = sorted((r["bucket"], r["doc_id"]) for r in ids.mapInArrow(firsts, "bucket int, doc_id long").groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).collect())
    # The first id of a bucket serves as next in the bucket before; that of the first bucket in the last one.
    serves: dict[int | None, list[tuple[int, int]]] = {}
    for k, (_, doc_id) in enumerate(first):
        serves.setdefault(doc_id, []).append((first[k - 1][0], 1))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            v, missing = _ids(batch.column(0))
            out = []
            for doc_id, text, bucket in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bucket_of(v, missing, edges).tolist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                mark, packed = hashlib.blake2b(raw, digest_size=8).digest(), pack.compress(raw) if raw else b""
                out += [(b, w, doc_id, mark, packed) for b, w in [(bucket, 0), *serves.get(doc_id, [])]]
            if out:
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ROUTED.split(", ")])

    routed = rows.mapInArrow(route, ROUTED)
    return routed.repartition("bucket").sortWithinPartitions("bucket", "wrap", "doc_id", "mark").mapInArrow(_fingerprints, OUT)
