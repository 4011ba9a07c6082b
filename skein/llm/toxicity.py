"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learnt from labels of documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import sliced, stored
from skein.llm.wordhash import BYTE, PIECE, _hash_block

#: Only letters and bytes from 80 up make words here.
_BREAK = np.ones(256, bool)
_BREAK[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LETTER = np.where(_BREAK, np.uint64(0), BYTE | np.uint64(1))
_LETTER[65:91] = _LETTER[97:123]
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True
#: Bounds of the labelled sample that one task fits on.
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 2000, 4000, 1 << 25


def sentences(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Word hashes and sentence numbers (rising from 0) of blocks of a text, and sentences so far.

    Sentences end at . ! ? or a line's end; one beyond PIECE bytes is cut at its last word there.
    """
    at, base = 0, 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            a = np.frombuffer(text, np.uint8, end - at, at)
            cut = np.flatnonzero(_STOP[a])
            cut = cut if len(cut) else np.flatnonzero(_BREAK[a])
            end = at + int(cut[-1]) + 1 if len(cut) else end
        block = text[at:end]
        starts, hashes = _hash_block(block, _BREAK, _LETTER)
        ends = np.flatnonzero(_STOP[np.frombuffer(block, np.uint8)])
        number = np.searchsorted(ends, starts)
        yield hashes, number + base, base + len(ends) + 1
        base += len(ends) + 1
        at = end


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, each word's sentence (0, 1, ... over all texts, those without words left out), each sentence's text."""
    words, sents, docs, base = [], [], [], 0
    small, owner = [], []

    def flush() -> None:
        nonlocal base
        if small:
            block = b"\n".join(small)
            starts, hashes = _hash_block(block, _BREAK, _LETTER)
            ends = np.flatnonzero(_STOP[np.frombuffer(block, np.uint8)])
            heads = np.cumsum([0, *[len(t) + 1 for t in small]])[:-1]
            used, inv = np.unique(np.searchsorted(ends, starts), return_inverse=True)
            first = np.full(len(used), 0)
            first[inv[::-1]] = starts[::-1]
            words.append(hashes)
            sents.append(inv + base)
            docs.append(np.array(owner)[np.searchsorted(heads, first, side="right") - 1] if len(used) else np.empty(0, int))
            base += len(used)
            small.clear()
            owner.clear()

    size = 0
    for i, t in enumerate(texts):
        if len(t) > PIECE:
            flush()
            size = 0
            for hashes, number, _ in sentences(t):
                used, inv = np.unique(number, return_inverse=True)
                words.append(hashes)
                sents.append(inv + base)
                docs.append(np.full(len(used), i))
                base += len(used)
            continue
        if size + len(t) > PIECE:
            flush()
            size = 0
        small.append(t)
        owner.append(i)
        size += len(t) + 1
    flush()
    cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    return cat(words, np.uint64), cat(sents, np.int64), cat(docs, np.int64)


@dataclass
class Model:
    """Weights of words by full hash, and the weight that every sentence starts from."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.keys)
        return self.keys[order], self.weights[order].astype(np.float32)


def known(table: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that have a weight, and the places of their weights."""
    keys = table[0]
    at = np.searchsorted(keys, words)
    hit = np.flatnonzero(at < len(keys))
    hit = hit[keys[at[hit]] == words[hit]]
    return hit, at[hit]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(texts: list[bytes], toxic: np.ndarray, clean_weight: float = 1.0, steps: int = 200, sparse: float = 1e-4, least_docs: int = 2) -> Model:
    """Least mean negative log-likelihood of noisy-or plus sparse times the weights' absolute sum, by proximal gradients.

    P(toxic) = 1 - prod(1 - sigmoid(z)), z a sentence's bias and the weights of its distinct words. The absolute sum
    leaves words that a few toxic texts hold by chance without weight. Words of fewer than least_docs texts have none.
    clean_weight makes up for a sample with fewer clean texts.
    """
    words, sents, docs = bags(texts)
    y = np.asarray(toxic, np.float64)
    if not len(words) or y.min() == y.max():
        return Model(np.empty(0, np.uint64), np.empty(0), float(-8 if not len(y) or y.max() == 0 else 2))
    keys, index = np.unique(words, return_inverse=True)
    del words
    pairs = np.unique(index * len(texts) + docs[sents])
    keep = np.flatnonzero(np.bincount(pairs // len(texts), minlength=len(keys)) >= least_docs)
    new = np.full(len(keys), -1)
    new[keep] = np.arange(len(keep))
    held = new[index] >= 0
    pairs = np.unique(sents[held] * max(1, len(keep)) + new[index][held])
    at, index = pairs // max(1, len(keep)), pairs % max(1, len(keep))
    del pairs, held, new, sents
    n, k = len(docs), len(keep)
    weight = np.where(y > 0, 1.0, clean_weight)
    weight = weight / weight.sum()

    def shown(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        z = w[k] + np.bincount(at, weights=w[index], minlength=n)
        s = np.bincount(docs, weights=softplus(z), minlength=len(y))
        return z, s, float((weight * np.where(y > 0, -np.log(np.maximum(-np.expm1(-s), 1e-12)), s)).sum())

    w = np.zeros(k + 1)
    w[k] = -5.0
    ahead, pace, curve = w.copy(), 1.0, 1.0
    for _ in range(steps):
        z, s, loss = shown(ahead)
        ds = weight * np.where(y > 0, -1.0 / np.maximum(np.expm1(np.minimum(s, 500)), 1e-9), 1.0)
        dz = ds[docs] / (1 + np.exp(-z))
        g = np.append(np.bincount(index, weights=dz[at], minlength=k), dz.sum())
        while True:
            to = ahead - g / curve
            to[:k] = np.sign(to[:k]) * np.maximum(np.abs(to[:k]) - sparse / curve, 0)
            step = to - ahead
            if shown(to)[2] <= loss + g @ step + curve / 2 * (step @ step) + 1e-12:
                break
            curve *= 2
        quick = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        if (ahead - to) @ (to - w) > 0:  # it overshot: begin anew from here
            ahead, pace = to.copy(), 1.0
        else:
            ahead, pace = to + (pace - 1) / quick * (to - w), quick
        w, curve = to, curve * 0.9
    big = w[:k] != 0
    return Model(keys[keep][big], w[:k][big], float(w[k]))


def scores(model: Model, texts: list[bytes], table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Noisy-or of the sentences of each text; a text without words counts as one sentence without known words.

    As in fit(), a word counts once in a sentence, however often it stands there.
    """
    words, sents, docs = bags(texts)
    hit, place = known(table, words)
    pairs = np.unique(sents[hit] * max(1, len(table[0])) + place)
    z = model.bias + np.bincount(pairs // max(1, len(table[0])), weights=table[1][pairs % max(1, len(table[0]))] if len(pairs) else None, minlength=len(docs))
    s = np.bincount(docs, weights=softplus(z), minlength=len(texts))
    s[np.bincount(docs, minlength=len(texts)) == 0] = softplus(np.float64(model.bias))
    return -np.expm1(-s)


def offending(model: Model, text: str, table: tuple[np.ndarray, np.ndarray], least: float = 0.5) -> list[tuple[int, int, float]]:
    """Start, end (code points) and score of the sentences of text that score least or more."""
    out, at, point = [], 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    ends = np.append(np.flatnonzero(_STOP[np.frombuffer(raw, np.uint8)]), len(raw)) if raw else np.empty(0, int)
    for end in ends.tolist():
        block = raw[at : end + 1]
        if block:
            _, h = _hash_block(block, _BREAK, _LETTER)
            z = model.bias + float(table[1][np.unique(known(table, h)[1])].sum())
            # Code points: bytes that don't go on with one.
            size = int(np.count_nonzero((np.frombuffer(block, np.uint8) & 0xC0) != 0x80))
            if (p := 1 / (1 + np.exp(-z))) >= least and len(h):
                out.append((point, point + size, float(p)))
            point += size
        at = end + 1
    return out


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> Model:
    """Fits on a bounded sample of the labelled rows that aren't held out: those of least hash, at most max_toxic and
    max_clean, and of either as far as max_bytes of texts go. Of conflicting labels of a document the highest counts;
    labels without a document or value don't. Of repeated rows one text counts. Without labels: no word has a weight."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("_y"))
    known = known.where(F.col("_y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("_y").alias("y"))
    sizes = rows.groupBy("doc_id").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("size"))
    known = stored(known.join(sizes, "doc_id").withColumn("h", F.xxhash64("doc_id")), "labelled")
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    picked = []
    for y, most in ((1, max_toxic), (0, max_clean)):
        own, left = known.where(F.col("y") == y).orderBy("h", "doc_id").limit(most).select("doc_id", "y", "size").collect(), max_bytes
        picked.append([])
        for r in own:
            left -= r["size"]
            if left >= 0:
                picked[-1].append((r["doc_id"], r["y"]))
    if not any(picked):
        return Model(np.empty(0, np.uint64), np.empty(0), -8.0)
    ids = docs.sparkSession.createDataFrame([r for p in picked for r in p], "doc_id long, y int")
    clean = max(1.0, n.get(0, 0) / max(1, len(picked[1]))) / max(1.0, n.get(1, 0) / max(1, len(picked[0])))
    # At most max_toxic + max_clean ids; of rows with one id the text of the greatest digest, whatever their order.
    sample = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.max_by("text", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, y, t or "") for b in batches for i, t, y in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "y")], strict=True))
        m = fit([t.encode("utf-8", "surrogatepass") for _, _, t in rows], np.array([y for _, y, _ in rows]), clean)
        yield pa.RecordBatch.from_arrays([pa.array([m.keys.view(np.int64)], pa.list_(pa.int64())), pa.array([m.weights], pa.list_(pa.float64())), pa.array([m.bias])], names=["keys", "weights", "bias"])

    # The bounded sample is fitted in one task, so the driver only holds the model.
    r = sample.repartition(1).mapInArrow(learn, "keys array<long>, weights array<double>, bias double").first()
    return Model(np.array(r["keys"], np.int64).view(np.uint64), np.array(r["weights"], np.float64), r["bias"])


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. Scores come from the text alone; null counts as empty.

    Rows don't meet: repeats score alike, ties need nothing, an empty table gives none. Texts are scored in runs of a
    few MB, a very long one in blocks that end at sentences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in sliced(batches):
            s = scores(model, [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()], table)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCORED)


def offending_sentences(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """A row for each sentence that scores least or more: doc_id, start, end (code points), score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in sliced(batches):
            rows = [(i, *x) for i, t in zip(*[c.to_pylist() for c in batch.columns], strict=True) for x in offending(model, t or "", table, least)]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "start", "end", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, start long, end long, score double")


def clean_documents(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores under least."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in sliced(batches):
            s = scores(model, [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(at).to_pylist()], table)
            yield batch.filter(pa.array(s < least))

    return docs.mapInArrow(run, docs.schema)
