"""Operators that look at the whole corpus: mixing, near copies, toxicity, archives, shards; against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from skein.llm import kd_shard, mixing, near_dedup, toxicity, warc

BLANKS = " \t\n\x0b\x0c\r"


def words(t):
    for c in BLANKS:
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(t):
    w = words(lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows, percent=85):
    """{doc_id: component} by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in root}


def test_mix(odd, none):
    rows = mixing.mixed_documents(odd, block_words=64).collect()
    again = mixing.mixed_documents(odd.repartition(7), block_words=64).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(rows, key=key) == sorted(again, key=key) and len(rows) == odd.count()
    sizes = Counter({})
    given = odd.select("doc_id", "text", "source").collect()
    for r in given:
        sizes[r["source"]] += len(words(r["text"] or ""))
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, fixed = {}, {}
    while len(fixed) < len(names):
        left = sum(sizes.values()) * 1.5 - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 2.0 * sizes[s] for s in free if target[s] > 2.0 * sizes[s]}
        if not over:
            break
        fixed |= over
        target = {}
    want = fixed | target
    source = {(r["doc_id"], len(words(r["text"] or ""))): r["source"] for r in given}
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    assert mixing.mixed_documents(none).count() == 0 and mixing.repeated_documents(none).count() == 0


def test_schedule_is_even(spark):
    totals = spark.createDataFrame([("sa", "a", 90_000), ("sb", "b", 30_000), ("sc", "c", 60_000)], "key string, source string, source_size long")
    plan = mixing.plan_targets(totals, block_words=100)
    slots = mixing.schedule(plan, 100)
    got = sorted((r["slot"], r["key"]) for r in slots.collect())
    need = {r["key"]: r["need"] for r in plan.collect()}
    assert Counter(k for _, k in got) == need
    seen, total = Counter(), sum(need.values())
    for n, (_, k) in enumerate(got, 1):
        seen[k] += 1
        assert abs(seen[k] - n * need[k] / total) <= 12


def test_repeated_documents_keeps_columns(odd):
    out = mixing.repeated_documents(odd, block_words=64)
    assert out.schema == odd.schema
    most = Counter(r["doc_id"] for r in odd.collect() if r["doc_id"] is not None)
    assert all(n <= 2 * most[i] for i, n in Counter(r["doc_id"] for r in out.collect() if r["doc_id"] is not None).items())
    assert {80, 81, 82} <= {r["doc_id"] for r in out.collect()}


def test_near_duplicates(odd, none):
    rows = near_dedup.near_duplicates(odd).collect()
    given = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect() if r["doc_id"] is not None]
    want, sets = components(sorted(dict(given).items())), {i: shingles(t) for i, t in given}
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], len(sets[r["doc_id"]]), r["doc_id"] == want[r["doc_id"]])
    kept = [r["doc_id"] for r in near_dedup.first_of_each(odd).collect() if r["doc_id"] is not None]
    assert sorted(kept) == sorted(i for i in want if want[i] == i)
    assert near_dedup.first_of_each(odd).schema == odd.schema and near_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_in_crowded_buckets(spark, monkeypatch, seed):
    """Edits of one text, many of which lie on either side of the threshold to one another."""
    monkeypatch.setattr(near_dedup, "SMALL", 32)
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(1, 7)):
            w[rng.randrange(300)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)


def finer_components(spark, rows):
    """{doc_id: component} by _finer alone, all rows in one bucket, each of its own component at first."""
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    left, links = spark.createDataFrame([(1, rows[0][0], i) for i, _ in rows], "bucket long, center long, node long"), set()
    sets = [near_dedup.shingle_sets([t]).__next__() for _, t in rows]
    marks = spark.createDataFrame([(i, len(s), near_dedup.parity(s).tolist()) for (i, _), s in zip(rows, sets, strict=True)], "node long, size long, bits array<long>")
    while not left.isEmpty():
        root = {i: i for i, _ in rows} | ({r["node"]: r["root"] for r in near_dedup.connected_components(spark.createDataFrame(sorted(links), "a long, b long")).collect()} if links else {})
        now = spark.createDataFrame([(r["bucket"], r["center"], r["node"], root[r["node"]]) for r in left.collect()], "bucket long, center long, node long, root long")
        found, left = near_dedup._finer(now, whole, marks, 85)
        links |= {(r["a"], r["b"]) for r in found.collect()}
    root = {i: i for i, _ in rows}
    while any(root[a] != root[b] for a, b in links):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_finer_meets_sets_that_share_no_difference(spark):
    """One set lacks the head of a text, another has a tail of its own: they are linked, neither with one that lacks the end."""
    base = [f"w{k}" for k in range(1004)]
    rows = [(0, " ".join(base[90:])), (1, " ".join(base[:-69])), (2, " ".join(base + [f"own{k}" for k in range(70)]))]
    for i in range(3, 13):
        rows.append((i, " ".join(base[: 80 * i - 100] + [f"f{i}x{k}" for k in range(100)] + base[80 * i :])))
    want = components(rows)
    assert want[0] == want[2] == 0
    assert finer_components(spark, rows) == want


@pytest.mark.parametrize("seed", [3, 4])
def test_finer_with_deletions_and_insertions(spark, monkeypatch, seed):
    monkeypatch.setattr(near_dedup, "SMALL", 12)
    rng = random.Random(seed)
    base, rows = [f"w{k}" for k in range(300)], []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            at, n = rng.choice([0, len(w), rng.randrange(len(w))]), rng.randint(1, 22)
            w[at : at + rng.choice([0, n])] = [f"e{rng.randrange(3)}x{k}" for k in range(rng.choice([0, n]))]
        rows.append((i, " ".join(w)))
    assert finer_components(spark, rows) == components(rows)


@pytest.mark.parametrize("n", [30, 300])
def test_near_duplicates_of_unequal_sizes(spark, monkeypatch, n):
    """Of a text: one cut, one with a tail, linked with it alone; many with tails of their own; whatever the group's size."""
    monkeypatch.setattr(near_dedup, "SMALL", 64)
    base = [f"w{k}" for k in range(1004)]
    rows = [(0, " ".join(base[:-40])), (1, " ".join([*base, *[f"a{k}" for k in range(40)]])), (2, " ".join([*base, *[f"b{k}" for k in range(134)]]))]
    rows += [(3 + i, " ".join([*base, *[f"t{i}x{k}" for k in range(45)]])) for i in range(n)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


@pytest.mark.parametrize("seed", [5, 6])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, seed):
    """Sets of unequal sizes with cuts and additions; small and large buckets, whatever counts as small."""
    rng, rows = random.Random(seed), []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.choice([20, 70])):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                at, n = rng.choice([0, len(w), rng.randrange(len(w) + 1)]), rng.randint(1, max(1, len(base) // 14))
                w[at : at + rng.choice([0, n])] = [f"e{rng.randrange(3)}x{k}" for k in range(rng.choice([0, n]))]
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    want = components(rows)
    for small in (4, 64):
        monkeypatch.setattr(near_dedup, "SMALL", small)
        assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_parity_bounds_the_difference(spark):
    rng = random.Random(2)
    for n in (3, 50, 3000):
        x, y = (np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)) for _ in range(2))
        y = np.union1d(y[: n // 5], x[: n // 2])
        differ = sum(int(a).bit_count() for a in (near_dedup.parity(x) ^ near_dedup.parity(y)).view(np.uint64))
        assert differ <= len(np.setxor1d(x, y)) and (n > 100 or differ > 0.8 * len(np.setxor1d(x, y)))
        assert not near_dedup.parity(x[:0]).any()


def test_bbit_estimate(spark):
    rng = random.Random(3)
    a = [f"w{rng.randrange(9000)}" for _ in range(800)]
    b = a[:400] + [f"v{rng.randrange(9000)}" for _ in range(400)]
    x, y = near_dedup.shingle_sets([" ".join(a), " ".join(b)])
    row = [(near_dedup.packed(near_dedup.minima(x)).tolist(), near_dedup.packed(near_dedup.minima(y)).tolist())]
    est = spark.createDataFrame(row, "sig_a array<long>, sig_b array<long>").select(near_dedup.estimate()).first()[0]
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs(est - true) < 0.15


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 301)], "a long, b long")
    assert {(r["node"], r["root"]) for r in near_dedup.connected_components(edges).collect()} == {(i, 0) for i in range(201)} | {(300, 300), (301, 300)}


def test_toxicity(spark, odd, none):
    rng = random.Random(1)
    nice = [f"nice{k}" for k in range(80)]
    foul = ["you are a worthless idiot", "i hate you stupid fool", "shut up you moron"]
    docs, labels = [], []
    for i in range(600):
        parts = [" ".join(rng.choice(nice) for _ in range(8)) for _ in range(rng.randint(1, 12))]
        bad = rng.random() < 0.3
        if bad:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(foul))
        docs.append((i, ". ".join(parts) + "."))
        labels.append((i, 1, int(bad)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    rows = toxicity.score_documents(d, model).collect()
    truth = {i: t for i, _, t in labels}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"]]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    bad = next(i for i, t in truth.items() if t)
    spots = [docs[bad][1][r["start"] : r["end"]] for r in toxicity.offending_sentences(d.where(f"doc_id = {bad}"), model).collect()]
    assert any(f in s for f in foul for s in spots)
    assert toxicity.score_documents(odd, model).count() == odd.count() and toxicity.score_documents(none, model).count() == 0
    assert {r["doc_id"] for r in toxicity.clean_documents(d, model).collect()} == {r["doc_id"] for r in rows if not r["predicted"]}
    empty = toxicity.train(d, lab.limit(0))
    assert {r["predicted"] for r in toxicity.score_documents(d, empty).collect()} == {0}


def test_toxicity_words_of_near_hashes_keep_their_weights():
    _, h = toxicity._hash_block(b"alpha beta gamma", toxicity._BREAK, toxicity._LETTER)
    near = h ^ np.uint64(1)  # as many hashes that differ in the last bit, of greater weight
    model = toxicity.Model(np.concatenate([h, near]), np.array([1.0, 2, 4, 9, 9, 9]), -3.0)
    want = 1 / (1 + np.exp(-4.0))
    assert abs(toxicity.scores(model, [b"alpha beta gamma"], model.table())[0] - want) < 1e-6
    assert [(a, b) for a, b, _ in toxicity.offending(model, "alpha beta gamma", model.table())] == [(0, 16)]
    none = toxicity.Model(np.empty(0, np.uint64), np.empty(0), -3.0)
    assert abs(toxicity.scores(none, [b"alpha"], none.table())[0] - 1 / (1 + np.exp(3.0))) < 1e-6


def test_toxicity_is_noisy_or_of_sentences():
    """Scores by hand: a word counts once in a sentence, and harmless words elsewhere don't hide an insult."""
    rng = random.Random(4)
    names = ["idiot", "aa", "bb", "cc", "dd"]
    weight = dict(zip(names, [6.0, -1.0, 0.5, 1.5, -3.0], strict=True))
    keys = np.array([toxicity._hash_block(w.encode(), toxicity._BREAK, toxicity._LETTER)[1][0] for w in names])
    model = toxicity.Model(keys, np.array([weight[w] for w in names]), -4.0)
    long = "bb cc other. " * 90_000 + "idiot"  # beyond a block
    texts = ["idiot" + " aa" * 9, "", ".", "IDIOT!dd\naa", long, "é idiot idiot. zz"]
    texts += [" ".join(rng.choice([*names, "other", "x.", "y\n"]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    got = toxicity.scores(model, [t.encode() for t in texts], model.table())
    for t, p in zip(texts, got, strict=True):
        parts = [{w for w in "".join(c if c.isalpha() else " " for c in s).lower().split()} for s in t.replace("!", ".").replace("?", ".").replace("\n", ".").split(".")]
        parts = [x for x in parts if x] or [set()]
        clean = 1.0
        for x in parts:
            clean *= 1 - 1 / (1 + np.exp(4.0 - sum(weight.get(w, 0) for w in x)))
        assert abs(p - (1 - clean)) < 1e-5, t[:50]
    assert [x[:2] for x in toxicity.offending(model, "é idiot idiot. zz", model.table())] == [(0, 14)]
    assert got[0] > 0.5


def test_toxicity_on_odd_and_empty_tables(spark, odd, none):
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(90)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd.withColumnsRenamed({"doc_id": "i", "text": "t"}).withColumn("y", odd.n_chars), lab, id_col="i", text_col="t")
    assert len(model.keys) and toxicity.offending_sentences(odd, model).columns == ["doc_id", "start", "end", "score"]
    assert toxicity.offending_sentences(none, model).count() == 0 and toxicity.clean_documents(none, model).count() == 0
    assert len(toxicity.train(none, lab).keys) == 0


def test_warc(spark, tmp_path):
    rng = random.Random(2)
    long = ["<p>" + "x" * n + "\r\n\r\né</p>" for n in (99, 150, 300)]
    rows = [(i, f"http://h/{i} a", rng.choice([*long, "short", "", None])) for i in range(60)] + [(70, None, long[0]), (None, "http://n/", long[0]), (70, None, long[0]), (71, "u", "\r\nWARC/1.1\r\n" * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archived_pages(pages, str(tmp_path / "w")).collect()
    firsts = {}
    for i, _, h in rows:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    for i, _, h in rows:
        raw, r = (h or "").encode(), by_id[i]
        again = len(raw) >= 100 and i != firsts.get(h or "")
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", firsts[h or ""]) if again else ("response", None))
    stored = warc.read_archives(spark, str(tmp_path / "w"), payload=True).where("record_type = 'response'").collect()
    assert {bytes(r["payload"]).decode() for r in stored} >= {h for _, _, h in rows if h}
    assert warc.archived_pages(pages.limit(0)).count() == 0
    # Large pages go to archives of their own, and clashing columns aren't looked at.
    clash = spark.createDataFrame([(i, "u", "z" * n, "d", 1) for i, n in enumerate([10, 40_000, 3_000_000, 3_000_000])], "page_id long, url string, html string, digest string, payload_bytes int")
    found = {r["page_id"]: r for r in warc.archived_pages(clash, str(tmp_path / "large")).collect()}
    assert [found[i]["payload_bytes"] for i in range(4)] == [10, 40_000, 3_000_000, 3_000_000] and found[3]["refers_to"] == 2
    assert len([p for p in (tmp_path / "large").glob("part-*")]) >= 3


def test_kd_shards(odd, none):
    rows = kd_shard.shard_documents(odd).collect()
    assert len(rows) == odd.count()
    slots, weight = defaultdict(list), Counter()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.select("doc_id", "text").collect()}
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        weight[r["shard"]] += r["size"]
        if r["doc_id"] is not None:
            raw = texts[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    assert kd_shard.shard_documents(none).count() == 0


def test_kd_shards_are_even(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, "y" * rng.randint(1, 400), rng.choice("ab"), rng.choice("abc")) for i in range(4000)], "doc_id long, text string, lang string, source string")
    weight = Counter()
    for r in kd_shard.shard_documents(docs).collect():
        weight[r["shard"]] += r["size"]
    mean = sum(weight.values()) / 24
    assert len(weight) == 24 and max(abs(w - mean) for w in weight.values()) < 0.05 * mean


def test_kd_shards_divide_repeated_rows(spark):
    rows = [(7, "a" * 500, "en", "s")] * 40 + [(i, "b" * 50, "en", "s") for i in range(100, 158)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    runs = [sorted(map(tuple, kd_shard.shard_documents(docs.repartition(n)).select("doc_id", "size", "shard", "slot").collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 98
    weight = Counter()
    for _, size, shard, _ in runs[0]:
        weight[shard] += size
    assert len(weight) == 24 and max(weight.values()) <= 3 * 508
