"""Requests, storages and runs against small cases and rules taken row by row."""

from __future__ import annotations

import random

import pytest

from skein.operators import requests as Q
from skein.operators.datasets import Dataset, record
from skein.sources import storages as ST
from skein.streaming import folds, runs


def test_request_states(spark):
    moves = [("a", i, s) for i, s in enumerate(["before_nav", "after_nav", "request_handler", "error_handler", "done", "before_nav", "done"])] + [("b", 0, "done"), ("c", 0, "nonsense"), ("d", 0, None)]
    got = {(r["key"], r["seq"]): r["valid"] for r in Q.request_states(spark.createDataFrame(moves, "key string, seq long, state string")).collect()}
    assert [got["a", i] for i in range(7)] == [True] * 6 + [False] and not (got["b", 0] or got["c", 0] or got["d", 0])


def test_queue_state_row_by_row(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(60), rng.choice(["add", "fetch", "handle", "reclaim", "add"]), rng.choice([True, False, None])) for i in range(400)]
    want: dict = {}
    for seq, key, op, front in rows:
        s = want.get(key)
        if op == "add" and s is None:
            want[key] = ["pending", bool(front), seq]
        elif s and s[0] != "handled" and op == "reclaim":
            want[key] = ["pending", bool(front), seq]
        elif s and s[0] != "handled" and op in ("fetch", "handle"):
            s[0] = {"fetch": "busy", "handle": "handled"}[op]
    state = Q.queue_state(spark.createDataFrame(rows, "seq long, key long, op string, forefront boolean"))
    got = {r["key"]: r for r in state.collect()}
    assert got.keys() == want.keys()
    for key, (s, front, seq) in want.items():
        r = got[key]
        assert (r["handled"], r["in_progress"]) == (s == "handled", s == "busy")
        assert s == "handled" or (r["forefront"], r["seq"]) == (front, seq)
    c = Q.queue_counts(state).first()
    busy, waiting = (sum(s[0] == x for s in want.values()) for x in ("busy", "pending"))
    assert (c["in_progress"], c["pending"], c["is_empty"], c["is_finished"]) == (busy, busy + waiting, waiting == 0, busy + waiting == 0)
    order = sorted((k for k, s in want.items() if s[0] == "pending"), key=lambda k: (not want[k][1], -want[k][2] if want[k][1] else want[k][2]))
    assert [r["key"] for r in Q.queue_head(state, 5).collect()] == order[:5]
    none = Q.queue_counts(state.limit(0)).first()
    assert none["is_empty"] and none["is_finished"] and none["handled"] == 0


def test_sessions_are_kept_until_they_fail():
    s, at = None, [("good", 0), ("bad", 1), ("bad", 2), ("bad", 3), ("good", 4), ("retire", 5), ("good", 6), ("good", 4000)]
    got = []
    for i, (op, t) in enumerate(at):
        s, row = folds.reuse_step(s, {"pool": 1, "seq": i, "at_s": t, "op": op})
        got.append(row["session"])
    assert got == [0, 0, 0, 0, 1, 1, 2, 3]


def test_random_picks_fill_the_pool_first(spark):
    got = sorted(map(tuple, Q.random_picks(spark.range(200).withColumnRenamed("id", "seq"), 9, seed=1).collect()))
    assert [p for _, p in got[:9]] == list(range(9)) and set(p for _, p in got[9:]) == set(range(9))
    assert got == sorted(map(tuple, Q.random_picks(spark.range(200).withColumnRenamed("id", "seq").repartition(7), 9, seed=1).collect()))


def test_batched_adds(spark):
    rows = spark.createDataFrame([(i, i % 7 if i < 10 else i) for i in range(25)], "seq long, key long")
    got = {r["seq"]: r for r in Q.batched_adds(rows, 10, 8).collect()}
    assert [s for s in sorted(got) if got[s]["added"]] == [0, 1, 2, 3, 4, 5, 6, 10]
    assert [got[s]["batch"] for s in (0, 9, 10, 24)] == [0, 0, 1, 2] and got[9]["is_first"] and not got[10]["is_first"]
    assert Q.batched_adds(rows, 10).where("added").count() == 22 and Q.batched_adds(rows.limit(0), 10, 8).count() == 0


def test_storages(spark, tmp_path):
    s = ST.Storage(spark, str(tmp_path))
    assert s.names("dataset") == [] and not s.exists("store")
    s.append("dataset", spark.createDataFrame([(0, "a")], "seq long, v string"))
    s.append("dataset", spark.createDataFrame([(1, "b")], "seq long, v string"))
    s.append("dataset", spark.createDataFrame([(0, "c")], "seq long, v string"), "other")
    s.append("store", spark.createDataFrame([(i, *record(k, "v")) for i, k in enumerate(["INPUT", "x"])], "seq long, key string, value binary, content_type string"))
    assert s.names("dataset") == ["default", "other"] and [r["index"] for r in s.dataset().entries().orderBy("seq").collect()] == [0, 1]
    s.purge()
    assert s.names("dataset") == ["other"] and s.names("store") == ["default"]
    assert [r["key"] for r in s.store().latest().collect()] == ["INPUT"]
    assert s.drop("dataset", "other") and not s.drop("dataset", "other")
    with pytest.raises(ValueError):
        s.path("queue", "../x")


def test_sources_besides_tables(spark, tmp_path):
    static = spark.createDataFrame([(0, "http://a"), (5, "http://b")], "seq long, url string")
    more = lambda s: s.createDataFrame([(0, "http://c")], "seq long, url string")
    assert [tuple(r) for r in ST.with_function(static, more).orderBy("seq").collect()] == [(0, "http://a"), (5, "http://b"), (6, "http://c")]
    assert [tuple(r) for r in ST.with_function(static.limit(0), more).collect()] == [(0, "http://c")]
    (tmp_path / "f.bin").write_bytes(b"\x00\xff")
    assert [(bytes(r["body"]), r["size"]) for r in ST.downloaded(spark, f"{tmp_path}/f.bin").collect()] == [(b"\x00\xff", 2)]


def test_for_each_sees_every_row(spark, tmp_path):
    out = str(tmp_path)

    def write(row, i):
        with open(f"{out}/{i}", "w") as f:
            f.write(str(row["v"]))

    Dataset(spark.createDataFrame([(10, "a"), (20, "b")], "seq long, v string")).for_each(write)
    assert sorted((p.name, p.read_text()) for p in tmp_path.iterdir()) == [("0", "a"), ("1", "b")]


def test_paused_runs_go_on(spark, tmp_path):
    source, root, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    seen = []
    events = runs.Events()
    events.on("persist_state", lambda p: seen.append("persist"))
    events.on("exit", lambda e: seen.append("exit"))
    spark.streams.addListener(events)
    try:
        for part in ((0, 5), (5, 9)):
            spark.range(*part).write.mode("append").parquet(source)
            stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
            q = runs.start(stream, root, check, until_idle=True, items=lambda b: b)
            q.awaitTermination(60)
            runs.pause(q)
    finally:
        spark.streams.removeListener(events)
    assert sorted(r["id"] for r in spark.read.parquet(f"{root}/items").collect()) == list(range(9))
    events.emit("exit")
    assert "exit" in seen


def test_recoverable_state(spark, tmp_path):
    path = str(tmp_path / "kv")
    s = runs.RecoverableState(spark, path, "STATS", {"n": 0})
    s.value["n"] += 2
    assert s.persist() and not s.persist()
    again = runs.RecoverableState(spark, path, "STATS", {"n": 0})
    assert again.value == {"n": 2}
    again.value = {"n": 3}
    assert again.persist() and not again.maybe_persist()
    assert runs.RecoverableState(spark, path, "STATS", {"n": 0}).value == {"n": 3}
    again.reset()
    assert again.value == {"n": 0} and runs.RecoverableState(spark, path, "OTHER", []).value == []
