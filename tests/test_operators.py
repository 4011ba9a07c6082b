"""Behaviour that SQL can't hold: parsers, globs, folds, stores, routers."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.functions import html as H
from skein.functions import text as T
from skein.operators import datasets as DS
from skein.operators import errors as E
from skein.operators import frontier as R
from skein.operators import predicates as P
from skein.operators import rendering as D
from skein.operators.datasets import Dataset, Transaction, export_format, record
from skein.operators.likeness import alike_counts
from skein.operators.router import MissingRoute, Router
from skein.sources import robots as B
from skein.sources import sitemaps as M
from skein.streaming import folds


def test_html_to_text():
    assert H.text_of("<html><head><title>t</title></head><body><p>a  b<p>c<script>x</script><!-- n --><br>d</body></html>") == "a b\nc\nd"
    assert H.text_of("<table><tr><td>1</td><td>2</td></tr></table>") == "1\t2"
    assert H.text_of("<pre> x\n  y</pre>") == "x\n  y"
    assert H.text_of("a&nbsp;&amp;b") == "a &b" and H.text_of(None) == ""


def test_links_and_selectors():
    page = '<base href="/d/"><a href="x">1</a><A HREF="http://o.org/y">2</A><a href="http://[bad">3</a><a>4</a>'
    assert H.links_of(page, "http://h.com/a") == ["http://h.com/d/x", "http://o.org/y"]
    with pytest.raises(ValueError):
        H.links_of('<a href="x">', None)
    root = H.parse('<div id="d" class="a b"><p data-k="one two">x</p></div><p>y</p>')
    assert [n.text() for n in H.select(root, "div#d.b > p[data-k~=two], p")] == ["x", "y"]


def test_social_handles(spark):
    page = '<a href="mailto:a@b.com"></a><a href="tel:+420 123 456"></a><p>x@y.org</p><p>775123456</p>https://twitter.com/someone https://www.facebook.com/somepage'
    r = spark.createDataFrame([(page,), (None,)], "html string").select(H.social_handles("html").alias("s")).collect()
    assert r[0]["s"]["emails"] == ["a@b.com", "x@y.org"] and "775123456" in r[0]["s"]["phonesUncertain"]
    assert r[0]["s"]["twitters"] == ["https://twitter.com/someone"] and not any(r[1]["s"])
    long = "a." * 50_000
    assert spark.createDataFrame([(long,)], "t string").select(T.emails("t").alias("e")).first()["e"] == []


@pytest.mark.parametrize(("glob", "url", "fits"), [("http://a.com/*", "http://a.com/x", True), ("http://a.com/*", "http://a.com/x/y", False), ("http://a.com/**", "HTTP://A.com/x/y", True), ("http{s,}://a.com/[0-9]", "https://a.com/7", True), ("http?(s)://a.com/{1..3}", "http://a.com/4", False), ("**/x", "http://a.com/b/x", True), ("http://a.com/[!a]", "http://a.com/a", False)])
def test_globs(spark, glob, url, fits):
    assert spark.createDataFrame([(url,)], "u string").select(P.matches_patterns("u", [glob]).alias("m")).first()["m"] is fits


def test_error_templates():
    assert E.template("a b c d e", "a b x d e") == "a b _ d e" and E.template("a b", "c d") is None
    assert E.fold_messages([("get 1 of it", 2), ("get 2 of it", 1), ("other", 1)]) == {"get _ of it": 3, "other": 1}


def test_session_and_throttle_steps():
    s, out = None, None
    for i, op in enumerate(["bad", "bad", "good", "bad", "bad"]):
        s, out = folds.session_step(s, {"session_id": 1, "seq": i, "at_s": i, "op": op})
    assert out["score"] == 3.5 and not out["usable"]
    t, waits = None, []
    for at, e in [(0, "429"), (1, "429"), (2000, "429"), (5999, "ok"), (30_000, "429")]:
        t, out = folds.throttle_step(t, {"domain": 1, "seq": at, "at_ms": at, "event": e, "value": None})
        waits.append((out["n429"], out["wait_ms"]))
    assert waits == [(1, 2000), (1, 1999), (2, 4000), (2, 1), (1, 2000)]


def test_batch_and_stream_folds_agree(spark, tmp_path):
    rows = [(k, i, i, "bad" if (i + k) % 3 == 0 else "good") for k in range(3) for i in range(20)]
    ev = spark.createDataFrame(rows, "session_id long, seq long, at_s long, op string")
    batch = folds.fold_batch(ev, "session_id", ["at_s", "seq"], folds.session_step, folds.SESSION_OUT)
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    out = folds.fold_stream(source, "session_id", ["at_s", "seq"], folds.session_step, folds.SESSION_OUT, folds.SESSION_STATE)
    q = out.writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert sorted(map(tuple, spark.table("folded").collect())) == sorted(map(tuple, batch.collect()))


def test_datasets_and_transactions(spark, tmp_path):
    items = spark.createDataFrame([(0, '{"id":1,"name":"a"}'), (1, '{"id":2,"age":3}')], "seq long, item string")
    d = Dataset(items)
    assert d.table("item").columns == ["seq", "id", "name"] and d.table("item", collect_all=True).columns == ["seq", "id", "name", "age"]
    with pytest.raises(ValueError):
        Dataset.push(spark.createDataFrame([("[1]",)], "item string"), str(tmp_path / "d"), "item")
    with pytest.raises(ValueError):
        export_format("x.txt")
    assert record("k", {"a": 1})[2].startswith("application/json") and record("k", None)[1] is None
    for _ in range(2):
        t = Transaction(str(tmp_path / "t"), 7)
        t.add("items", items)
        t.commit()
    assert spark.read.parquet(str(tmp_path / "t/items")).count() == 2


def test_router(spark):
    r = Router()
    r.handler("a")(lambda df: df)
    with pytest.raises(ValueError):
        r.handler("a")(lambda df: df)
    with pytest.raises(MissingRoute):
        r.run(spark.createDataFrame([("b",)], "label string"))


def test_rendering_features_are_means_over_all_pages(spark):
    urls = [f"http://{'ab'[i % 2]}.com/{('cat', 'cats', 'dog')[i % 3]}/{i * 7919 % 1000}{('', '/', '/x')[i % 5 % 3]}" for i in range(700)]
    rows = [(u, "L", D.STATIC if i % 4 else D.CLIENT) for i, u in enumerate([*urls, *urls[:40], "http://a.com", "http://a.com//"])]
    model = D.train_predictor(spark.createDataFrame(rows, "url string, label string, rendering_type string"))
    parts = lambda u: [(r := u[7:].split("/", 1))[0], "", *(r[1].split("/") if len(r) > 1 else [""])]
    for u in [*urls[::60], "http://a.com", "http://c.com/cat/1", "http://b.com/catx/79/x/y"]:
        for kind, got in zip((D.STATIC, D.CLIENT), model.features("L", parts(u)), strict=True):
            known = [parts(v) for v, _, k in rows if k == kind]
            assert abs(got - sum(D.similarity(parts(u), v) for v in known) / len(known)) < 1e-9


def test_pages_are_parsed_in_small_parts(spark, monkeypatch):
    pages = [f"<a href='mailto:a{i}@b.com'>x{i}</a>" + "<p>c@d.org" * (i % 5) for i in range(200)]
    pages += [None, "", "<p>" + "x" * 5000]
    whole = H.pa.concat_arrays(H._parts(iter([(H.pa.array(pages), H.pa.nulls(len(pages), "string"))])))
    monkeypatch.setattr(H, "PART", 1000)
    parts = list(H._parts(iter([(H.pa.array(pages), H.pa.nulls(len(pages), "string")), (H.pa.array([], "string"), H.pa.array([], "string"))])))
    assert max(map(len, parts)) < 30 and H.pa.concat_arrays(parts).equals(whole) and len(whole) == len(pages)
    got = spark.createDataFrame(list(enumerate(pages)), "i int, html string").repartition(3).select("i", H.social_handles("html").alias("s")).collect()
    assert sorted((r["i"], r["s"]["emails"]) for r in got) == [(i, ([f"a{i}@b.com"] + ["c@d.org"] * (i % 5 > 0)) if i < 200 else []) for i in range(len(pages))]


def test_alike_counts_decide_as_jaro_winkler():
    draw = random.Random(5)
    for letters, most in (("abc", 7), ("01", 10), ("0123456789", 8), ("aé\U0001d11e\0", 5), ("ab", 20), ("abcdef-", 40), ("ab-", 75)):
        base = "".join(draw.choice(letters) for _ in range(most))
        texts = [base[: draw.randint(0, most)] if draw.random() < 0.3 else "".join(draw.choice(letters) for _ in range(draw.randint(0, most))) for _ in range(100)]
        counts = np.array([[draw.randint(0, 3), 1] for _ in texts])
        got = alike_counts(texts[:60], texts[20:], counts[20:])
        for a, g in zip(texts[:60], got.tolist(), strict=True):
            assert g == sum([n for b, n in zip(texts[20:], counts[20:], strict=True) if D.jaro_winkler(a, b) > 0.8], np.zeros(2, int)).tolist()


def test_rendering_in_blocks_is_the_same(spark):
    rows = [(f"http://{'ab'[i % 2]}.com/{i % 5}/{i * 7919 % 1000}{('', '/', '/x')[i % 5 % 3]}", None if i % 7 == 0 else "L", D.STATIC if i % 3 else D.CLIENT) for i in range(300)]
    rows += [("http://a.com", "L", D.STATIC), ("no url", "L", D.STATIC), (None, "L", D.CLIENT), ("http://a.com/1/2", "L", "other")]
    df = spark.createDataFrame(rows, "url string, label string, rendering_type string")
    whole, blocks = D.train_predictor(df), D.train_predictor(df, block=(7, 11))
    assert sorted(map(repr, whole.alike.collect())) == sorted(map(repr, blocks.alike.collect())) and whole.weights == blocks.weights
    # Requests of all sorts, many at once, as one at a time.
    more = [("http://a.com/1/79/x/y", "L"), ("http://c.com/1/79", "L"), ("http://a.com/1/791", None), ("http://a.com/1", "new"), (None, "L"), ("no url", None), ("http://b.com//", "L"), ("http://b.com//", "L")]
    asked = spark.createDataFrame([*[r[:2] for r in rows[::40]], *more], "url string, label string")
    got = D.predict(asked, blocks).collect()
    assert len(got) == asked.count() and D.predict(asked, D.RenderingModel()).select("rendering_type", "detection_probability").distinct().collect() == [(D.CLIENT, 1.0)]
    for url, label, kind, chance in got:
        parts = [url[7:].split("/")[0], "", *url[7:].split("/")[1:]] if url and "//" in url else []
        assert (kind, chance) == blocks.predict(label, parts)


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_jaro_winkler(a, b):
    s = D.jaro_winkler(a, b)
    assert 0 <= s <= 1.0000001 and abs(s - D.jaro_winkler(b, a)) < 1e-9 and D.jaro_winkler(a, a) == 1


def test_place_keeps_rows_without_order_and_sparse_ones(spark):
    rows = [(i, None if i % 10 == 0 else i * i * 1_000_003) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, seq long")
    for per_task in (1 << 16, 7):
        got = sorted((r["p"], r["seq"]) for r in R.place(df, "seq", "p", per_task).collect())
        assert [p for p, _ in got] == list(range(500))
        assert [s for _, s in got] == [None] * 50 + sorted(s for _, s in rows if s is not None)
    assert R.place(df.limit(0), "seq", "p").count() == 0
    assert [r["id"] for r in Dataset(spark.createDataFrame([(1, None), (2, 5), (3, 4)], "id long, seq long")).page(0, 3).collect()] == [1, 3, 2]


def test_requests_from_text_and_options(spark):
    lines = spark.createDataFrame([(1, "see http://a.com/x http://b.com/y"), (2, None)], "seq long, value string")
    assert [r["url"] for r in R.requests_from_text(lines).orderBy("seq").collect()] == ["http://a.com/x", "http://b.com/y"]
    rows = spark.createDataFrame([(1, " http://a.com "), (2, '{"url": "http://b.com", "uniqueKey": "k", "userData": {"label": "inner", "n": "1"}}'), (3, None), (4, "{broken")], "seq long, source string")
    got = {r["seq"]: r for r in R.request_options(rows, label="all").collect()}
    assert (got[1]["url"], got[1]["label"], got[1]["method"]) == ("http://a.com", "all", "GET")
    assert (got[2]["unique_key"], got[2]["label"]) == ("k", "inner") and got[3]["url"] is None and got[4]["url"] is None


def test_pattern_tables_of_any_size(spark):
    urls = spark.createDataFrame([("http://a.com/1",), ("http://b.com/2",), (None,)], "url string")
    patterns = spark.createDataFrame([("a\\.com",), ("zzz",), (None,)], "regex string")
    for most in (1, 10):
        assert [r["url"] for r in P.by_pattern_table(urls, patterns, most=most).collect()] == ["http://a.com/1"]


def test_robots_go_by_the_most_specific_group(spark):
    rules = spark.createDataFrame([("http://a.com", "bot", False, "/x"), ("http://a.com", "goodbot", False, "/y"), ("http://a.com", "*", False, "/")], "origin string, agent string, allow boolean, path string")
    urls = spark.createDataFrame([("http://a.com/x",), ("http://a.com/y",)], "url string")
    got = {r["url"][-1]: r["robots_allowed"] for r in B.robots_allowed(urls, rules, "GoodBot/1.0").collect()}
    assert got == {"x": True, "y": False}


def test_list_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é", '{"a": 1, "b": "x,y"}'), (2, None, '{"b": "z", "c": "q\\"r"}')], "seq long, url string, item string")
    DS.write_list(rows, f"{tmp_path}/list")
    assert sorted(map(tuple, DS.read_list(spark, f"{tmp_path}/list", "seq long, url string, item string").collect())) == sorted(map(tuple, rows.collect()))
    Dataset(rows).export(f"{tmp_path}/out.csv", json_col="item", collect_all=True)
    back = spark.read.option("header", True).csv(f"{tmp_path}/out.csv")
    assert back.columns == ["a", "b", "c"] and {tuple(r) for r in back.collect()} >= {("1", "x,y", None)}
    Dataset(rows.limit(0)).export(f"{tmp_path}/none.json")
    assert not [p for p in (tmp_path / "none.json").glob("part-*") if p.stat().st_size]


def test_transaction_reads_its_writes(spark, tmp_path):
    base = spark.createDataFrame([(1, "k", "old"), (2, "j", "kept")], "seq long, key string, value string")
    t = Transaction(str(tmp_path), 1)
    t.add("records", spark.createDataFrame([(3, "k", "new"), (4, "k", "newer")], "seq long, key string, value string"))
    assert {r["key"]: r["value"] for r in t.read("records", base, "key").collect()} == {"k": "newer", "j": "kept"}
    t.rollback()
    assert t.read("records", base, "key").count() == 2


def test_gzip_sitemaps(spark, tmp_path):
    import gzip

    xml = "<urlset><url><loc>http://a.com/é</loc></url></urlset>"
    (tmp_path / "a.xml").write_bytes(gzip.compress(xml.encode()))
    (tmp_path / "b.xml").write_text(xml)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [r["loc"] for r in M.sitemap_entries(M.sitemap_bodies(files)).collect()] == ["http://a.com/é"] * 2


def test_page_content_is_what_its_parts_are(spark):
    pages = spark.createDataFrame([('<body>hi <a href="/x">l</a> a@b.com <a href="tel:+420 123 456">t</a></body>', "http://h.com/p"), (None, None)], "html string, url string")
    for r in pages.select("html", H.page_content("html", "url").alias("c"), H.html_to_text("html").alias("t"), H.extract_links("html", "url").alias("l"), H.social_handles("html").alias("s")).collect():
        assert r["c"]["contacts"] == r["s"] and (r["html"] is None or (r["c"]["text"], r["c"]["links"]) == (r["t"], r["l"]))
