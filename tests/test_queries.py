"""Each registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from skein.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, list | tuple):
        return [plain(y) for y in x]
    return x if x is None or isinstance(x, bool | str) else float(x) if isinstance(x, int) or type(x).__name__ == "Decimal" else str(x)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def compare(name, spark, folder, pages):
    """A query against its SQL on pages(page_id, url, html) of our own."""
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    df = registry.queries()[name](spark, str(folder))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    cur = c.execute(registry.oracle_sql()[name])
    assert sorted_rows(df.columns, df.collect()) == sorted_rows([d[0] for d in cur.description], cur.fetchall())


def test_css_select_references(spark, tmp_path):
    heads = ["a &amp", "a &quot;b", "&lt;i&gt; &amp;quot; &amp;amp;", "&copy; &#65; &am&lt;p; &", "x &ampy; \U0010ffff&lt", "", None]
    pages = [(i, "http://a.com/", h if h is None else f'<html><script>a && b</script><article id="&quot;"><h1>{h}</h1><p>&quot;</p></article></html>') for i, h in enumerate(heads)]
    compare("css_select", spark, tmp_path, pages)


def test_robots_on_pages_parameters(spark, tmp_path):
    ends = ["/en/15?page=2&ref=x", "/en/16?x=5", "/en/15#top", "/en/1?5", "/en/15", "/en/25?a=/1", "?a=/b/1", "", "/en/15.html"]
    compare("robots_on_pages", spark, tmp_path, [(i, f"http://{'ab'[i % 2]}.com{e}", "") for i, e in enumerate(ends * 2)])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, con):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    if sql := registry.oracle_sql().get(name):
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(names)
        assert sorted_rows(df.columns, rows) == sorted_rows(names, cur.fetchall())
