"""Secret scan with corpus-wide ownership frequency (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import stored

_ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: kind: pattern, group that holds the value, least characters of it. In this order kinds of one start are listed.
BASE = (("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
_PEM_END = "-----END [A-Z ]*PRIVATE KEY-----"
#: A private key's body is all up to its END line; where that is missing, what looks like lines of a key.
_PEM = f"-----BEGIN [A-Z ]*PRIVATE KEY-----((?:[^-]|-(?!----))*+(?={_PEM_END})|(?:(?:\\s|\\\\[nr])*+(?:(?:Proc-Type|DEK-Info):[^\r\n]*+|[A-Za-z0-9+/=]{{16,}}+))*+)(?:{_PEM_END})?"
#: Spans that the method adds.
MORE = (
    ("github", "gh[pousr]_[A-Za-z0-9]{30,}", 0, 34),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("slack", "xox[abeprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("stripe", "[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 24),
    ("pem", _PEM, 1, 1),
    ("login", "[a-z][a-z0-9+.-]{1,15}://[^\\s/:@]{1,64}:[^\\s/@]{3,128}@", 0, 12),
)
KINDS = BASE + MORE
PEM = [n for n, *_ in KINDS].index("pem")
#: Values that are written in the place of a secret, and values of at most three different characters. Both hold for
#: values of any length; a random value of thousands of characters has six x in a row by chance in one of 100 000 cases.
MOCK = "example|changeme|placeholder|your[_-]|x{6}"
FEW_MARKS = "^(?s)(.)\\1*+(?:(.)(?:\\1|\\2)*+(?:(.)(?:\\1|\\2|\\3)*+)?+)?+$"
#: Widely copied: values that so many owners have, or two owners in so many repositories.
OWNERS, REPOSITORIES = 3, 20
#: What any span of any kind makes match.
GATE = "(?:(?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|gh[pousr]_|eyJ|xox[abeprs]-|AIza|[sr]k_|PRIVATE KEY|://"


def candidates(texts: DataFrame) -> DataFrame:
    """texts(k, text): a row for each span: k, kind_no, start, end (code points), value, its from and to; failing matches
    are dropped. k tells texts apart; texts may be equal.

    A kind's matches and the text between them become rows; running sums of their lengths give places, so that a
    text with very many matches costs no more than their number.
    """
    kinds = F.array(*[F.struct(F.lit(i).alias("kind_no"), F.lit(f"(?:{p})" if not g else p).alias("re"), F.lit(g).alias("g"), F.lit(n).alias("least")) for i, (_, p, g, n) in enumerate(KINDS)])
    found = texts.select("k", "text", F.explode(F.filter(kinds, lambda r: F.rlike(F.col("text"), r["re"]))).alias("r"))
    gaps = F.transform(F.split("text", F.col("r.re"), -1), lambda x: F.length(x))
    whole = F.regexp_extract_all("text", F.col("r.re"), F.lit(0))
    value = F.regexp_extract_all("text", F.col("r.re"), F.col("r.g"))
    parts = found.select("k", F.col("r.kind_no").alias("kind_no"), F.col("r.least").alias("least"), F.posexplode(F.arrays_zip(gaps.alias("gap"), whole.alias("m"), value.alias("v"))).alias("i", "p"))
    run = Window.partitionBy("k", "kind_no").orderBy("i")
    start = F.sum("p.gap").over(run) + F.coalesce(F.sum(F.length("p.m")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spots = parts.withColumn("start", start).where("p.m is not null and length(p.v) >= least")
    begin = F.when(F.col("kind_no") == PEM, F.col("start") + F.length(F.regexp_extract("p.m", "^-----BEGIN [A-Z ]*PRIVATE KEY-----", 0)))
    begin = F.coalesce(begin, F.col("start") + F.length("p.m") - F.length("p.v"))
    spots = spots.select("k", "kind_no", "start", (F.col("start") + F.length("p.m")).alias("end"), F.col("p.v").alias("value"), begin.alias("from"))
    return spots.withColumn("to", F.col("from") + F.length("value"))


def ownership(found: DataFrame) -> DataFrame:
    """found(k, owner, vh) -> per value hash vh: repositories (rows k that hold it) and owners (distinct, null as one).

    The whole corpus counts. Rows are summed by (value, owner) before a value's owners meet, so one that a third of
    all rows hold costs no more than its owners.
    """
    by_owner = found.select("k", "owner", "vh").distinct().groupBy("vh", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("vh").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def digest(spans: Column) -> Column:
    return F.sha2(F.encode(spans, "UTF-8"), 256)


def scan(rows: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """rows(k, text, owner), k distinct -> a row for each span: k, kind_no, start, end, from, to (of the value), vh, shared.

    shared: placeholders, and values that many have by ownership(); the others look live and are their owners' own.
    Spans don't gather by text or value but in counts, so neither copies of a text nor a value that all hold pile up.
    """
    held = rows.where(F.col("text").rlike(GATE))
    found = candidates(held.select("k", "text")).join(held.select("k", "owner"), "k")
    mock = F.lower("value").rlike(MOCK) | F.lower("value").rlike(FEW_MARKS)
    found = stored(found.select("k", "owner", "kind_no", "start", "end", "from", "to", F.xxhash64("value").alias("vh"), mock.alias("mock")), "spans")
    many = (F.col("owners") >= owners) | ((F.col("owners") > 1) & (F.col("repositories") >= repositories))
    copied = ownership(found).where(many).select("vh", F.lit(True).alias("_copied"))
    return found.join(copied, "vh", "left").withColumn("shared", F.col("mock") | F.col("_copied").isNotNull()).drop("_copied", "mock", "owner")


def _numbered(docs: DataFrame, text_col: str, owner_col: str, row: Column) -> DataFrame:
    """docs as row, text, owner and k, a row's number, written out so that it stays the same; text null where no span can be."""
    text = F.when(F.col(text_col).rlike(GATE), F.col(text_col))
    return stored(docs.select(row.alias("row"), text.alias("text"), F.col(owner_col).alias("owner")).withColumn("k", F.monotonically_increasing_id()), "numbered")


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", **options) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared (distinct values).

    Null and empty texts have none. Repeated rows count as repositories of their own and get the same; ties don't
    matter: spans are listed by start, then kind. A null owner is one owner. An empty table gives none. Other columns
    aren't looked at. The matches of a long text are rows, ordered in one task a text and kind.
    """
    rows = _numbered(docs, text_col, owner_col, F.col(id_col))
    spans = scan(rows, **options)
    names = F.array(*[F.lit(n) for n, *_ in KINDS])
    line = lambda x: F.concat_ws(":", F.element_at(names, x["kind_no"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    spots = F.array_sort(F.collect_list(F.struct("start", "kind_no", "end")))
    counts = [F.count_if(F.col("kind_no") == i).alias(f"n_{n}") for i, (n, *_) in enumerate(BASE)]
    own, others = F.size(F.collect_set(F.when(~F.col("shared"), F.col("vh")))), F.size(F.collect_set(F.when(F.col("shared"), F.col("vh"))))
    by_row = spans.groupBy("k").agg(*counts, spots.alias("_s"), own.alias("n_live"), others.alias("n_shared"))
    base = F.array_join(F.transform(F.filter("_s", lambda x: x["kind_no"] < len(BASE)), line), ",")
    by_row = by_row.withColumn("base", base).withColumn("spans", F.array_join(F.transform("_s", line), ",")).drop("_s")
    out = rows.select(F.col("row").alias("doc_id"), "k").join(by_row, "k", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *[zero(f"n_{n}") for n, *_ in BASE], digest(F.coalesce("base", F.lit(""))).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_shared"))


def redacted(docs: DataFrame, *, text_col: str = "text", owner_col: str = "source", mark: str = "[secret]", **options) -> DataFrame:
    """docs, all rows and columns, with the live-looking values in the texts replaced by mark where they were found.

    Examples stay, and so does the same string elsewhere in a text. Values that overlap are replaced as one.
    Null and empty texts and empty tables stay as they are; repeated rows stay alike.
    """
    rows = _numbered(docs, text_col, owner_col, F.struct(*docs.columns))
    spans = scan(rows, **options).where("not shared").select("k", "from", "to").distinct()
    order = Window.partitionBy("k").orderBy("from", "to")
    apart = F.coalesce(F.col("from") > F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    spans = spans.withColumn("_new", apart.cast("int")).withColumn("_n", F.sum("_new").over(order))
    spans = spans.groupBy("k", "_n").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    cuts = spans.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("cuts"))
    out = rows.select("row", "k").join(cuts, "k", "left")
    text = F.col("row").getField(text_col)
    start = lambda i: F.when(i > 0, F.element_at("cuts", i)["to"]).otherwise(F.lit(0))
    parts = F.transform("cuts", lambda x, i: F.concat(F.substring(text, start(i) + 1, x["from"] - start(i)), F.lit(mark)))
    clean = F.concat(F.array_join(parts, ""), F.substring(text, F.element_at("cuts", -1)["to"] + 1, F.length(text)))
    text = F.when(F.col("cuts").isNotNull(), clean).otherwise(text)
    return out.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
