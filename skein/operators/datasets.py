"""Item datasets: append, page, map, reduce, export; key-value stores; transactions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce as fold
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.frontier import place
from skein.operators.predicates import is_json_object

KEY_RULE = r"^[a-zA-Z0-9!\-_.'()]{1,256}$"


class Dataset:
    """Rows in the order of seq. A view of df, whatever stores it."""

    def __init__(self, df: DataFrame, seq: str = "seq") -> None:
        self.df, self.seq = df, seq

    @classmethod
    def open(cls, spark: SparkSession, path: str, seq: str = "seq") -> Dataset:
        return cls(spark.read.parquet(path), seq)

    @staticmethod
    def push(items: DataFrame, path: str, json_col: str | None = None) -> None:
        """Appends items; with json_col, all must be JSON objects."""
        if json_col and not items.where(~is_json_object(json_col)).isEmpty():
            raise ValueError("items must be JSON objects")
        items.write.mode("append").parquet(path)

    def page(self, offset: int = 0, limit: int | None = None, desc: bool = False) -> DataFrame:
        """Rows offset .. offset + limit by seq, from the end if desc. Places come from counts, not from one sorted task."""
        rows = place(self.df, self.seq, "_place")
        if desc:
            rows = rows.withColumn("_place", F.lit(self.df.count() - 1) - F.col("_place"))
        out = rows.where(F.col("_place") >= offset)
        out = out.where(F.col("_place") < offset + limit) if limit is not None else out
        return out.orderBy("_place").drop("_place")

    def envelope(self, offset: int = 0, limit: int | None = None, desc: bool = False) -> DataFrame:
        total = F.count(F.lit(1))
        n = F.greatest(F.lit(0), total - offset)
        return self.df.agg(total.alias("total"), (F.least(n, F.lit(limit)) if limit is not None else n).alias("count"), F.lit(offset).alias("offset"), F.lit(limit if limit is not None else 0).alias("limit"), F.lit(desc).alias("desc"))

    def entries(self) -> DataFrame:
        """Rows with index, their place by seq."""
        return place(self.df, self.seq, "index")

    def for_each(self, fn: Callable[[dict, int], None]) -> None:
        """Calls fn(row, index) for its effects, in the tasks that hold the rows: once a row, or again where a task is."""
        self.entries().foreachPartition(lambda rows: [fn({k: v for k, v in r.asDict().items() if k != "index"}, r["index"]) for r in rows] and None)

    def fields(self, *names: str) -> DataFrame:
        return self.df.select(*names)

    def unwind(self, name: str) -> DataFrame:
        """A row for each element of an array (its fields beside the row's if they are structs)."""
        out = self.df.withColumn(name, F.explode_outer(name))
        kind = out.schema[name].dataType
        return out.select("*", f"{name}.*").drop(name) if kind.typeName() == "struct" else out

    def clean(self) -> DataFrame:
        """Without fields whose names start with #, and without rows that then hold nothing (seq aside)."""
        keep = [c for c in self.df.columns if not c.startswith("#")]
        some = [F.col(f"`{c}`").isNotNull() for c in keep if c != self.seq]
        out = self.df.select(*[F.col(f"`{c}`") for c in keep])
        return out.where(fold(lambda a, b: a | b, some)) if some else out

    def map(self, fn: Callable[[dict, int], Any], schema: str) -> DataFrame:
        """fn(item, index) for each row, in batches; falsy results are left out."""
        seq = self.seq

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [fn(r, int(r[seq])) for r in b.to_dict("records")]
                yield pd.DataFrame([r for r in rows if r])

        return self.df.mapInPandas(run, schema)

    def reduce(self, *columns: Column) -> DataFrame:
        """Folds that don't depend on order: ordinary aggregates, partial before the shuffle."""
        return self.df.agg(*columns)

    def fold(self, group: list[str], init: Column, step: Callable[[Column, Column], Column], value: Column, name: str = "value") -> DataFrame:
        """Ordered left fold in each group. A group is held in one task, so groups must be bounded; unbounded folds go
        through reduce()."""
        items = F.array_sort(F.collect_list(F.struct(F.col(self.seq).alias("s"), value.alias("v"))))
        return self.df.groupBy(*group).agg(F.aggregate(items, init, lambda a, x: step(a, x["v"])).alias(name))

    def info(self, at: str) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("item_count"), F.min(at).alias("created_at"), F.max(at).alias("modified_at"))

    def keys(self, json_col: str, *, collect_all: bool = False) -> DataFrame:
        """key, first_seq: the fields of the first item, or of all in the order they come up."""
        entries = F.map_keys(F.from_json(json_col, "map<string,string>"))
        rows = self.df
        if not collect_all:
            first = self.df.agg(F.min(self.seq).alias("_m"))
            rows = rows.join(F.broadcast(first), F.col(self.seq) == F.col("_m"))  # one row
        return rows.select(self.seq, F.posexplode(entries).alias("pos", "key")).groupBy("key").agg(F.min(F.struct(self.seq, "pos")).alias("_f")).select("key", F.col(f"_f.{self.seq}").alias("first_seq"), F.col("_f.pos").alias("pos"))

    def table(self, json_col: str, *, collect_all: bool = False) -> DataFrame:
        """JSON items as columns, as a CSV export has them. The header is collected: field names are bounded by the data's kind."""
        names = [r["key"] for r in self.keys(json_col, collect_all=collect_all).orderBy("first_seq", "pos").collect()]
        item = F.from_json(json_col, "map<string,string>")
        return self.df.select(self.seq, *[item.getItem(n).alias(n) for n in names])

    def export(self, path: str, kind: str | None = None, json_col: str | None = None, *, collect_all: bool = False) -> None:
        """Writes csv or json (told by the path's end if not given) as a folder of parts."""
        kind = kind or export_format(path)
        rows = self.table(json_col, collect_all=collect_all).drop(self.seq) if json_col else self.df
        rows.write.mode("overwrite").option("header", True).format(kind).save(path)


def export_format(path: str) -> str:
    m = re.search(r"(?i)\.(json|csv)$", path)
    if not m:
        raise ValueError(f"no format can be told from {path}")
    return m[1].lower()


class KeyValueStore:
    """records(seq, key, value binary, content_type): later seq stands for a key, a null value deletes it."""

    def __init__(self, records: DataFrame) -> None:
        self.records = records

    def latest(self) -> DataFrame:
        rest = [c for c in self.records.columns if c not in ("key", "seq")]
        last = self.records.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("_r"))
        return last.select("key", "_r.*").where("value is not null")

    def get(self, key: str) -> DataFrame:
        return KeyValueStore(self.records.where(F.col("key") == key)).latest()

    def exists(self, key: str) -> bool:
        return not self.get(key).isEmpty()

    def input(self) -> DataFrame:
        return self.get("INPUT")

    def list_keys(self, prefix: str = "", start_after: str | None = None, limit: int | None = None) -> DataFrame:
        """Keys in order, by keyset: those after start_after, which must exist."""
        rows = self.latest().where(F.col("key").startswith(prefix))
        if start_after is not None:
            if not self.exists(start_after):
                raise KeyError(start_after)
            rows = rows.where(F.col("key") > start_after)
        out = rows.select("key", F.octet_length("value").alias("size")).orderBy("key")
        return out.limit(limit) if limit is not None else out

    def parsed(self) -> DataFrame:
        """Values by content type: text for JSON, XML and text/*, else null (bytes stay in value)."""
        kind = F.lower(F.regexp_extract("content_type", "^[^;]*", 0))
        text = F.decode("value", "UTF-8")
        is_json = kind.isin("application/json") | kind.endswith("+json")
        return self.latest().withColumn("json", F.when(is_json, F.try_parse_json(text))).withColumn("text", F.when(is_json | kind.startswith("text/") | kind.endswith("xml"), text))

    def purged(self) -> DataFrame:
        """What a purge on start leaves."""
        return self.records.where("key = 'INPUT'")


def record(key: str, value: Any) -> tuple[str, bytes | None, str | None]:
    """A value as key, bytes and content type: text, bytes or anything JSON takes; None deletes."""
    if not re.match(KEY_RULE, key):
        raise ValueError(f"not a key: {key}")
    if value is None:
        return key, None, None
    if isinstance(value, bytes | bytearray):
        return key, bytes(value), "application/octet-stream"
    if isinstance(value, str):
        return key, value.encode(), "text/plain; charset=utf-8"
    return key, json.dumps(value, ensure_ascii=False, indent=2).encode(), "application/json; charset=utf-8"


class Transaction:
    """Writes held back until commit: key-value records, then requests, then items, each under the transaction's id.

    A commit that runs again overwrites its own folders, so a batch that is retried after a lost executor counts once."""

    ORDER = ("records", "requests", "items")

    def __init__(self, root: str, ident: int | str) -> None:
        self.root, self.ident, self.held = root, ident, {}

    def add(self, kind: str, rows: DataFrame) -> None:
        if kind not in self.ORDER:
            raise ValueError(kind)
        self.held[kind] = self.held[kind].unionByName(rows) if kind in self.held else rows

    def commit(self) -> None:
        for kind in self.ORDER:
            if kind in self.held:
                self.held[kind].write.mode("overwrite").parquet(f"{self.root}/{kind}/txn={self.ident}")

    def read(self, kind: str, base: DataFrame, key: str | None = None, order: str = "seq") -> DataFrame:
        """base with what is held back: the transaction reads its own writes. key: later rows by order stand for it."""
        both = base.unionByName(self.held[kind], allowMissingColumns=True) if kind in self.held else base
        return keep_last(both, [key], order) if key else both

    def rollback(self) -> None:
        self.held.clear()


def foreach_batch(root: str, **parts: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that commits each batch as a transaction; parts: kind -> what of the batch goes there."""

    def run(batch: DataFrame, ident: int) -> None:
        t = Transaction(root, ident)
        for kind, f in parts.items():
            t.add(kind, f(batch))
        t.commit()

    return run


def chunks(rows: DataFrame, size: int, order: str = "seq") -> DataFrame:
    """Adds chunk: rows in batches of size by order."""
    return place(rows, order, "_p").withColumn("chunk", F.expr(f"_p div {size}")).drop("_p")


def write_list(requests: DataFrame, path: str) -> None:
    """A request list as gzipped JSON lines."""
    requests.write.mode("overwrite").option("compression", "gzip").json(path)


def read_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_list() wrote; gzip is told by the files' names."""
    return spark.read.schema(schema).json(path)


def storage_writes(journal: DataFrame) -> DataFrame:
    """journal(store, op) -> reads, writes, deletes, lists of each store."""
    return journal.groupBy("store").agg(*[F.count_if(F.col("op") == o).alias(f"{o}s") for o in ("read", "write", "delete", "list")])


def keep_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key by order, aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in rows.columns])
