"""Handlers of pages by label, middlewares and pipelines over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Handler = Callable[[DataFrame], DataFrame]


class MissingRoute(ValueError):
    pass


class Router:
    """label -> handler, which makes items of the pages with that label; others go to the default handler."""

    def __init__(self) -> None:
        self.routes: dict[str, tuple[Handler, int | None, str | None]] = {}
        self.default: Handler | None = None
        self.middlewares: list[Handler] = []

    def handler(self, label: str, *, timeout_s: int | None = None, schema: str | None = None) -> Callable[[Handler], Handler]:
        """schema: DDL of user_data, parsed into the column `data` before the handler runs."""

        def add(fn: Handler) -> Handler:
            if label in self.routes:
                raise ValueError(f"label {label} has a handler")
            self.routes[label] = (fn, timeout_s, schema)
            return fn

        return add

    def default_handler(self, fn: Handler) -> Handler:
        if self.default is not None:
            raise ValueError("there is a default handler")
        self.default = fn
        return fn

    def use(self, fn: Handler) -> None:
        self.middlewares.append(fn)

    def run(self, pages: DataFrame, label: str = "label") -> DataFrame:
        """Items of all handlers. Every handler scans the pages of its own label only."""
        pages = pipeline(pages, *self.middlewares)
        if self.default is None:
            known = F.coalesce(F.col(label).isin(*self.routes) if self.routes else F.lit(False), F.lit(False))
            odd = pages.where(~known).select(label).limit(1).collect()
            if odd:
                raise MissingRoute(f"no route for label {odd[0][0]}")
        parts = []
        for name, (fn, _, schema) in self.routes.items():
            rows = pages.where(F.col(label) == name)
            parts.append(fn(rows.withColumn("data", F.from_json("user_data", schema)) if schema else rows))
        if self.default is not None:
            rest = ~F.coalesce(F.col(label).isin(*self.routes), F.lit(False)) if self.routes else F.lit(True)
            parts.append(self.default(pages.where(rest)))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def table(self, pages: DataFrame, label: str = "label") -> DataFrame:
        """pages with route and timeout_s: the lookup alone. Routes are literals, so nothing is shuffled."""
        route, timeout = F.lit("default" if self.default else None), F.lit(None).cast("int")
        for name, (_, t, _) in self.routes.items():
            route, timeout = F.when(F.col(label) == name, F.lit(name)).otherwise(route), F.when(F.col(label) == name, F.lit(t)).otherwise(timeout)
        return pages.withColumn("route", route).withColumn("timeout_s", timeout)


def pipeline(rows: DataFrame, *steps: Handler) -> DataFrame:
    for step in steps:
        rows = rows.transform(step)
    return rows


def split_failures(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows without error, rows with): the second goes to the handler of failed requests."""
    return rows.where(F.col(error).isNull()), rows.where(F.col(error).isNotNull())


def transform_requests(requests: DataFrame, change: Handler, skip: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(requests as changed, those skipped with reason `transform`)."""
    if skip is None:
        return change(requests), requests.limit(0).withColumn("reason", F.lit("transform"))
    gone = F.coalesce(skip, F.lit(False))
    return change(requests.where(~gone)), requests.where(gone).withColumn("reason", F.lit("transform"))
