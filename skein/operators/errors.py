"""Error grouping: by place, code, name and message; templates of similar messages; the most frequent."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.urls import trimmed

# What stands for parts that an error lacks.
NO_STACK, NO_CODE, NO_NAME = "missing stack trace", "missing error code", "missing error name"


def unrolled(errors: DataFrame) -> DataFrame:
    """errors with causes (array of struct(name, code, message, stack)) as errors of their own beside them."""
    cols = ["name", "code", "message", "stack"]
    own = errors.select("seq", *cols)
    return own.unionByName(errors.select("seq", F.explode("causes").alias("c")).select("seq", *[f"c.{c}" for c in cols]))


def keyed(errors: DataFrame, *, full_stack: bool = False, full_message: bool = False) -> DataFrame:
    """errors(seq, name, code, message, stack) with the four parts that they're grouped by."""
    lines = F.transform(F.split("stack", "\n"), trimmed)
    frames = F.filter(lines, lambda x: x.startswith("at ") | x.startswith("eval at "))
    place = F.regexp_replace(F.regexp_extract(frames[0], r"\(?([^()\s]+:\d+:\d+)\)?$", 1), "^file://", "")
    shown = F.array_join(frames, "\n") if full_stack else F.when(F.size(frames) > 0, F.when(place != "", place).otherwise(frames[0]))
    message = F.coalesce("message", F.lit("Unknown error message. Received non-error object"))
    first = message if full_message else F.regexp_extract(message, "^[^\n]*", 0)
    fill = lambda c, d: F.coalesce(F.when(c != "", c), F.lit(d))
    return errors.select("seq", fill(shown, NO_STACK).alias("stack_key"), fill(F.col("code"), NO_CODE).alias("code_key"), fill(F.col("name"), NO_NAME).alias("name_key"), first.alias("message_key"))


def error_groups(errors: DataFrame, **shown: bool) -> DataFrame:
    """stack_key, code_key, name_key, message_key, n, first_seq. Partial counts before the shuffle."""
    return keyed(errors, **shown).groupBy("stack_key", "code_key", "name_key", "message_key").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def unique_errors(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count(F.lit(1)).alias("unique_errors"))


def top_errors(groups: DataFrame, n: int = 3) -> DataFrame:
    return groups.orderBy(F.desc("n"), "stack_key", "code_key", "name_key", "message_key").limit(n)


def common_run(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """Length and starts of the longest run of words in both; the earliest in a, then in b, of equal ones."""
    best, at_a, at_b = 0, -1, -1
    before = [0] * (len(b) + 1)
    ends = []
    for i, x in enumerate(a, 1):
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                now[j] = before[j - 1] + 1
                ends.append((now[j], i - now[j], j - now[j]))
        before = now
    if ends:
        best, at_a, at_b = min(ends, key=lambda e: (-e[0], e[1], e[2]))
    return best, at_a, at_b


def template(a: str, b: str) -> str | None:
    """One message for two, _ where they differ; None if half of it or more would be _."""

    def join(x: list[str], y: list[str]) -> list[str]:
        n, i, j = common_run(x, y)
        if not n:
            return ["_"]
        left = join(x[:i], y[:j]) if i or j else []
        right = join(x[i + n :], y[j + n :]) if i + n < len(x) or j + n < len(y) else []
        return left + x[i : i + n] + right

    out = join(a.split(" "), b.split(" "))
    return None if out.count("_") * 2 >= len(out) else " ".join(out)


def fold_messages(messages: list[tuple[str, int]]) -> dict[str, int]:
    """Messages in order of arrival, each put together with the first one so far that it makes a template with."""
    held: dict[str, int] = {}
    for message, n in messages:
        if message in held:
            held[message] += n
            continue
        for old in list(held):
            if (new := template(message, old)) is not None:
                total = n + held.pop(old)
                held[new] = held.get(new, 0) + total
                break
        else:
            held[message] = n
    return held


def message_templates(errors: DataFrame, **shown: bool) -> DataFrame:
    """Groups with similar messages put together. Only distinct messages of a (place, code, name) meet in one task, in
    the order they first came; their number is what code can say, not the number of errors."""
    groups = error_groups(errors, **shown)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["first_seq", "message_key"])
        held = fold_messages(list(zip(rows["message_key"], rows["n"].astype(int), strict=True)))
        first = rows.iloc[0]
        return pd.DataFrame({"stack_key": first["stack_key"], "code_key": first["code_key"], "name_key": first["name_key"], "message_key": list(held), "n": list(held.values())})

    return groups.groupBy("stack_key", "code_key", "name_key").applyInPandas(one, "stack_key string, code_key string, name_key string, message_key string, n long")
