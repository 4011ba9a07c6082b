"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words: space and the controls 09 to 0D.
BLANKS = "\\x09-\\x0D\\x20"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir, or that was set with setCheckpointDir.

    With neither, a session in one process (master local, as in tests) gets a temporary folder; on a cluster, whose
    machines don't share such a one, that's an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Narrow rows that a file of a table of known size holds.
FILE_ROWS = 250_000


def stored(df: DataFrame, name: str, rows: int | None = None, per_file: int = FILE_ROWS) -> DataFrame:
    """Writes df to a fresh table in the shared folder and reads it back: lineage ends there and sizes are known.

    rows: no more than these are expected; then no more files are written than they fill at per_file rows each.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(1, -(-rows // per_file)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """batches in runs of rows of at most most bytes of texts (a longer row alone): what is made of the rows of a run at
    a time stays small, however many rows a batch has."""
    for batch in batches:
        if batch.nbytes <= most:
            yield batch
            continue
        size = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def word_count(text: Column) -> Column:
    """Number of words, i.e. runs of anything but BLANKS; 0 for null.

    Each word with the blanks before it shrinks to one letter, so that a byte length counts words without an array.
    """
    short = F.regexp_replace(text, f"[{BLANKS}]*[^{BLANKS}]+", "x")
    return F.coalesce(F.octet_length(F.trim(short, F.lit(BLANK_CHARS))), F.lit(0)).cast("long")


def running_position(rows: DataFrame, group: str, bucket: str, order: list, weight: str | None = None, with_group: DataFrame | None = None) -> DataFrame:
    """Adds place (0, 1, ... within group, by bucket and then order) and, with weight, before (the weight of earlier rows).

    group and bucket hold no nulls. One group may hold most rows: only (group, bucket) is ordered in one task, and
    the prefix over the buckets of a group runs on one row a bucket. with_group: columns by group to add on the way.
    """
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    earlier = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(group, bucket).agg(*sums)
    parts = parts.select(group, bucket, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in parts.columns[2:]])
    if with_group is not None:
        parts = parts.join(with_group, group)
    inside = Window.partitionBy(group, bucket).orderBy(*order)
    rows = rows.withColumn("place", F.row_number().over(inside) - F.lit(1))
    if weight:
        rows = rows.withColumn("before", F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = rows.join(parts, [group, bucket]).withColumn("place", F.col("place") + F.col("_n0")).drop("_n0")
    return out.withColumn("before", F.col("before") + F.col("_w0")).drop("_w0") if weight else out
