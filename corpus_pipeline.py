"""A corpus pipeline of training-data operators: reject, deduplicate, redact, mix, encode.

Each stage's rows are written as Parquet and read again as the next one's documents. An empty table stays empty
through all stages; rows without doc_id, source, language or text go through them, see each.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, mixing, near_dedup, secrets, toxicity
from skein.llm.common import scratch_dir, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; learnt from the labels of those that came in. Null and empty texts count as one
    sentence without known words; repeated rows score alike."""
    return toxicity.clean_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id; null and empty texts are nobody's copies. Of
    repeated rows one stays, and of rows without id one of each text that no row with an id has."""
    return near_dedup.first_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking credentials replaced; n_chars follows the text. A null source is an owner of its own;
    null and empty texts stay as they are."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources reads them, at most twice. A null source is a source; null and empty
    texts stay once. Which documents a pass cuts goes by a hash of the id, so reruns agree."""
    return mixing.repeated_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the mix: its tokens' number and digest, and the decoded text's. Null counts as empty:
    no tokens."""
    return bpe.coded_documents(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", reject_toxic),
    ("near copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("encoding", encode),
]

#: Learnt scores and token ids aren't for SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
