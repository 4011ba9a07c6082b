"""Tables written to the shared folder and read back, to end lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """Writes df under the folder that spark.checkpoint.dir names, and reads it back.

    Where that's unset, a session in one process (master local, as in tests) uses a temporary folder; on a cluster,
    whose machines don't share such a one, it's an error.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="skein-")
    path = f"{root.rstrip('/')}/skein-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
