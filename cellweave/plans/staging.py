"""Cutting lineage between the rounds of a fixpoint, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder, in local mode only: on a cluster no other machine
    sees it."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is needed: a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="cellweave-")
        sc.setCheckpointDir(path)
    return path


#: Files as large as their rows. Spark takes a file's size for its rows' when it chooses what to broadcast, and ids that
#: repeat, packed, are a small part of what they are in memory.
PLAIN = {"compression": "none", "parquet.enable.dictionary": "false"}


def cut(df: DataFrame) -> DataFrame:
    """df written under the shared folder and read back. What is read back is broadcast only where it is small unpacked."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cellweave/round-{uuid.uuid4().hex}"
    df.write.options(**PLAIN).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
