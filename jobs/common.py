"""What the jobs share: their command line, their config file, partitioned writes that can be repeated."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults with what a JSON file says, by any path that Spark reads; unknown names are an error."""
    given = {} if path is None else {k: v for k, v in spark.read.json(path, multiLine=True).first().asDict().items() if v is not None}
    if unknown := given.keys() - defaults.keys():
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | given


def replace_partitions(rows: DataFrame, path: str, *columns: str) -> None:
    """Write rows as Parquet by the columns; of what is there only partitions that rows has are replaced. A partition is
    as few files as its size needs."""
    even = rows.hint("rebalance", *columns)
    even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def opened(spark: SparkSession, path: str, schema: str, *columns: str) -> DataFrame:
    """The table at the path; an empty one, partitioned by the columns, is made where none is."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*columns).parquet(path)
    return spark.read.schema(schema).parquet(path)


def command(doc: str, run: Callable[[SparkSession, str, str, str | None], DataFrame], argv: list[str] | None = None) -> None:
    """Run a job from the command line. Only this creates and stops a session."""
    p = argparse.ArgumentParser(description=doc)
    p.add_argument("source", help="the input table's path")
    p.add_argument("out", help="the output folder")
    p.add_argument("--config", help="a JSON file of settings")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(doc.split(":")[0]).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.source, args.out, args.config)
    finally:
        spark.stop()
