"""What the operators of this subpackage share: inputs, working folders, Arrow helpers."""

from __future__ import annotations

import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelog.sources.files import clean_up, shared_dir, work_dir, work_root

__all__ = ["BATCH_ROWS", "clean_up", "cut", "prepare", "shared_dir", "stored", "table", "texts", "work_dir", "work_root"]

#: Rows of one Arrow batch; bounds a Python worker's memory when every text is very long.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by rows, for the session, and let workers import the package from where the driver does.

    On a cluster whose machines don't have that path, install the package there or ship it with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: no lineage, and a size the planner knows."""
    spark = df.sparkSession
    path = work_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
