"""Intermediate results that must be made once, such as a model's answers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="stored-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{sc.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as a table to a scratch path and read again: a retry or a second use reads the table and doesn't compute df anew."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
