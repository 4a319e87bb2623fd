"""A store of speeches: tables that many runs share, each row replaced only by a run over its own document.

A table is partitioned by its keys (such as criterion and model) and by a bucket of the document's id. A run rewrites the buckets of its documents: their new rows,
and what other documents have there. So a run that is repeated leaves the table as it was, two speeches stay side by side, and what is shuffled or
rewritten follows the documents of a run and their buckets, not the store.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import stored

#: More buckets make smaller rewrites and more files; a store keeps the number that it began with.
BUCKETS = 64
BUCKET = "cubo"


def bucket_of(doc_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table of the store, without its buckets; None if nothing is stored."""
    rows = _stored_rows(spark, path, name)
    return None if rows is None else rows.drop(BUCKET)


def upsert(rows: DataFrame, documents: DataFrame, path: str, name: str, keys: dict[str, str], buckets: int = BUCKETS) -> None:
    """Put rows (doc_id, ...) in the place of what the table holds of documents (doc_id) under keys, column names and their values in this run.

    documents may lack rows, and then lose what they had. What stays is read into a table of its own before its bucket is replaced as a whole.
    """
    spark = rows.sparkSession
    here = documents.select("doc_id").distinct()
    touched = here.select(bucket_of(F.col("doc_id"), buckets).alias(BUCKET)).distinct()
    new = rows.withColumns({k: F.lit(v) for k, v in keys.items()}).withColumn(BUCKET, bucket_of(F.col("doc_id"), buckets))
    before = _stored_rows(spark, path, name)
    if before is not None:
        same = before.withColumns({k: F.col(k).cast("string") for k in keys})
        for k, v in keys.items():
            same = same.where(F.col(k) == v)
        others = same.join(F.broadcast(touched), BUCKET, "left_semi").join(here, "doc_id", "left_anti")
        new = stored(new.unionByName(others, allowMissingColumns=True))
        left = {r[BUCKET] for r in new.select(BUCKET).distinct().collect()}
        _drop(spark, path, name, keys, [r[BUCKET] for r in touched.collect() if r[BUCKET] not in left])
    partitions = [*keys, BUCKET]
    # a bucket is one file unless it is large
    new.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(f"{path}/{name}")


def _stored_rows(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}")
    except AnalysisException:
        return None


def _drop(spark: SparkSession, path: str, name: str, keys: dict[str, str], empty: list[int]) -> None:
    """Remove the folders of buckets that no row is left in; a dynamic overwrite keeps those."""
    if not empty:
        return
    catalog = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    under = "/".join([f"{path}/{name}", *(catalog.getPartitionPathString(k, v) for k, v in keys.items())])
    for bucket in empty:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{under}/{BUCKET}={bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def current(rows: DataFrame | None, versions: dict[str, object]) -> DataFrame | None:
    """The stored rows that were made by these versions; rows without a version are of an older one."""
    if rows is None:
        return None
    for k, v in versions.items():
        rows = rows.where(F.col(k) == v) if k in rows.columns else rows.where("false")
    return rows
