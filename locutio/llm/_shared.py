"""What the operators of this subpackage share: reading, checkpoints, Arrow kernels and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="checkpoints-"))
        named = _own[0]
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written as a compressed table to the shared folder and read again: a lost executor costs no recomputation of what led to it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, Arrow batches of what is computed hold at most so many rows: for rows that carry whole sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def releasing(mapped: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapped, after whose last batch what the worker has freed goes back to the system: workers outlive their tasks, and would keep the most that any
    of them took."""

    @functools.wraps(mapped)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from mapped(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not a GNU system
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def per_document(df: DataFrame, kernel: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema, ddl: str, rows: int = 1024, size: int = 4 << 20) -> DataFrame:
    """Apply kernel to the rows of df as an iterator of tuples and return its tuples as a DataFrame; one narrow pass, Arrow batches both ways.

    Strings arrive as they are; output batches hold at most so many rows or about so many bytes, so memory follows the longest document and not the partition.
    """
    names = schema.names

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held: list[tuple] = []
        weight = 0
        for row in kernel(tuples()):
            held.append(row)
            weight += sum(len(x) * (40 if isinstance(x, list) else 1) for x in row if isinstance(x, (bytes, str, list))) + 16
            if len(held) >= rows or weight >= size:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], names=names)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], names=names)

    return df.mapInArrow(releasing(mapped), ddl)


def appended(df: DataFrame, inputs: list[str], kernel: Callable[..., tuple], fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """df with new columns ``__name`` for fields (name, Arrow type, SQL type), from kernel(*inputs) of each row; one narrow pass, other columns go through unread."""
    schema = pa.schema([(f"__{name}", kind) for name, kind, _ in fields])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                new = [kernel(*row) for row in zip(*(part.column(c).to_pylist() for c in inputs), strict=True)]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*new), schema)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *schema.names])

    out = StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"__{name} {kind}" for name, _, kind in fields)).fields])
    return df.mapInArrow(releasing(mapped), out)


def filtering(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """stage(docs, ...), which returns rows with the columns of docs, for docs with any other columns: names that could clash are changed meanwhile."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args: object, **options: object) -> DataFrame:
        names = docs.columns
        plain = [f"other{k}{c}" if c.startswith("_") else c for k, c in enumerate(names)]
        return stage(docs.toDF(*plain), *args, **options).toDF(*names)

    return run


def joined(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """labels (an index of a row each) with the rows i and j in one class; a class has its smallest label."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            break
        i, j = i[apart], j[apart]
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := labels[labels], labels):
            labels = up
    return labels


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v: the same components with fewer links, each block of links within a task replaced by stars around its smallest nodes."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def star() -> pa.RecordBatch:
            names, at = np.unique(np.concatenate(held, 1), return_inverse=True)
            at = at.reshape(2, -1)
            label = joined(np.arange(len(names)), at[0], at[1])
            own = np.flatnonzero(label != np.arange(len(names)))
            return pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[label[own]])], names=["u", "v"])

        for batch in batches:
            held.append(np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], np.int64).reshape(2, -1))
            if sum(x.shape[1] for x in held) > 200_000:
                yield star()
                held = []
        if held:
            yield star()

    return edges.mapInArrow(releasing(mapped), "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs, any direction, repeats allowed -> (node, component), component the smallest node reachable.

    Alternating large and small stars over links that each task has contracted before; a round is a few aggregations with map-side minima and joins that
    AQE can split where a centre is hot, and ends in the checkpoint folder. It is over when every node has one link and no centre has another. Only
    two numbers a round reach the driver. Nodes without a link to another node don't appear.
    """
    e = checkpointed(_contracted(edges.where("u is not null and v is not null and u <> v").select("u", "v")).distinct())
    while True:
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 or (up = 1 and least = 0)").limit(1).count():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smaller = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = smaller.groupBy("u").agg(F.min("v").alias("m"))
        both = smaller.join(least, "u")
        stars = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        e = checkpointed(_contracted(stars).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
