"""Approximate nearest neighbours with a hash-prefix forest.

Rows are dealt into shards. A shard holds, for each tree, one sorted array of 32-bit hash strings (signs of random projections). A query descends in
every tree to the longest prefix it shares; then all trees ascend together, one bit at a time, each giving the range of the array under the shorter
prefix, until the union holds enough candidates. Candidates are measured exactly. Every query meets every shard, in blocks; equal vectors are one
entry of a shard that keeps its smallest ids, as many as an answer can hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import checkpointed, table

TREES, BITS, SEED = 16, 32, 20
#: The ascent goes on until a share of a shard's vectors is reached, but at least so many. The share is the least of these with which sample queries find
#: RECALL of their nearest in a sample of the rows: a fifth of a percent may do for clustered vectors, half is needed on directions spread evenly.
SHARES, LEAST, RECALL = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0), 64, 0.97
#: Rows, those with the smallest hash, and queries of the sample.
SAMPLE_ROWS, SAMPLE_QUERIES = 8192, 128
SHARD_ROWS, QUERY_ROWS = 16_384, 20_000


class Forest:
    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS) -> None:
        self.x, self.bits = x, bits
        self.planes = np.random.default_rng(SEED).normal(size=(trees, x.shape[1], bits))
        keys = self.hashes(x)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, 1)

    def hashes(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows) strings as integers, first bit highest."""
        weights = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        return np.stack([(x @ p > 0) @ weights for p in self.planes])

    def candidates(self, q: np.ndarray, wanted: int) -> list[np.ndarray]:
        """Rows for each query: the union of all trees' ranges at the longest common depth that gives wanted rows."""
        wanted, n = min(wanted, len(self.x)), len(q)
        keys = self.hashes(q)
        found: list[np.ndarray] = [np.empty(0, int)] * n
        open_ = np.arange(n)
        for depth in range(self.bits, -1, -1):
            if not len(open_):
                break
            low = (keys[:, open_] >> (self.bits - depth)) << (self.bits - depth)
            lo = np.stack([np.searchsorted(k, a) for k, a in zip(self.keys, low)])
            hi = np.stack([np.searchsorted(k, a + (1 << (self.bits - depth))) for k, a in zip(self.keys, low)])
            for i in np.flatnonzero((hi - lo).sum(0) >= wanted):
                mask = np.zeros(len(self.x), bool)
                for t in range(len(self.keys)):
                    mask[self.order[t, lo[t, i] : hi[t, i]]] = True
                if mask.sum() >= wanted or depth == 0:
                    found[open_[i]] = np.flatnonzero(mask)
            open_ = open_[[not len(found[i]) for i in open_]]
        return found


def usable(rows: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is neither null nor zero and has finite components only."""
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", e.cast("array<double>").alias("embedding"))


def wanted(share: float, rows: int) -> int:
    return max(LEAST, int(np.ceil(share * rows)))


def least_share(x: np.ndarray, k: int) -> float:
    """The least of SHARES with which the first rows of x find RECALL of their k nearest other rows of x through the forest."""
    q = x[:SAMPLE_QUERIES]
    if len(x) <= k + 1:
        return 1.0
    true = []
    for i, v in enumerate(q):
        d = ((x - v) ** 2).sum(1)
        d[i] = np.inf
        true.append(np.argpartition(d, k)[:k])
    forest = Forest(x)
    for share in SHARES:
        found = forest.candidates(q, wanted(share, len(x)))
        if np.mean([np.isin(t, f).mean() for t, f in zip(true, found)]) >= RECALL:
            return share
    return 1.0


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each (vec_id, embedding) of queries its k nearest rows by Euclidean distance, but for rows with its own id.

    share of a shard is looked at, by default what a sample of rows needs for RECALL. Unusable vectors take no part, vectors meet those of their own length, an id that repeats counts once for each vector it has; ties go to the
    smaller id; fewer than k rows are all returned.
    """
    rows = usable(rows).withColumn("h", F.xxhash64("embedding"))
    first = rows.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("h", "embedding").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    distinct = checkpointed(first.groupBy("h", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked = checkpointed(usable(queries).distinct())
    shares: dict[int, float] = {}
    if share is None:
        some = distinct.orderBy("h").limit(SAMPLE_ROWS).select("embedding").toArrow()["embedding"].to_pylist()
        shares = {n: least_share(np.array([e for e in some if len(e) == n]), k) for n in {len(e) for e in some}}
    shards = max(1, -(-distinct.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    dim = F.size("embedding").alias("dim")
    left = distinct.select("embedding", "ids", dim, F.pmod("h", F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select("vec_id", "embedding", dim, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def search(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if index.num_rows and asked.num_rows:
            flat = lambda t: np.asarray(t["embedding"].combine_chunks().flatten()).reshape(t.num_rows, -1)
            x, q = flat(index), flat(asked)
            ids, forest = index["ids"].to_pylist(), Forest(x)
            names = asked["vec_id"].to_pylist()
            for at in range(0, len(q), 1000):
                for i, rows in enumerate(forest.candidates(q[at : at + 1000], wanted(shares.get(x.shape[1], 1.0) if share is None else share, len(x))), at):
                    d = np.sqrt(((x[rows] - q[i]) ** 2).sum(1))
                    near = np.flatnonzero(d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)])
                    best = sorted((d[j], v) for j in near for v in ids[rows[j]] if v != names[i])[:k]
                    out[0].extend([names[i]] * len(best))
                    out[1].extend(v for _, v in best)
                    out[2].extend(float(s) for s, _ in best)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    key = ["dim", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return found.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows.where("vec_id % 100 = 0"), rows)


QUERIES = {"op10_neighbours": op10_neighbours}
ORACLE_SQL: dict[str, str] = {}
