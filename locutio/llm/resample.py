"""Importance resampling towards a target: documents are drawn by how much likelier their features are in the benchmark than in all documents.

Counting is an external sort: one pass writes the features' buckets as packed streams of 16-bit numbers, a block of documents a row, with the offsets at
which documents begin. Each block is sorted and run-length encoded, and the runs are summed by bucket. The gains of all buckets, a table of fixed size,
then go back to the blocks, where a document's weight is a gather and a segmented sum. A range sort of the scores ranks the documents: places in a
sorted partition plus the sizes of the partitions before it, so no task sees all of them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import checkpointed, per_document, table
from .sql import CRC_TABLES, crc_of

BUCKETS, LONGEST = 10_000, 1
MIN_WORDS, PERCENT, SEED = 20, 10, 2024
#: Features of a block, unless a single text has more; rows of a sorted partition, and partitions at most.
BLOCK, SORTED, PARTITIONS = 1 << 20, 500_000, 10_000
#: Texts up to this many bytes are cut into words at once.
AT_ONCE = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str) -> Iterator[bytes]:
    """The words of text in UTF-8, A to Z in lower case: runs of digits, letters a to z and whatever isn't ASCII."""
    data = text.encode().lower()
    return iter(WORD.findall(data)) if len(data) <= AT_ONCE else (m[0] for m in WORD.finditer(data))


def _runs(own: Iterator[bytes], longest: int) -> Iterator[bytes]:
    """All runs of 1 to longest consecutive words, joined by a space."""
    last: deque[bytes] = deque(maxlen=longest)
    for w in own:
        last.append(w)
        run = w
        yield run
        for before in list(last)[-2::-1]:
            run = before + b" " + run
            yield run


def feature_buckets(text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, int]:
    """The bucket of each feature of text as 16-bit numbers, and the number of words."""
    own = words(text)
    hashes = np.fromiter(map(zlib.crc32, own if longest == 1 else _runs(own, longest)), np.uint32)
    n = len(hashes) if longest == 1 else sum(1 for _ in words(text))
    return (hashes % np.uint32(buckets)).astype(np.uint16), n


def streams(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """(doc_ids array<long>, n_words array<long>, ends binary, stream binary) of blocks of documents: stream holds 16-bit buckets, ends where each
    document's are over, as 64-bit numbers."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        ids: list[int | None] = []
        n_words: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def packed() -> tuple:
            ends = np.cumsum([len(x) for x in held], dtype=np.int64)
            return ids, n_words, ends.astype("<i8").tobytes(), np.concatenate(held).astype("<u2").tobytes()

        for doc_id, text in rows:
            own, n = feature_buckets(text or "", buckets, longest)
            ids.append(doc_id)
            n_words.append(n)
            held.append(own)
            size += len(own) + 8
            if size >= block:
                yield packed()
                ids, n_words, held, size = [], [], [], 0
        if ids:
            yield packed()

    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("ends", pa.binary()), ("stream", pa.binary())])
    return per_document(docs.select("doc_id", "text"), kernel, schema, "doc_ids array<long>, n_words array<long>, ends binary, stream binary", rows=1)


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of stream in order and how often each occurs."""
    own = np.sort(stream)
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    return own[at], np.diff(np.concatenate([at, [len(own)]]))


def bucket_counts(blocks: DataFrame) -> DataFrame:
    """(bucket, n) of all blocks' streams."""

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (stream,) in rows:
            values, n = run_lengths(np.frombuffer(stream, "<u2"))
            yield from zip(values.tolist(), n.tolist())

    runs = per_document(blocks.select("stream"), kernel, pa.schema([("bucket", pa.int32()), ("n", pa.int64())]), "bucket int, n long", rows=1 << 14)
    return runs.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket from the two tables of counts; as many numbers as there are buckets reach the driver."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    s, t = [0] * buckets, [0] * buckets
    for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t)], np.int64)


def segment_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive ends, the first from 0; empty stretches are 0."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out = np.zeros(len(ends), np.int64)
    own = starts < ends
    if own.any():
        out[own] = np.add.reduceat(values, starts[own])
    return out


def weighed(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document of blocks."""

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for ids, n_words, ends, stream in rows:
            at = np.frombuffer(ends, "<i8")
            yield from zip(ids, n_words, np.diff(at, prepend=0).tolist(), segment_sums(gain[np.frombuffer(stream, "<u2")], at).tolist())

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
    return per_document(blocks, kernel, schema, "doc_id long, n_words long, n_features long, weight long", rows=1 << 14)


def drawn(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """scored (doc_id, fits, score, ...) plus rank: of the N rows that fit, floor(percent * N / 100) with the highest score, ties to the smaller doc_id,
    have ranks from 1, all others null. Read more than once, so scored should be a table."""
    spark = scored.sparkSession
    size = scored.agg(F.count("*").alias("n"), F.count_if("fits").alias("fit")).first()
    n = min(PARTITIONS, max(8, -(-size["n"] // SORTED)))
    order = [F.col("fits").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # a row's number tells its partition, from the 33rd bit on, and its place there
    placed = checkpointed(scored.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, nth = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, total = [], 0
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        before.append((r["part"], total))
        total += r["n"]
    sizes = spark.createDataFrame(before, "_part long, _before long")
    rank = F.col("_before") + nth + 1
    found = placed.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return found.select(*scored.columns, F.when(F.col("fits") & (rank <= percent * size["fit"] // 100), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs; target has a column text.

    Null and empty texts have no features and weight 0. Each row is a document, so rows that repeat share their score and take ranks of their own. A row
    without a doc_id is scored as if it were empty and loses ties. Without documents there are no rows; an empty target leaves only the corpus'
    counts to tell features apart. Other columns aren't read.
    """
    blocks = checkpointed(streams(docs, buckets, longest))
    gain = gains(bucket_counts(blocks), bucket_counts(streams(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), buckets, longest)), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(float(1 << 32)))))
    rows = weighed(blocks, gain).select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= min_words).alias("fits"))
    return drawn(checkpointed(rows), percent).select("doc_id", "n_features", "weight", "score", "rank")


def op13_resample(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_resample": op13_resample}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op13_resample": f"""
with recursive d as (select doc_id, {_WORDS} as words from documents),
dw as (select doc_id, unnest(words) as w from d),
bw as (select unnest({_WORDS}) as w from benchmark),
m as (select distinct w as m from (select w from dw union all select w from bw)),
{CRC_TABLES}
b as (select m as w, crc % 10000 as bucket from ({crc_of("m")})),
s as (select bucket, count(*) as s from dw join b using (w) group by 1),
t as (select bucket, count(*) as t from bw join b using (w) group by 1),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from dw) + 10000) / ((coalesce(s, 0) + 1)::double * ((select count(*) from bw) + 10000))))::bigint as gain
      from s full join t using (bucket)),
f as (select doc_id, sum(gain) as weight from dw join b using (w) join g using (bucket) group by 1),
x as (select d.doc_id, len(words) as n_features, coalesce(weight, 0)::bigint as weight,
             ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint as h from d left join f on d.doc_id = f.doc_id),
y as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::double)))::bigint as score from x),
z as (select doc_id, row_number() over (order by score desc, doc_id) as r from y where n_features >= 20)
select y.doc_id, n_features, weight, score, case when r <= (select count(*) * 10 // 100 from z) then r end as rank from y left join z on y.doc_id = z.doc_id
"""
}
