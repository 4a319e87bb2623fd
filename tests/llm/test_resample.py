"""Resampling against plain counts, and its parts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("locutio.llm")

from pyspark.sql import functions as F

from locutio.llm import resample
from locutio.llm.sql import CRC_TABLES, crc_of

ROWS = [
    (1, "the answer is seven " * 8), (2, None), (3, ""), (4, "The ANSWER is seven " * 8), (5, "é9 Ünï-code 世界 " * 7), (5, "é9 Ünï-code 世界 " * 7), (None, "no key here " * 10), (6, "w " * 19), (7, "w " * 20), (8, "far " * 400_000),
    *((20 + k, f"plain words of document {k} " * 6) for k in range(60)),
]
TARGET = ["what is the answer", "the answer is seven", None, "", "Seven!"]


def brute(rows, target, buckets=10_000, longest=1, min_words=20, percent=10, seed=2024):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out, fit = [], []
    for k, (i, text) in enumerate(rows):
        w, f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) * n for b, n in Counter(f).items())
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
        if len(w) >= min_words:
            fit.append(k)
    fit.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0]))
    for rank, k in enumerate(fit[: percent * len(fit) // 100], 1):
        out[k][4] = rank
    return sorted(map(tuple, out), key=str)


def frames(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, b"") for r in rows], "doc_id long, text string, bucket int, rank long, stream binary")
    return docs, spark.createDataFrame([(t, 1) for t in TARGET], "text string, n long")


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (2, 97, 50), (3, 1 << 16, 100)])
def test_resampling_equals_plain_counts(spark, longest, buckets, percent):
    rows = ROWS if longest == 1 else [r for r in ROWS if r[0] != 8]
    docs, target = frames(spark, rows)
    got = resample.resample(docs, target, buckets=buckets, longest=longest, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, TARGET, buckets, longest, percent=percent)


def test_no_documents_and_no_target(spark):
    docs, target = frames(spark, ROWS)
    assert resample.resample(docs.limit(0), target).count() == 0
    assert sorted(map(tuple, resample.resample(docs, target.limit(0)).collect()), key=str) == brute(ROWS, [])
    with pytest.raises(ValueError, match="16 bits"):
        resample.streams(docs, buckets=70_000)


def test_blocks_of_any_size_give_the_same(spark):
    docs, _ = frames(spark, ROWS)
    gain = np.arange(10_000)
    got = [sorted(map(tuple, resample.weighed(resample.streams(docs, block=b), gain).collect()), key=str) for b in (1, 100, 1 << 20)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(ROWS)


def test_run_lengths_and_segment_sums():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 50, 999).astype(np.uint16)
    values, n = resample.run_lengths(own)
    assert dict(zip(values.tolist(), n.tolist())) == Counter(own.tolist())
    assert len(resample.run_lengths(own[:0])[0]) == 0
    assert resample.segment_sums(np.array([1, 2, 3, 4]), np.array([0, 2, 2, 4, 4])).tolist() == [0, 3, 0, 7, 0]
    assert resample.segment_sums(np.array([], np.int64), np.array([0, 0])).tolist() == [0, 0]


def test_ranks_go_on_over_partitions(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("score"), (F.col("id") % 3 > 0).alias("fits"))
    got = {r.doc_id: r.rank for r in resample.drawn(rows.repartition(5), 40).collect()}
    order = sorted((i for i in range(2000) if i % 3), key=lambda i: (-(i % 7), i))
    assert got == {i: None for i in range(2000)} | {i: k + 1 for k, i in enumerate(order[: 40 * len(order) // 100])}


def test_crc_in_sql():
    import duckdb

    words = ["", "a", "1:überall", "x" * 300, "世界"]
    rows = duckdb.execute(f"with recursive m as (select unnest(?) as m), {CRC_TABLES} x as ({crc_of('m')}) select * from x", [words]).fetchall()
    assert dict(rows) == {w: zlib.crc32(w.encode()) for w in words if w}


