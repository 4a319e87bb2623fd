"""Times by the as-of join against times within the row."""

import random

from pyspark.sql import functions as F

from locutio.operators import segment
from locutio.sources.subtitles import CUES


def test_join_equals_the_row_form(spark, monkeypatch):
    rng = random.Random(11)
    docs = []
    for k in range(40):
        now, cues = 0.0, []
        for _ in range(rng.randrange(0, 30)):
            end = now + rng.choice([0.0, 0.5, 2.0, -1.0])
            cues.append((now, end, rng.choice(["", " ", "a", "two  words", "x" * 300, " many more words in a cue "])))
            now = max(now, end) + rng.choice([0.0, 0.3, 5.0])
        docs.append((f"d{k}", cues))
    docs.append(("none", []))
    rows = spark.createDataFrame(docs, f"doc_id string, segmentos {CUES}")
    asked = rows.select("doc_id", "segmentos", F.explode(F.sequence(F.lit(-3), F.lit(700), F.lit(7))).alias("offset"))
    want = {(r.doc_id, r.offset): r.s for r in asked.select("doc_id", "offset", segment.time_at(F.col("offset"), segment.anchors(F.col("segmentos"))).alias("s")).collect()}
    flat = rows.select("doc_id", F.posexplode("segmentos").alias("indice", "c")).select("doc_id", "indice", "c.*")
    for block, width in ((12, 12), (1, 3)):
        monkeypatch.setattr(segment, "BLOCK_BITS", block)
        monkeypatch.setattr(segment, "BIN_BITS", width)
        got = segment.timed_by_join(asked.select("doc_id", "offset", F.lit("x").alias("desde")), segment.placed_cues(flat))
        assert got.columns == ["doc_id", "offset", "desde", "segundos"]
        found = {(r.doc_id, r.offset): r.segundos for r in got.collect()}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_one_document_of_a_million_cues(spark):
    n = 1_000_000
    cues = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").alias("indice"), (F.col("id") * 2.0).alias("inicio"), (F.col("id") * 2.0 + 1).alias("fin"), F.lit("ninechars").alias("texto"))
    points = spark.range(n).select(F.lit("d").alias("doc_id"), (F.col("id") * 10).alias("offset"))
    got = segment.timed_by_join(points, segment.placed_cues(cues)).agg(F.count("*").alias("n"), F.sum("segundos").alias("s")).first()
    assert got.n == n and got.s == n * (n - 1)
