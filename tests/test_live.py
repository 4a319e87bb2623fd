"""Streams: state that ends, verdicts asked once over restarts, and progress."""

import time
from datetime import datetime, timedelta

import pytest

from locutio.criteria.registry import criterion
from locutio.operators import evaluate
from locutio.operators.evaluate import Replay, Scripted, evaluated
from locutio.plans.run import read_cache
from locutio.streaming import live

CUES = "doc_id string, inicio double, fin double, texto string, ts timestamp"
CLAIMS = "doc_id string, id string, texto string, idioma_nombre string, preseleccionada boolean"
BACK = '{"causal": true, "contraste": false, "ventana": "corta"}'
START = datetime(2024, 1, 1)


def put(spark, path, rows, schema, k):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{k}")


def said(doc, second, text="some words"):
    return (doc, float(second), second + 0.5, text, START + timedelta(seconds=second))


class Counting(Scripted):
    """A backend that remembers the keys it was asked."""

    def __init__(self, script):
        super().__init__(script)
        self.asked = []

    def answers(self, asked, attempt):
        self.asked += [r.clave for r in asked.collect()]
        return super().answers(asked, attempt)


@pytest.fixture
def told(spark):
    events = []
    listener = live.Progress(events.append)
    spark.streams.addListener(listener)
    yield events
    spark.streams.removeListener(listener)


def test_state_is_forgotten_and_progress_is_told(spark, tmp_path, told):
    src = str(tmp_path / "cues")
    # the day after, a cue of another document moves the watermark; two days after, one moves it again
    for k, rows in enumerate([[said("a", 0), said("a", 0.6), said("b", 3)], [said("c", 90_000)], [said("c", 180_000)], [said("c", 270_000)]]):
        put(spark, src, rows, CUES, k)
    cues = spark.readStream.schema(CUES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
    blocks = live.pause_blocks_stream(cues, forgotten=3_600_000)
    q = blocks.writeStream.format("memory").queryName("forgotten").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("forgotten").collect()
    assert ("a", 0, "some words some words") in [(r.doc_id, r.bloque, r.texto) for r in got] and ("b", 0) in [(r.doc_id, r.bloque) for r in got]
    for _ in range(50):
        if any("fin" in e for e in told):
            break
        time.sleep(0.2)
    batches = [e for e in told if e.get("nombre") == "forgotten"]
    assert sum(e["filas"] for e in batches) == 6 and any("fin" in e and e["error"] is None for e in told)
    # c alone is left of three documents
    assert max(e["estado"] for e in batches) >= 2 and batches[-1]["estado"] == 1 and batches[-1]["marca"]


def test_a_key_is_asked_once_over_restarts(spark, tmp_path):
    src, out, cp = (str(tmp_path / k) for k in ("claims", "out", "cp"))
    c = criterion("framing-causal")
    claims = lambda: spark.readStream.schema(CLAIMS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
    put(spark, src, [("a", "1", "it fell because of rain", "x", True), ("a", "2", "nothing here", "x", False)], CLAIMS, 0)
    put(spark, src, [("b", "1", "it fell because of rain", "x", True), ("b", "2", "it rose because of sun", "x", True)], CLAIMS, 1)
    first = Counting([BACK])
    live.evaluated_stream(claims(), c, first, out, cp).awaitTermination()
    assert len(first.asked) == len(set(first.asked)) == 2
    put(spark, src, [("c", "1", "it rose because of sun", "x", True), ("c", "2", "it broke because of wind", "x", True)], CLAIMS, 2)
    second = Counting([BACK])
    live.evaluated_stream(claims(), c, second, out, cp).awaitTermination()
    assert len(second.asked) == 1 and not set(second.asked) & set(first.asked)
    results = spark.read.parquet(f"{out}/results")
    assert results.count() == 6 and results.where("evaluada").count() == 5 and results.where("desde_cache").count() == 2
    assert read_cache(spark, out, c.id).groupBy("clave").count().where("count > 1").count() == 0
    # another checkpoint sees all claims anew, and asks for none
    third = Counting([BACK])
    live.evaluated_stream(claims(), c, third, out, str(tmp_path / "cp2")).awaitTermination()
    assert third.asked == [] and spark.read.parquet(f"{out}/results").count() == 6


def test_progress_of_rounds(spark):
    rows = spark.createDataFrame([("a", "1", "it fell because of rain", "x", True), ("a", "2", "it rose because of sun", "x", True)], CLAIMS)
    heard = []
    keyed = evaluate.keyed(rows, criterion("framing-causal"), "qwen2.5:3b")
    keys = sorted(r.clave for r in keyed.select("clave").collect())
    said_ = spark.createDataFrame([(keys[0], 1, BACK), (keys[1], 1, "no"), (keys[1], 2, BACK)], "clave string, intento int, texto string")
    got = evaluated(rows, criterion("framing-causal"), Replay(said_), progress=heard.append)
    assert got.where("evaluada").count() == 2
    assert [(h["vuelta"], h["preguntadas"], h["listas"]) for h in heard] == [(1, 2, 1), (2, 1, 1), (3, 0, 0)]
