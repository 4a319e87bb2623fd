"""The store of speeches: many runs in one folder, reuse by version."""

from pyspark.sql import functions as F

from locutio.operators import store
from locutio.operators.evaluate import Scripted
from locutio.plans import run as runs
from locutio.plans.run import Options, parsed_once, run
from locutio.sources import subtitles

BACK = '{"causal": true, "contraste": false, "ventana": "corta"}'
TALKS = {k: f"Prices rose because of speech number {n} and nobody doubted it.\n\nThe library opens every Monday in winter.\n" for n, k in enumerate("abcd")}


def files(spark, *names):
    return spark.createDataFrame([(n, f"{n}.txt", TALKS[n]) for n in names], "doc_id string, path string, content string")


def tables(spark, path):
    return {t: sorted(map(str, spark.read.parquet(f"{path}/{t}").collect())) for t in ("transcripts", "claims", "results", "summary", "cache")}


def test_two_speeches_stay_and_a_rerun_changes_nothing(spark, tmp_path):
    p = str(tmp_path)
    run(files(spark, "a"), Scripted([BACK])).write(p)
    run(files(spark, "b", "c"), Scripted([BACK]), Options(store=p)).write(p)
    for t in ("transcripts", "claims", "results", "summary"):
        assert {r.doc_id for r in store.read(spark, p, t).select("doc_id").collect()} == {"a", "b", "c"}, t
    before = tables(spark, p)
    run(files(spark, "b"), Scripted([BACK]), Options(store=p)).write(p)
    assert tables(spark, p) == before
    run(files(spark, "a"), Scripted([BACK]), Options(store=p, model="other")).write(p)
    both = store.read(spark, p, "results").groupBy("modelo").agg(F.countDistinct("doc_id").alias("n"))
    assert {r.modelo: r.n for r in both.collect()} == {"qwen2.5:3b": 3, "other": 1}
    s = store.read(spark, p, "summary").where("doc_id = 'a' and modelo = 'other'").first()
    assert s.idiomas == {"Inglés": 2} and s.rendimiento.llamadas == 1 and s.rendimiento.desde_cache == 0


def test_only_old_transcripts_are_parsed_again(spark, tmp_path, monkeypatch):
    p = str(tmp_path)
    run(files(spark, "a", "b"), Scripted([BACK])).write(p)
    asked = []

    def counted(given):
        asked.append(sorted(r.doc_id for r in given.select("doc_id").collect()))
        return subtitles.transcripts(given)

    monkeypatch.setattr(runs, "transcripts", counted)
    three = files(spark, "a", "b", "c")
    got = parsed_once(three, p)
    assert asked == [["c"]] and {r.doc_id for r in got.collect()} == {"a", "b", "c"} and got.where("idioma_documento = 'en' and duracion > 0").count() == 3
    assert parsed_once(three, p, force=True).count() == 3 and asked[-1] == ["a", "b", "c"]
    # a newer parser: what it has made is kept, what is older is parsed again
    monkeypatch.setattr(runs, "PARSER_VERSION", subtitles.PARSER_VERSION + 1)
    newer = run(files(spark, "a"), Scripted([BACK]), Options(store=p))
    newer.transcripts = newer.transcripts.withColumn("version_parseo", F.lit(subtitles.PARSER_VERSION + 1))
    newer.write(p)
    asked.clear()
    parsed_once(three, p)
    assert asked == [["b", "c"]]


def test_a_document_that_loses_its_rows(spark, tmp_path):
    p = str(tmp_path)
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "doc_id string, n int")
    docs = rows.select("doc_id")
    store.upsert(rows, docs, p, "t", {"k": "x:1"}, buckets=1)
    store.upsert(rows.limit(0), docs.where("doc_id = 'b'"), p, "t", {"k": "x:1"}, buckets=1)
    assert [(r.doc_id, r.n) for r in store.read(spark, p, "t").collect()] == [("a", 1)]
    store.upsert(rows.limit(0), docs.where("doc_id = 'a'"), p, "t", {"k": "x:1"}, buckets=1)
    assert store.read(spark, p, "t") is None or store.read(spark, p, "t").count() == 0


def test_forced_runs_ask_again(spark, tmp_path):
    p = str(tmp_path)
    run(files(spark, "a"), Scripted([BACK])).write(p)
    cache = runs.read_cache(spark, p, "framing-causal")
    failing = Scripted([RuntimeError("x")])
    assert run(files(spark, "a"), failing, Options(store=p, cache=cache, retries=0)).results.where("desde_cache").count() == 1
    assert run(files(spark, "a"), failing, Options(store=p, cache=cache, force=True, retries=0)).results.where("error is not null").count() == 1


def test_nothing_stored(spark, tmp_path):
    assert store.read(spark, str(tmp_path / "none"), "x") is None and store.current(None, {}) is None
