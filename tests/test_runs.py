import time
from pathlib import Path

import pytest

import __spark_entry__
from locutio.operators.evaluate import Scripted
from locutio.plans import queries
from locutio.plans.run import Options, read_cache, run, transcript_facts
from locutio.sources.subtitles import read_files, transcripts
from locutio.streaming import live

FIXTURES = str(Path(__file__).parent / "fixtures")
SF = "/root/testdata/sf0.001"
BACK = '{"causal": true, "contraste": false, "ventana": "corta"}'


def test_whole_run_and_its_cache(spark, tmp_path):
    files = read_files(spark, FIXTURES)
    done = run(files, Scripted([BACK]))
    rows = {r.doc_id: r for r in done.summary.collect()}
    assert len(rows) == 2 and {r.sobre_umbral for r in rows.values()} == {2, 0} and sum(r.total for r in rows.values()) == 7
    done.write(str(tmp_path))
    cache = read_cache(spark, str(tmp_path), "framing-causal")
    again = run(files, Scripted([RuntimeError("x")]), Options(cache=cache))
    assert again.results.where("desde_cache").count() == 2 and read_cache(spark, str(tmp_path / "none"), "x") is None
    tables = ("transcripts", "claims", "results", "summary", "cache")
    counts = lambda: [spark.read.parquet(f"{tmp_path}/{t}").count() for t in tables]
    before = counts()
    run(files, Scripted([BACK])).write(str(tmp_path))
    assert counts() == before
    run(files, Scripted([BACK]), Options(write_cache=False)).write(str(tmp_path / "off"))
    assert not (tmp_path / "off" / "cache").exists()
    open_ = run(files, Scripted([BACK]), Options(use_gate=False))
    recall = {r.doc_id: r for r in open_.recall().collect()}
    assert all(r.recall is not None and r.veredicto == "mejorable" for r in recall.values())
    facts = transcript_facts(transcripts(files)).collect()
    assert {f.n_cues for f in facts} == {7, 5}


def test_keys_that_the_backend_leaves_out_fail(spark):
    from locutio.operators.evaluate import NO_ANSWER, Replay, evaluated

    class Silent(Replay):
        def answers(self, asked, attempt):
            return super().answers(asked, attempt).where("false")

    from locutio.criteria.registry import criterion

    claims = spark.createDataFrame([("d", 0, "a claim because", "es", "x", True), ("e", 0, "no", "es", "x", False)], "doc_id string, id int, texto string, idioma string, idioma_nombre string, preseleccionada boolean")
    said = spark.createDataFrame([], "clave string, intento int, texto string")
    rows = {r.doc_id: r for r in evaluated(claims, criterion("framing-causal"), Silent(said)).collect()}
    assert (rows["d"].error, rows["d"].evaluada, rows["d"].intentos, rows["d"].llamadas) == (NO_ANSWER, False, 3, 0)
    assert rows["e"].motivo_omision and rows["e"].error is None and rows["e"].intentos == 0


@pytest.mark.parametrize("n", [0, 1, 256, 257, 700])
def test_running_sums(spark, n):
    from itertools import accumulate

    from pyspark.sql import functions as F

    from locutio.functions.text import running

    values = [0.1 * (k % 7) for k in range(n)]
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert df.select(running(F.col("v"), F.lit(0.0), "double")).first()[0] == list(accumulate([0.0, *values]))[:-1][:n]


def test_long_document(spark):
    from pyspark.sql import functions as F

    from locutio.operators import segment

    n = 20_000
    cue = lambda i: F.struct((i * 2.0).alias("inicio"), (i * 2.0 + 1.0).alias("fin"), F.concat(F.lit("This is sentence number "), i.cast("string"), F.lit(".")).alias("texto"))
    docs = spark.range(1).select(F.lit("d").alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cue).alias("segmentos"))
    got = segment.claims(docs, None, "en").agg(F.count("*").alias("n"), F.sum("inicio").alias("s"), F.min(F.col("fin") - F.col("inicio")).alias("d")).first()
    assert got.n == n and got.s == n * (n - 1) and 0.9 < got.d <= 1.0


@pytest.mark.parametrize("wrong", [{"threshold": 2}, {"limit": 0}, {"retries": -1}, {"concurrency": 17}])
def test_options(wrong):
    with pytest.raises(ValueError):
        Options(**wrong)


def test_command_line(spark, tmp_path):
    from locutio.__main__ import main

    assert main(["analizar"]) == 2 and main(["nada"]) == 2
    assert main(["analizar", FIXTURES, "--grabado", str(tmp_path / "missing"), "--salida", str(tmp_path / "o")]) == 1
    spark.createDataFrame([("k", 1, BACK)], "clave string, intento int, texto string").write.parquet(str(tmp_path / "said"))
    assert main(["medir-prefiltro", FIXTURES, "--grabado", str(tmp_path / "said"), "--salida", str(tmp_path / "o")]) == 0
    assert main(["analizar", FIXTURES, "--grabado", str(tmp_path / "said"), "--criterio", "x"]) == 2


@pytest.mark.parametrize("name", ["input_kind", "gate_labels", "gate_selectivity", "claims", "pause_sessions", "gate_recall", "causal_verdicts", "report_rows", "offsets", "time_interpolation", "plain_segments", "scripted_run", "csv_export"])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = queries.QUERIES[name](spark, SF)
    if name not in queries.ORACLE_SQL:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in ("documents", "events", "pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    shown = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    key = lambda r: tuple(str(v) for v in r)
    a = sorted((tuple(r) for r in got.select(*names).collect()), key=key)
    b = sorted(want.project(", ".join(f'"{c}"' for c in names)).fetchall(), key=key)
    assert len(a) == len(b) and all(x == y or pytest.approx(x) == y for x, y in zip(a, b)), shown(a[:2])


@pytest.mark.parametrize("name", ["report_rows", "csv_texts"])
def test_clocks_past_99_hours_match_the_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    ids = (359_999, 360_000, 3_600_001, 39_999_999)
    spark.createDataFrame([(k, "all of the talk", "en", "src1", 70) for k in ids], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2, 0) for k in ids], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    names = sorted(got.columns)
    want = con.sql(__spark_entry__.oracle_sql()[name]).project(", ".join(f'"{c}"' for c in names)).fetchall()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(want, key=key)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_extra_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).parents[1]
    shutil.copytree(root / "locutio", tmp_path / "locutio", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(k.startswith('op') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)}).returncode == 0


def stream_of(spark, tmp_path, name, rows, schema):
    """A stream over one file a batch of rows."""
    path = tmp_path / name
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.01 * k)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def collected(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    return df.sparkSession.table(name)


SCHEMA = "doc_id string, inicio double, fin double, texto string, ts timestamp"


def test_streams(spark, tmp_path):
    from datetime import datetime, timedelta

    from locutio.plans.inputs import TEST_GATE

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [[("d", 0.0, 1.0, "of the", at(0)), ("d", 1.2, 2.0, "next words here", at(1))], [("d", 5.0, 6.0, "after a pause", at(5))]]
    cues = stream_of(spark, tmp_path, "cues", rows, SCHEMA)
    assert [r.marcadores for r in collected(live.gated_stream(cues, TEST_GATE), "gated").collect()] == [["of the"]]
    blocks = collected(live.pause_blocks_stream(cues), "blocks").collect()
    assert [(r.bloque, r.inicio, r.fin, r.texto) for r in blocks] == [(0, 0.0, 2.0, "of the next words here")]
    rolling = [[("d", 0.0, 1.0, "we closed the old harbour", at(0)), ("d", 1.0, 2.0, "the old harbour and the boats", at(1))], [("d", 2.0, 3.0, "and the boats moved", at(2))]]
    got = collected(live.without_overlap_stream(stream_of(spark, tmp_path, "rolling", rolling, SCHEMA)), "rolled").orderBy("inicio").collect()
    assert [r.texto for r in got] == ["we closed the old harbour", "and the boats", "moved"]
    keys = stream_of(spark, tmp_path, "keys", [[("a", at(0)), ("a", at(1)), ("b", at(2))]], "clave string, ts timestamp")
    assert sorted(r.clave for r in collected(live.asked_once(keys), "keys").collect()) == ["a", "b"]
    assert live.windows(cues).isStreaming
