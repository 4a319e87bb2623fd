import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from locutio.functions import languages, text
from locutio.operators import segment
from locutio.sources import subtitles

FIXTURES = Path(__file__).parent / "fixtures"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def cues_of(spark, content, f=subtitles.subtitle_cues):
    return spark.createDataFrame([(content,)], "c string").select(f(F.col("c")).alias("v")).first()["v"]


def test_clock_and_seconds(spark):
    s = lambda x: value(spark, text.seconds(F.lit(x)))
    assert [s(x) for x in ("00:01:02,340", "01:02.340", "x:1", "3725")] == [62.34, 62.34, 0.0, 3725.0]
    c = lambda x: value(spark, text.clock(F.lit(x)))
    assert [c(x) for x in (3725.4, -1.0, float("nan"), float("inf"), 360000.0)] == ["01:02:05", "00:00:00", "00:00:00", "00:00:00", "100:00:00"]


@pytest.mark.parametrize(("x", "digits", "want"), [(1.005, 2, 1.0), (2.675, 2, 2.67), (0.125, 2, 0.13), (0.375, 2, 0.38), (1234.5678, 2, 1234.57), (0.0625, 3, 0.063), (10.25, 1, 10.3)])
def test_fixed_rounds_the_binary_value(spark, x, digits, want):
    assert value(spark, text.fixed(F.lit(x), digits)) == want


def test_normalise_and_ids(spark):
    assert value(spark, text.normalise(F.lit("Él  PROVOCÓ\tque ‘eso’ ñandú ç Ü"))) == "el provoco que 'eso' nandu c u"
    assert value(spark, text.claim_id(F.lit(7))) == "a0007" and value(spark, text.claim_id(F.lit(12345))) == "a12345"
    assert value(spark, text.percent(F.lit(0.5))) == " 50%" and value(spark, text.percent(F.lit(None).cast("double"))) == " n/d"
    assert value(spark, text.script_safe(F.lit("a b</script> "))) == "a b\\u003c/script\\u003e\\u2028"
    assert value(spark, text.clean_line(F.lit(" <c.x>Hola</c> <00:00:02.000>mundo &amp;lt; {\\an8}"))) == "Hola mundo <"


def test_srt(spark):
    cues = cues_of(spark, (FIXTURES / "speech_es.srt").read_text(encoding="utf-8"))
    assert len(cues) == 7 and cues[3].inicio == 13.5 and cues[4].texto.endswith("doscientas en bote.")
    assert not spark.createDataFrame([(cues,)], f"c {subtitles.CUES}").select(subtitles.looks_rolling(F.col("c"))).first()[0]


def test_styled_and_repeated_cues(spark):
    vtt = "﻿WEBVTT\r\n\r\n00:00:01.000 --> 00:00:03.000\r\n<c.colorE5E5E5>Hola</c> <00:00:02.000>mundo\r\n\r\n00:00:03.000 --> 00:00:05.000\r\nHola mundo\r\n\r\n00:00:09.000 --> 00:00:06.000\r\nuno\r\nuno\r\ndos\r\n"
    assert [tuple(c) for c in cues_of(spark, vtt)] == [(1.0, 5.0, "Hola mundo"), (9.0, 9.0, "uno dos")]
    assert cues_of(spark, "") == [] and cues_of(spark, "no times here") == []


def test_rolling_captions(spark):
    cues = cues_of(spark, (FIXTURES / "rolling_en.vtt").read_text(), lambda c: subtitles.repaired(subtitles.subtitle_cues(c)))
    said = " ".join(c.texto for c in cues)
    assert said == "last winter we closed the old harbour and the boats moved to the north where the water is deeper and cold"
    assert len(cues) == 5 and cues[-1].fin == 12.0 and all(a.inicio <= b.inicio for a, b in zip(cues, cues[1:]))


def test_overlap(spark):
    o = lambda a, b: value(spark, subtitles.overlap_length(F.lit(a), F.lit(b)))
    assert o("we closed Joe's old harbour", "joes old harbour and more") == 3
    assert o("the ferry left before noon", "two cranes stood idle") == 0 and o("a", "a") == 0 and o("", "") == 0
    assert o("x y x y", "x y x y z") == 4


def test_plain_and_marked_text(spark):
    plain = cues_of(spark, "uno dos tres cuatro cinco\n\n  seis  \n\n\nsiete", subtitles.plain_cues)
    assert [(c.inicio, c.fin, c.texto) for c in plain] == [(0.0, 2.0, "uno dos tres cuatro cinco"), (2.0, 3.0, "seis"), (3.0, 4.0, "siete")]
    marked = cues_of(spark, "[00:00:05] uno\nnada\n00:10 - dos\n(00:20) tres cuatro cinco", subtitles.marked_cues)
    assert [(c.inicio, c.fin, c.texto) for c in marked] == [(5.0, 10.0, "uno"), (10.0, 20.0, "dos"), (20.0, 21.2, "tres cuatro cinco")]
    assert cues_of(spark, "[00:00:05] uno\n[00:00:06] dos", subtitles.marked_cues) == []


def test_readers_dispatch(spark):
    rows = [("a", "x.SRT", (FIXTURES / "speech_es.srt").read_text(encoding="utf-8")), ("b", "y.txt", "hola a todos"), ("c", "z.vtt", "nothing"), ("d", "w.md", ""), ("e", "v.txt", "[0:01] a\n[0:02] b\n[0:03] c")]
    got = {r.doc_id: r for r in subtitles.transcripts(spark.createDataFrame(rows, "doc_id string, path string, content string")).collect()}
    assert [(got[k].motor, len(got[k].segmentos), got[k].timestamps_reales) for k in "abe"] == [("srt", 7, True), ("texto", 1, False), ("texto-con-marcas", 3, True)]
    assert got["c"].problema and got["d"].problema == "esta vacio" and got["a"].problema is None
    files = subtitles.read_files(spark, str(FIXTURES))
    assert files.count() == 2 and all(len(r.doc_id) == 12 for r in files.collect())


def test_link_metadata(spark):
    got = value(spark, subtitles.link_tracks(F.lit('{"language": "en", "subtitles": {"en-US": [{"x": 1}]}, "automatic_captions": {"en-orig": [], "es": []}}')))
    assert (got.idioma, got.publicados, got.automaticos) == ("en", ["en-US"], ["en-orig", "es"])
    assert value(spark, subtitles.link_tracks(F.lit("{"))) is None


def test_asr_chunks(spark):
    chunks = "array<struct<desde:double,hasta:double,texto:string>>"
    df = spark.createDataFrame([([(0.0, None, " uno  dos "), (3.0, None, ""), (4.0, None, "tres")], 7.0, "x"), ([], 7.0, " todo ")], f"c {chunks}, d double, t string")
    got = [[tuple(c) for c in r.v] for r in df.select(subtitles.asr_cues(F.col("c"), F.col("d"), F.col("t")).alias("v")).collect()]
    assert got == [[(0.0, 4.0, "uno dos"), (4.0, 7.0, "tres")], [(0.0, 7.0, "todo")]]


def sentence_scan(s):
    """Sentences by walking over the characters."""
    import re

    out, start, i = [], 0, 0
    while i < len(s):
        if s[i] in ".!?…":
            j = i
            while j + 1 < len(s) and s[j + 1] in '.!?…"”»)':
                j += 1
            ends = j + 1 >= len(s) or s[j + 1].isspace()
            if ends and s[i] == ".":
                word = re.search(r"(?:[^\W\d_]|\.)*$", s[max(0, i - 12) : i])[0]
                bare = word.lower()[:-1] if word.endswith(".") else word.lower()
                if bare in segment.ABBREVIATIONS or (len(word) == 1 and word.isupper()):
                    ends = False
            if ends:
                out.append(s[start : j + 1])
                start = j + 1
                while start < len(s) and s[start].isspace():
                    start += 1
                i = start
                continue
        i += 1
    return out + ([s[start:]] if start < len(s) else [])


def test_sentences(spark):
    import random

    rng = random.Random(7)
    parts = ["El Sr. Pérez vino.", "¿Qué? Nada…", "J. Smith said no. Luego", "ee.uu. crece!", 'dijo "basta." Y', "3.5 puntos", "un no. Mar abierto.", "fin?!", "etc. y más", "(cierto.) sí", "A. B. c.", "palabra"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", segment.sentences(F.col("t")).alias("s")).collect()
    for r in rows:
        assert "".join(r.s) == r.t
        assert [x.rstrip(" ") for x in r.s if x] == sentence_scan(r.t)


def piece_scan(s, most):
    out, at = [], 0
    while len(s) - at > most:
        idx = s[at : at + most].rfind(" ")
        cut = at + idx + 1 if idx > most * 0.4 else at + most
        out.append(s[at:cut])
        at = cut
        while at < len(s) and s[at] == " ":
            at += 1
    return out + ([s[at:]] if at < len(s) else [])


@pytest.mark.parametrize("most", [420, 240])
def test_pieces(spark, most):
    import random

    rng = random.Random(most)
    texts = [" ".join("x" * rng.choice([1, 3, 9, 30, 300]) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", segment.divided(F.array("t"), most, True).alias("s")).collect()
    for r in rows:
        assert "".join(x.texto for x in r.s) == r.t and [x.texto[: x.n] for x in r.s] == piece_scan(r.t, most)


def test_claims_of_a_subtitle_file(spark):
    from locutio.criteria.registry import criterion

    docs = spark.createDataFrame([("es", "x.srt", (FIXTURES / "speech_es.srt").read_text(encoding="utf-8")), ("none", "x.srt", "")], "doc_id string, path string, content string")
    got = segment.claims(subtitles.transcripts(docs).select("doc_id", "segmentos"), criterion().gate).orderBy("indice").collect()
    assert [r.id for r in got] == [f"a{k:04d}" for k in range(6)] and got[1].texto == "Vamos a hablar de los puentes del río y de quienes los cruzan cada mañana."
    assert all(r.inicio <= r.fin for r in got) and all(a.inicio <= b.inicio for a, b in zip(got, got[1:])) and got[-1].fin <= 37
    assert [r.marcadores for r in got] == [[], [], ["por culpa de", "culpa de"], [], ["consecuencia directa"], []] and {r.idioma for r in got} == {"es"}
    assert got[0].inicio == 0.0 and got[2].inicio == 13.5 and got[5].inicio == 32.0


def test_claims_without_punctuation_split_at_pauses(spark):
    cues = [(0.0, 3.0, "abrieron el canal en marzo y los barcos volvieron al puerto viejo"), (4.5, 7.1, "los vecinos llevaban once inviernos esperando ese dia con paciencia"), (8.0, 10.6, "el domingo habra una feria junto al muelle con musica y comida"), (12.3, 15.0, "y despues se repartiran los puestos entre las familias del barrio")]
    docs = spark.createDataFrame([("a", cues), ("b", [])], f"doc_id string, segmentos {subtitles.CUES}")
    got = segment.claims(docs, None, "es").orderBy("indice").collect()
    assert len(got) == 4 and [r.inicio for r in got] == [0.0, 4.5, 8.0, 12.3] and [r.fin for r in got[:3]] == [4.5, 8.0, 12.3] and not any(r.preseleccionada for r in got)


def test_language(spark):
    d = lambda s: value(spark, languages.detected(F.lit(s)))
    assert d("El precio de la casa y de los campos no es el que se dijo por la radio") == "es"
    assert d("The price of the house is not what it was on the radio that day") == "en" and d("short") == "und"
    assert value(spark, languages.two_letters(F.lit("spa"))) == "es" and value(spark, languages.language_name(F.lit("xx"))) == "XX"


def test_overlap_of_many_words_equals_trying_each(spark):
    rng = random.Random(8)
    rows = []
    for k in range(120):
        x = [rng.choice("ab" if k % 2 else "abcdefgh") for _ in range(rng.randrange(0, 150))]
        n = rng.randrange(0, len(x) + 1)
        rows.append((k, x, x[len(x) - n :] + [rng.choice("abz") for _ in range(rng.randrange(0, 90))]))
    rows += [(200, ["a"] * 300, ["a"] * 299 + ["b"]), (201, [], ["a"]), (202, ["a", "b"] * 100, ["b", "a"] * 90)]
    df = spark.createDataFrame(rows, "k int, x array<string>, y array<string>")
    got = df.select("k", subtitles.overlap_of(F.col("x"), F.col("y")).alias("n"), subtitles._overlap_of_many(F.col("x"), F.col("y")).alias("m")).collect()
    want = {k: next((n for n in range(min(len(x), len(y)), 1, -1) if x[-n:] == y[:n]), 0) for k, x, y in rows}
    assert {r.k: r.n for r in got} == {r.k: r.m for r in got} == want


def test_unsupported_files_have_a_problem_and_no_cues(spark):
    files = spark.createDataFrame([("1", "a.mp3", "words here\n\nmore"), ("2", "b.PDF", "words"), ("3", "c.MD", "words"), ("4", "noextension", "words")], "doc_id string, path string, content string")
    got = {r.doc_id: r for r in subtitles.transcripts(files).collect()}
    assert [len(got[k].segmentos) for k in "1234"] == [0, 0, 1, 0] and [got[k].motor for k in "1234"] == ["medio", None, "texto", None]
    assert all("srt" in got[k].problema for k in "124") and got["3"].problema is None


def test_files_of_any_case_are_read(spark, tmp_path):
    for name in ("a.SRT", "b.Txt", "c.md", "d.mp3"):
        (tmp_path / name).write_text("1\n00:00:01,000 --> 00:00:02,000\nwords\n")
    assert sorted(r.path for r in subtitles.read_files(spark, str(tmp_path)).collect()) == ["a.SRT", "b.Txt", "c.md"]


def test_the_package_can_be_sent(tmp_path):
    import zipfile

    from locutio import package

    names = zipfile.ZipFile(package.archive(str(tmp_path))).namelist()
    assert "locutio/__init__.py" in names and "locutio/sources/audio.py" in names and all(n.endswith(".py") for n in names)
