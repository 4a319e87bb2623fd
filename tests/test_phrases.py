"""The gate as a join against the gate as a regular expression."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from locutio.criteria.registry import all_criteria
from locutio.functions.text import normalise
from locutio.operators import phrases
from locutio.operators.lexicon import Entry, Gate

ODD = Gate([Entry("ee.uu", "EE.UU", "es"), Entry("d'apres", "d'après", "fr"), Entry("10 por ciento", "10 %", "es"), Entry("a b", "ab", "es"), Entry("a", "a", "es"), Entry("a-b", "a-b", "es"), Entry("b.", "b.", "es"), Entry("a", "again", "es")])
LEX = "ord int, patron string, etiqueta string"


def texts(gate, n=400):
    rng = random.Random(n)
    words = [w for e in gate.entries for w in e.pattern.split(" ")] + ["x", "ab", "Á", "d’Après", "10", "1", "por", ".", ",", "EE.UU.", "'", "a-b-c", "b.", "日本"]
    return [(k, rng.choice([" ", "  ", "", "\n"]).join(rng.choice(words) + rng.choice(["", "", " ", ".", "-", "7", "\t"]) for _ in range(rng.randrange(14)))) for k in range(n)] + [(n, None), (n + 1, ""), (n + 2, " "), (n + 3, "A b"), (n + 3, "A b")]


@pytest.mark.parametrize("gate", [ODD, *(c.gate for c in all_criteria())], ids=["odd", "first", "second"])
@pytest.mark.parametrize("limit", [phrases.BROADCAST_BYTES, 0])
def test_the_join_equals_the_regular_expressions(spark, gate, limit):
    rows = spark.createDataFrame(texts(gate), "ord long, texto string")
    got = phrases.marked(rows, gate.frame(spark, "c"), broadcast_bytes=limit).collect()
    tests = [(e.label, regex.compile(rf"(?<!\p{{L}}){regex.escape(e.pattern)}(?!\p{{L}})")) for e in gate.entries]
    want = [(r.ord, list(dict.fromkeys(label for label, test in tests if test.search(r.n or "")))) for r in rows.select("ord", normalise(F.col("texto")).alias("n")).collect()]
    assert sorted((r.ord, r.marcadores, r.preseleccionada) for r in got) == sorted((i, m, bool(m)) for i, m in want)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_lexicon_of_a_hundred_thousand_patterns(spark):
    lexicon = spark.range(100_000).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("term "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("patron"))
    lexicon = lexicon.withColumn("etiqueta", F.upper("patron"))
    rows = spark.createDataFrame([(1, "a Term bcd, and a term jjjjj"), (2, "term zz"), (3, "longterm bcd")], "doc_id long, texto string")
    found = phrases.hits(rows, lexicon, ["doc_id"])
    assert [(r.doc_id, r.marcadores) for r in found.collect()] == [(1, ["TERM BCD", "TERM JJJJJ"])]
    assert "BroadcastHashJoin" in plan(found) and "CartesianProduct" not in plan(found) and "NestedLoop" not in plan(found)
    assert "ShuffledHashJoin" in plan(phrases.hits(rows, lexicon, ["doc_id"], broadcast_bytes=0)) or "SortMergeJoin" in plan(phrases.hits(rows, lexicon, ["doc_id"], broadcast_bytes=0))


def test_no_lexicon_and_no_texts(spark):
    rows = spark.createDataFrame([(1, "a b")], "doc_id long, texto string")
    empty = spark.createDataFrame([(0, " ", "blank")], LEX)
    assert [tuple(r) for r in phrases.marked(rows, empty).collect()] == [(1, "a b", [], False)]
    assert phrases.marked(rows.limit(0), ODD.frame(spark, "c")).count() == 0
