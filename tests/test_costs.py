"""Steps whose cost a text must not pay more often than needed, by what their plans hold."""

import re

from pyspark.sql import functions as F

from locutio.functions.languages import FUNCTION_WORDS, candidates
from locutio.functions.text import let


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_function_words_are_sought_in_one_pass(spark):
    texts = ["The house of the king is on the hill and it was not for the men.", "la casa de la reina es un lugar que no se ve", "der die das und les des", "", "thes offe", "été le là-bas l'un és não É o mais dos foi que"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    out = df.select("t", candidates(F.col("t")).alias("c"))
    assert len(re.findall("regexp_(?:extract_all|count)", _plan(out))) == 1
    for t, c in out.collect():
        runs = re.findall(r"[^\W\d_]+", (t or "").lower())
        n = {code: sum(w in words for w in runs) for code, words in FUNCTION_WORDS.items()}
        want = sorted((code for code in n if n[code]), key=lambda k: (-n[k], k))[:6] if len((t or "").strip()) >= 20 else []
        assert c == want, t


def test_a_bound_value_is_taken_without_its_type(spark):
    df = spark.range(3).select(let(F.col("id") + 1, lambda x: let(x * 2, lambda y: F.struct(x.alias("x"), y.alias("y")))).alias("z"), let(F.lit(None).cast("long"), lambda x: x).alias("none"))
    assert "getarrayitem" not in _plan(df) and ")[0]" not in _plan(df)
    assert [(r.z.x, r.z.y, r.none) for r in df.collect()] == [(1, 2, None), (2, 4, None), (3, 6, None)]
