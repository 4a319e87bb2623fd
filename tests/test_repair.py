"""The object inside an answer: the fold against a scan over characters."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locutio.functions.repair import json_object


def scanned(text):
    """Character by character."""
    if text is None:
        return None
    text = re.sub("```(?:json)?", "", text, flags=re.IGNORECASE)
    begin, depth, said, escaped = text.find("{"), 0, False, False
    for i in range(begin, len(text)) if begin >= 0 else ():
        c = text[i]
        if said:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                said = False
        elif c == '"':
            said = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[begin : i + 1]
    return None


SAID = [None, "", "no", "{}", 'x {"a": {"b": {}}} y {"c": 1}', '{"a": "un } falso"} sobra', '{"a": "\\" }"} z', '{"a": 1', '{\\"a\\": "}"}', '```JSON\n{"é🙂": "🙂}"}```', '}{"a\\\\"}', "{" * 50 + "}" * 50 + "}", '{"' + "\\n" * 30_000 + '}"} tail', '{"' + "x" * 300_000 + '"}']
PIECES = st.lists(st.sampled_from([*'{}"\\ax🙂\n', "```json", "```"]), max_size=25).map("".join)


@settings(max_examples=3, deadline=None)
@given(st.lists(PIECES, min_size=400, max_size=400))
def test_the_fold_equals_a_scan(spark, more):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(SAID + more)], "k int, t string")
    got = {r.k: r.found for r in rows.select("k", json_object(F.col("t")).alias("found")).collect()}
    assert got == {k: scanned(t) for k, t in enumerate(SAID + more)}


def test_no_python_in_the_plan(spark):
    from locutio.plans.catalog import QUERIES

    plan = QUERIES["json_extract"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
