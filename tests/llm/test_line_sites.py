"""Sites whose registers collide in the sketch."""

import random

import pytest

pytest.importorskip("locutio.llm")

from pyspark.sql import functions as F

from locutio.llm import lines


def test_sites_in_one_register_are_counted(spark):
    names = spark.range(40_000).select(F.concat(F.lit("site"), "id").alias("s")).where(F.xxhash64("s").bitwiseAND(lines.REGISTERS - 1) == 3)
    sites = [r.s for r in names.limit(11).collect()]
    rows = [(k * 100 + i, f"line {k} in many places", s) for k, n in enumerate((9, 10, 11)) for i, s in enumerate(sites[:n])] + [(900 + i, "line on one site only", "x") for i in range(30)]
    got = lines.boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(sites) == 11 and sorted(r.keeper for r in got) == [100, 200]


def test_lines_on_just_enough_sites(spark):
    rng = random.Random(4)
    rows = [(k * 10 + i, f"line {k}", f"site{s}") for k in range(400) for i, s in enumerate(rng.sample(range(5000), 10))] + [(9000 + i, f"nine {i % 50}", f"site{i % 50 * 9 + i // 50}") for i in range(450)]
    got = lines.boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r.keeper for r in got) == [k * 10 for k in range(400)]
