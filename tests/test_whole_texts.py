"""Queries over the test tables read whole texts."""

import random
import re

from locutio.plans import inputs, queries


def test_verdicts_gate_whole_texts(spark, tmp_path):
    far = "xyz " * 100
    texts = {1: far + "of the end", 2: far, 3: "that is near", 4: far + "y que la casa", 5: None}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = {i: {e.label for e in inputs.TEST_ENTRIES if re.search(rf"(?<![a-z]){e.pattern}(?![a-z])", t or "")} for i, t in texts.items()}
    got = inputs.verdicts(spark, str(tmp_path)).collect()
    assert {r.doc_id: set(r.marcadores or ()) for r in got} == want and {r.doc_id for r in got if r.preseleccionada} == {1, 3, 4}


def test_overlap_reads_every_pair_of_cues(spark, tmp_path):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice(["A,", "b", "c!", "-", "D"]) for _ in range(n)) for i, n in enumerate([0, 1, 12, 13, 30, 95, 200, 201])} | {20: None, 21: " x  y\nz " * 30}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, t in texts.items():
        w, move = (t or "").split(), 8 if i % 2 == 0 else 12
        said = [[re.sub(r"[^a-z]", "", x.lower()) for x in w[at : at + 12]] for at in range(0, len(w), move)]
        for k, (a, b) in enumerate(zip(said, said[1:]), 1):
            want[i, k] = max((n for n in range(2, min(len(a), len(b)) + 1) if a[-n:] == b[:n]), default=0)
    assert {(r.doc_id, r.k): r.n for r in queries.overlap(spark, str(tmp_path)).collect()} == want and any(n for (_, k), n in want.items() if k > 6)
