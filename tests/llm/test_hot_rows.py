"""Strings of hot anchors: rows are marked where they are, and none is made for each document that repeats one."""

import hashlib
import random

import numpy as np

from locutio.llm import suffixes


def _plain(texts: dict[int, bytes]) -> dict[int, tuple]:
    first: dict[bytes, int] = {}
    for k in sorted(texts):
        for p in range(len(texts[k]) - suffixes.LENGTH + 1):
            first.setdefault(texts[k][p : p + suffixes.LENGTH], k)
    out = {}
    for k, t in texts.items():
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - suffixes.LENGTH + 1):
            if first[t[p : p + suffixes.LENGTH]] < k:
                gone[p : p + suffixes.LENGTH] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        out[k] = (len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_no_row_is_made_for_each_document_of_a_string(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PARTS", 4)
    monkeypatch.setattr(suffixes, "SAMPLED", 1)
    rng = random.Random(3)
    said = "".join(rng.choice("abcdefgh ") for _ in range(160))
    texts = {}
    for k in range(150):
        p = rng.randrange(160)
        # near copies, whose units differ around one letter, some of them with a string that repeats inside the document
        texts[k] = f"{said[:p]}{rng.choice('XYZ')}{said[p + 1:]}{said[:70] if k % 7 == 0 else ''}{'z' * (60 if k % 11 == 0 else 0)}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = suffixes.without_repeats(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found.collect()}
    assert got == _plain({k: t.encode() for k, t in texts.items()})
