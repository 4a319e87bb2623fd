"""Strings that very many documents share, and anchors found by the upper half of a hash."""

import random

import numpy as np

from locutio.llm import suffixes


def test_equal_strings_have_one_anchor_wherever_they_stand():
    rng = random.Random(7)
    said = bytes(rng.choice(b"ab") for _ in range(400))
    data = b"x" * 31 + said + b"y" * 77 + said[3:] + b"ab" * 60
    first, n, h = suffixes.units(np.frombuffer(data, np.uint8))
    assert first[0] == 0 and n.sum() == len(data) - suffixes.LENGTH + 1
    of = np.repeat(h, n)
    by_string: dict[bytes, set] = {}
    for k in range(len(of)):
        by_string.setdefault(data[k : k + suffixes.LENGTH], set()).add(int(of[k]))
    assert all(len(x) == 1 for x in by_string.values())


def test_a_string_of_many_documents_is_joined_in_groups(spark, monkeypatch):
    """The join with the least document of a string has a row for each group of documents; every document still loses the string."""
    monkeypatch.setattr(suffixes, "PARTS", 4)
    monkeypatch.setattr(suffixes, "SAMPLED", 1)
    passage = "".join(random.Random(1).choice("abcdefgh ") for _ in range(90))
    rows = [(k, f"{k:05d} {random.Random(k).random()} {passage}{random.Random(-k).random()} end") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    joined = []
    kept = suffixes.checkpointed

    def seen(df):
        out = kept(df)
        joined.append((set(out.columns), out))
        return out

    monkeypatch.setattr(suffixes, "checkpointed", seen)
    found = {r.doc_id: r.n_removed for r in suffixes.without_repeats(docs).select("doc_id", "n_removed").collect()}
    assert found[0] == 0 and all(found[k] >= 90 for k in range(1, 120)), found
    groups = [df for names, df in joined if {"string", "at"} <= names]
    assert groups and groups[0].groupBy("string").count().agg({"count": "max"}).first()[0] <= 4
