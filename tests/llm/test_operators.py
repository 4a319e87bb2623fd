"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables and extra columns; the pipeline against brute force."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("locutio.llm")

from locutio.llm import decontaminate, language, licenses, lines, neighbours, packing, simhash, suffixes, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, line long, n long, h long, bucket int, listed boolean, rank int, u long"
LONG = "lang wort " * 30_000
ROWS = [
    (1, "the cat sat on the mat and looked at the bird in the tall green tree by the lake", "en"), (2, None, "en"), (3, "", None), (4, "the cat sat on the mat and looked at the bird in the tall green tree by the lake", "en"),
    (5, " \n\t ", "de"), (6, LONG, "de"), (7, "der Hund und die Katze gehen nicht in den Wald", "de"), (7, "der Hund und die Katze gehen nicht in den Wald", "de"), (None, "kein Schlüssel hier", "de"), (8, "12345 !!", "en"),
    (9, "Released under the MIT License.", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, 2, 3, 4, 5, True, 6, 7) for i, t, lang in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (7, 1, 0), (7, 1, 0), (None, 1, 1), (9, None, 1)], "doc_id long, quality int, toxic int")


def test_simhash(spark, docs):
    got = {(r.doc_id, bytes(r.fp).hex()): r.component_id for r in simhash.near_duplicates(docs).collect()}
    by_id = {i: c for (i, _), c in got.items()}
    assert by_id[4] == by_id[1] == 1 and by_id[2] == by_id[3] == by_id[5] == 2 and by_id[None] is None and by_id[7] == 7
    assert (2, "0" * 16) in got
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 5, 6, 7, 7, 8, 9] and kept.where("doc_id is null").count() == 1


def test_near_copies_at_four_fifths(spark):
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    rows, want = [], {}
    for g in range(30):
        base = words(300)
        rows.append((g * 10, " ".join(base)))
        copy = list(base)
        for at in (40, 120, 200):
            copy[at] = "changed"
        rows.append((g * 10 + 1, " ".join(copy)))
        rows.append((g * 10 + 2, " ".join(words(300))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicated(df).collect()}
    assert {i for i in kept if i % 10 == 2} == {g * 10 + 2 for g in range(30)} and {i for i in kept if i % 10 == 0} == {g * 10 for g in range(30)}
    assert len([i for i in kept if i % 10 == 1]) <= 1, want


def test_language(spark, docs):
    got = language.identified(docs, docs.select("lang", "text")).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and by_id[2].lang_pred == by_id[3].lang_pred == by_id[8].lang_pred == "und" and by_id[1].lang_pred == "en" and by_id[7].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language.identified(docs, docs.limit(0)).collect()} == {"und"}


@pytest.mark.parametrize("hot", ["sampled", "every", "none"])
def test_suffixes_against_brute_force(spark, docs, hot, monkeypatch):
    """With hot anchors as the sample finds them, with every anchor hot, and with none."""
    if hot == "every":
        monkeypatch.setattr(suffixes, "SAMPLED", 1), monkeypatch.setattr(suffixes, "LEAST", 0), monkeypatch.setattr(suffixes, "HOT", 1 << 40), monkeypatch.setattr(suffixes, "PARTS", 3)
    if hot == "none":
        monkeypatch.setattr(suffixes, "LEAST", 1 << 40), monkeypatch.setattr(suffixes, "CHUNK", 1000)
    rng = np.random.default_rng(1)
    alphabet = np.frombuffer("abcdefgh é".encode()[:9], np.uint8)
    parts = [bytes(rng.choice(alphabet, rng.integers(20, 200))).decode() for _ in range(12)]
    rows = [(int(i), "".join(parts[k] for k in rng.integers(0, 12, rng.integers(1, 6)))) for i in rng.permutation(60)] + [(100, "a" * 400), (101, "a" * 300), (102, "é" * 60), (103, "é" * 60), (104, None), (105, ""), (106, "x" * 49)]
    twice = [(300, parts[0] + parts[1] * 3), (300, "b" + parts[0] * 2), (300, "b" + parts[0] * 2), (None, parts[0] * 3)]
    found = suffixes.without_repeats(spark.createDataFrame([(*r, 1) for r in rows + twice], "doc_id long, text string, row int")).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows) + 4 and got[None].n_removed == 0
    assert len({(r.n_bytes, r.n_removed, bytes(r.kept)) for r in found if r.doc_id == 300}) == 2
    least: dict[bytes, int] = {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if least.setdefault(raw[p : p + 50], i) < i:
                gone[p : p + 50] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(raw), int(gone.sum()), spans, kept), i
    assert suffixes.without_repeats(docs).count() == len(ROWS)
    assert suffixes.without_repeats(docs.limit(0)).count() == 0


def test_toxicity(spark, docs, labels):
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == len(ROWS) and not any(r.flagged for r in got if r.doc_id in (2, 3, 5, 8))
    assert not any(r.flagged or r.toxic for r in toxicity.scored(docs, labels.limit(0)).collect())
    kept = toxicity.without_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert toxicity.scored(docs.limit(0), labels).count() == 0


def test_packing(spark, docs):
    got = packing.pack(docs).collect()
    assert {r.doc_id for r in got} == {i for i, _, _ in ROWS}
    filled: dict[int, list] = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in filled.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 6)
    assert len(long) > 10 and all(n == 2048 for _, _, n in long[1:]) and [s for _, s, _ in long] == [sum(n for _, _, n in long[:k]) for k in range(len(long))]
    assert [r.length for r in got if r.doc_id in (2, 3)] == [1, 1]
    assert packing.pack(docs.limit(0)).count() == 0


def test_lines_both_ways(spark, docs):
    rows = [(i, f"own line number {i}\nthe very same footer line\nshort one\n the very same footer line", f"s{i % 12}") for i in range(40)] + [(50, None, None), (51, "", "s1"), (52, "only twice seen line", "s1"), (53, "only twice seen line", "s2"), (None, "the very same footer line\nkept", "s3"), (None, "short one", None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, n_chars long")
    shown = lambda found: sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found.collect()), key=str)
    both = shown(lines.without_boilerplate(df)), shown(lines.without_boilerplate(df, broadcast_lines=0))
    a = {r[0]: r[1:] for r in both[0]}
    assert both[0] == both[1] and a[0] == ("own line number 0\nthe very same footer line\nshort one", 4, 1) and a[7] == ("own line number 7", 4, 3)
    assert [r[1:] for r in both[0] if r[0] is None] == [("", 1, 1), ("kept", 2, 1)]
    assert a[50] == (None, 0, 0) and a[51] == ("", 1, 0) and a[53][2] == 0
    assert lines.without_boilerplate(docs).count() == len(ROWS) and lines.without_boilerplate(docs.limit(0)).count() == 0
    assert lines.deduplicated(docs).columns == docs.columns


def test_sketches_near_the_threshold_are_exact(spark):
    rows = [(k * 100 + s, f"line {k} in many places", f"site{s}") for k in range(60) for s in range(5 + k % 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert lines.boilerplate(df, 10).count() == sum(1 for k in range(60) if 5 + k % 10 >= 10)


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and looked at the bird in the tall green tree"), (2, None), (3, "")], "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontaminate.contaminated(docs, bench).collect()}
    assert got[1] == got[4] == [1] and got[7] == [] and got[2] == []
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {i for i, _, _ in ROWS} - {1, 4}
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(ROWS)
    old, decontaminate.BROADCAST_ROWS = decontaminate.BROADCAST_ROWS, 0
    try:
        more = bench.unionByName(spark.createDataFrame([(9, "der Hund und die Katze gehen nicht")], "item_id long, text string"))
        got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontaminate.contaminated(docs, more).collect()}
        assert got[1] == [1] and got[7] == [9]
    finally:
        decontaminate.BROADCAST_ROWS = old


def test_licenses(spark, docs):
    got = licenses.scanned(docs).collect()
    assert [(r.doc_id, r.license, r.confirmed) for r in got] == [(9, "MIT-notice", True)]
    assert licenses.scanned(docs.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, "http://a.example.org/es/x"), (2, "https://example.org/en/12?q"), (3, "http://EXAMPLE.org/en/2"), (4, "http://x.com/fr/1"), (5, "http://x.com/de/1#f"), (6, None), (7, "no scheme"), (8, "http://dup.net/a/"), (9, "https://www.dup.net/a.html?x"), (10, "http://one.net/b"), (11, "http://badexample.org"), (8, "http://dup.net/a/")]
    pages = spark.createDataFrame([(i, u, 5) for i, u in rows], "page_id long, url string, block int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages, urls.mirrored(pages)).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block") and got[3] == ("example.org", "/en/2", "org/", "allow")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block") and got[6] == got[7] == ("", "", None, "allow")
    assert got[8][3] == got[9][3] == "block" and got[10][3] == "allow" and got[11] == ("badexample.org", "", None, "allow")
    assert urls.judged(pages.limit(0), urls.mirrored(pages)).count() == 0 and urls.judged(pages, urls.mirrored(pages.limit(0))).count() == len(rows)


def test_bloom_passes_every_listed_key_and_the_join_no_other(spark):
    listed = spark.range(0, 3000).selectExpr("concat('u', id) as k")
    rows = spark.range(0, 9000).selectExpr("id", "concat('u', id * 2) as k")
    got = urls.in_list(rows, listed, "k")
    assert got.where("listed").count() == 1500 and got.count() == 9000 and got.where("listed and id >= 1500").count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + k, x[0].tolist()) for k in range(30)] + [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] * 16), (None, x[1].tolist()), (3004, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df.where("vec_id % 100 = 0"), df)
    by: dict[int, list] = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == {*range(0, 1500, 100), 2000}
    assert [v for v, _ in by[0]] == list(range(2000, 2010)) and [v for v, _ in by[2000]] == [0, *range(2001, 2010)] and by[0][0][1] == 0.0
    y = np.concatenate([x, np.repeat(x[:1], 30, 0)]).astype(float)
    ids = np.array([*range(1500), *range(2000, 2030)])
    hits = 0
    for q in range(100, 1500, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        hits += len(set(want.tolist()) & {v for v, _ in by[q]})
        assert all(abs(s - d[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, s in by[q])
    assert hits >= 0.9 * 140
    few = neighbours.nearest(df.where("vec_id = 5"), df.where("vec_id < 8")).count()
    assert few == 7 and neighbours.nearest(df.limit(0), df).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(0)
    say = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 5000, n))
    item = say(30)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        body = say(80) + (" idiot scum moron loser" if toxic else "")
        rows.append((i, body + ("\ncommon footer line here" if i % 2 else ""), f"s{i % 15}"))
        labels.append((i, 1, int(toxic)))
    copy = rows[1][1].split(" ")
    copy[10] = "other"
    rows += [(900, " ".join(copy), "s1"), (901, say(40) + " " + item + " " + say(40), "s2"), (902, None, "s3")]
    for name, data, schema in (
        ("documents", [(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, item)], "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {}
    seen = False
    for i, t, _ in rows:
        if i % 5 == 0 and i < 400 or i in (900, 901):
            continue
        if t and "common footer" in t:
            t, seen = (t.replace("\ncommon footer line here", ""), True) if seen else (t, True)
        want[i] = packing.token_bytes(t or "") + bytes(4)
    assert {r.doc_id for r in got} == set(want)
    assert all(r.length * 4 == len(want[r.doc_id]) for r in got) and len(hashlib.sha256(b"").hexdigest()) == 64
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
