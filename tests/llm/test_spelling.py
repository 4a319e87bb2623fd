"""Spelling variants against all pairs, and neighbours against sets of strings."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("locutio.llm")

from locutio.llm import spelling

FULL = np.full(1 << 10, 255, np.uint8)


def around(word, alphabet):
    cut = {word[:i] + word[i + 1 :] for i in range(len(word))}
    put = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet if c != word[i]}
    return sorted([*cut, *put, *{word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé", min_size=4, max_size=4), min_size=1, max_size=5), st.integers(1, 40))
def test_neighbours_are_all_and_none_twice(words, room):
    alphabet = np.array(sorted(map(ord, "abé")), np.uint32)
    got = [[] for _ in words]
    for r, near in spelling.neighbours(spelling._points(words), alphabet, FULL, 13, room):
        got[r].append(near)
    assert [sorted(g) for g in got] == [around(w, "abé") for w in words]


@settings(max_examples=100, deadline=None)
@given(st.text("abcé", min_size=1, max_size=9))
def test_a_neighbours_hash_is_that_of_the_word(word):
    """With a filter of one word only that word comes back from each of its neighbours."""
    bits, held = 20, np.zeros(1 << 17, np.uint8)
    for place in spelling.places(spelling.hashes(spelling._points([word])), bits):
        held[int(place[0]) >> 3] |= 1 << (int(place[0]) & 7)
    alphabet = np.array(sorted(map(ord, "abcé")), np.uint32)
    for near in around(word, "abcé"):
        if near:
            assert [w for _, w in spelling.neighbours(spelling._points([near]), alphabet, held, bits)] == [word]


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :]


def brute(rows, min_length=6, min_count=5, times=5, cut_each=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c < "a" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % cut_each else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}
    out, form = {}, {}
    for w, k in n.items():
        own = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        form[w] = own[0] if own and n[own[0]] >= times * k else None
        out[w] = [form[w], None, k, len(own), n[form[w]] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {(w, *x) for w, x in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = ["wordform", "Wordforms", "wardform", "ÀÉtranger", "àétranger", "étrangers", "aaaaaaa", "aaaaaa", "aaaaaaaa", "colour", "color", "colours", "bücher×÷x", "short", "x" * 300, "x" * 299 + "y", "x" * 301]
    out = [(i, " ".join(rng.choice(words[: 1 + rng.randrange(len(words))]) + rng.choice([" ", ", ", "9", "_"]) for _ in range(60))) for i in range(60)]
    out += [(100, None), (101, ""), (None, "colour colour wordform"), (102, "colour " * 40_000), (103, "z" * 200_000 + " " + "wordform-" * 9000), (3, out[3][1]), (3, out[3][1])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", "f", 1) for r in rows], "doc_id long, text string, word string, form string, n long")


@pytest.mark.parametrize("options", [{}, {"cut_each": 3, "times": 2, "min_count": 1}])
def test_variants_equal_all_pairs(spark, rows, options):
    got = spelling.variants(frame(spark, rows), **options)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = got.collect()
    assert {tuple(r) for r in got} == brute(rows, **options) and len(got) == len({r.word for r in got})


def test_a_full_filter_and_a_shuffled_vocabulary_change_nothing(spark, rows):
    vocab = spelling.vocabulary(frame(spark, rows)).where("length(word) < 20")
    first = {tuple(r) for r in spelling.near_words(vocab).collect()}
    assert first == {tuple(r) for r in spelling.near_words(vocab, broadcast_bytes=0, most_bits=13).collect()} and len(first) > 10


def test_roots_of_a_long_chain(spark):
    forms = spark.createDataFrame([(f"w{k:03}", f"w{k + 1:03}") for k in range(100)] + [("side", "w050")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {f"w{k:03}": "w100" for k in range(100)} | {"side": "w100"}


def test_nothing(spark, rows):
    assert spelling.variants(frame(spark, rows).limit(0)).count() == 0
    assert spelling.variants(frame(spark, [(1, "few words here")])).count() == 0
