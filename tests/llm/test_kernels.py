"""Kernels against brute force, without Spark."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("locutio.llm")

from locutio.llm import language, lines, neighbours, packing, simhash, suffixes, toxicity


def components(near: np.ndarray) -> np.ndarray:
    label = np.arange(len(near))
    while not np.array_equal(new := np.where(near | np.eye(len(near), dtype=bool), label[None], len(near)).min(1), label):
        label = new
    return label


@pytest.mark.parametrize(("words", "budget"), [(1, 3), (1, 0), (2, 6)])
def test_trie_links_all_within_budget(words, budget):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 256, (150, 8 * words), dtype=np.uint8)
    rows = [base]
    for k in range(1, 6):
        x = base.copy()
        for i in range(len(x)):
            for bit in rng.integers(0, 64 * words, k):
                x[i, bit // 8] ^= 1 << (bit % 8)
        rows.append(x)
    x = np.unique(np.concatenate(rows), axis=0)
    group = (np.arange(len(x)) >= len(x) // 2).astype(int)
    bits = np.unpackbits(x, axis=1).astype(int)
    apart = bits @ (1 - bits).T + (1 - bits) @ bits.T
    want = components((apart <= budget) & (group[:, None] == group[None]))
    assert np.array_equal(simhash.trie_links(x, group, budget), want)


def test_trie_of_nothing():
    assert len(simhash.trie_links(np.empty((0, 8), np.uint8), np.empty(0, int), 3)) == 0


def test_shingles_and_fingerprint():
    assert simhash.fingerprint(simhash.shingle_hashes(None, 3)) == bytes(8)
    assert len(simhash.shingle_hashes("One two", 3)) == 1
    assert np.array_equal(simhash.shingle_hashes("A\tB  c\nd", 3), simhash.shingle_hashes("a b c d", 3))
    assert len(simhash.shingle_hashes("a b a b a b", 3)) == 4
    assert simhash.shingle_hashes("É x", 3)[0] != simhash.shingle_hashes("é x", 3)[0]
    long = "w " * 70_000
    assert simhash.fingerprint(simhash.shingle_hashes(long, 3)) == simhash.fingerprint(simhash.shingle_hashes("w w w", 3))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_places_each_piece_once(counts):
    filled: dict[int, list[tuple[int, int]]] = {}
    for length, first, last, sequence, offset in packing.plan(counts, 64):
        for r in range(first, last + 1):
            filled.setdefault(sequence + r - first, []).append((offset, length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    placed: dict[int, int] = {}
    for spans in filled.values():
        for _, length in spans:
            placed[length] = placed.get(length, 0) + 1
    assert placed == counts
    assert sorted(filled) == list(range(len(filled)))
    # best fit decreasing leaves at most one sequence under half full, so it is within twice the bound
    assert len(filled) <= 2 * -(-sum(k * v for k, v in counts.items()) // 64)


def test_token_ids_round_trip():
    from tokenizers import Tokenizer

    import public_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for s in ["", " ", "a  b\n\n c\t'll", "½ 日本 é", "x<|endoftext|>y", "a\u0000b", "word " * 5000]:
        assert np.frombuffer(packing.token_bytes(s), "<u4").tolist() == own.encode(s, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.lists(st.integers(0, 9), min_size=1, max_size=8)), min_size=1, max_size=12), st.sampled_from([b"ab", b"abcdefgh ", b"a"]))
def test_repeated_strings(made, alphabet):
    rng = random.Random(5)
    parts = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(5, 70))) for _ in range(10)]
    texts = [b"".join(parts[i] for i in order) for _, order in made]
    docs = np.array([d for d, _ in made])
    least: dict[bytes, int] = {}
    for t, d in zip(texts, docs):
        for p in range(len(t) - 49):
            least[t[p : p + 50]] = min(least.get(t[p : p + 50], 99), d)
    want = {(i, p) for i, (t, d) in enumerate(zip(texts, docs)) for p in range(len(t) - 49) if least[t[p : p + 50]] < d}
    text, place = suffixes.repeated(texts, docs)
    assert set(zip(text.tolist(), place.tolist())) == want


@pytest.mark.parametrize("alphabet", [b"ab", b"a", b"abcdefghijkl"])
def test_suffix_order(alphabet):
    rng = random.Random(2)
    data = bytes(rng.choice(alphabet) for _ in range(3000))
    sorter = suffixes.SuffixSorter(np.frombuffer(data, np.uint8))
    got = np.concatenate(list(sorter.blocks(np.arange(len(data)))))
    assert got.tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_difference_cover():
    inside, shift = suffixes._cover(suffixes.PERIOD)
    for i in range(suffixes.PERIOD):
        for j in range(suffixes.PERIOD):
            d = shift[i, j]
            assert inside[(i + d) % suffixes.PERIOD] and inside[(j + d) % suffixes.PERIOD]


def test_units_cover_each_string_once_and_alike():
    rng = random.Random(3)
    shared = bytes(rng.choice(b"abcdef ") for _ in range(300))
    names = []
    for seed in (1, 2):
        r = random.Random(seed)
        data = bytes(r.choice(b"abcdef ") for _ in range(200)) + shared + bytes(r.choice(b"abcdef ") for _ in range(100))
        first, n, h = suffixes.units(np.frombuffer(data, np.uint8))
        assert n.sum() == len(data) - 49 and np.array_equal(first[1:], (first + n)[:-1])
        names.append({data[a : a + k + 49] for a, k in zip(first.tolist(), n.tolist())})
    assert len(names[0] & names[1]) > 5
    assert len(suffixes.units(np.frombuffer(b"x" * 49, np.uint8))[0]) == 0


def test_language_profiles():
    counts = lambda s: dict(zip(*(x.tolist() for x in language.ngram_counts(s))))
    assert counts("") == counts(None) == counts("12 .!") == {}
    assert counts("Ab1AB") == {k: 2 * v for k, v in counts("ab").items()}
    long = "the cat and the dog " * 60_000  # over one piece; the cut falls inside a word or not, counts stay within a word
    assert sum(counts(long).values()) == 60_000 * sum(counts("the cat and the dog").values())
    rows = [("de", g, k) for k, g in enumerate(language.ranked(*language.ngram_counts("der die und das nicht ist ein"), 50).tolist())]
    rows += [("en", g, k) for k, g in enumerate(language.ranked(*language.ngram_counts("the of and to in is that was"), 50).tolist())]
    p = language.Profiles(rows, 50)
    assert p.best("und das ist nicht der")[0] == "de" and p.best("that was the end of it")[0] == "en"
    assert p.best("123") == p.best(None) == ("und", 0.0)
    assert 0 <= p.best("zzz")[1] <= 1
    assert language.Profiles([]).best("text") == ("und", 0.0)



def test_chain_learns_from_out_of_fold_predictions():
    import pyarrow as pa

    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(200)]
    words, labels = [], []
    for _ in range(1500):
        y = rng.random() < 0.2
        words.append(sorted({*rng.choices(vocabulary, k=30), *(rng.sample(["bad", "worse", "worst"], 2) if y else [])}))
        labels.append([int(rng.random() < 0.5), int(y), int(y)])
    models = toxicity.fit_chain(pa.array(words), np.array(labels))
    assert len(models) == 3 and len(models[2].chain) == 2
    said = []
    for w in words:
        before = []
        for m in models:
            before.append(m(set(w), before))
        said.append(before[1] >= 0.5)
    assert np.mean(np.array(said) == np.array(labels)[:, 1]) > 0.98
    assert toxicity.fit_chain(pa.array([], pa.list_(pa.string())), np.empty((0, 3))) == []
    assert toxicity.words_of(None) == toxicity.words_of("12 _ !") == set()
    assert {"stemm**", "stemm***"} <= toxicity.words_of("stemma stemmb stemmc")


def test_share_follows_the_rows():
    rng = np.random.default_rng(3)
    spread = rng.normal(size=(3000, 48))
    clustered = rng.normal(size=(60, 48))[rng.integers(0, 60, 3000)] + 0.05 * spread
    assert neighbours.least_share(clustered, 10) <= 0.1 < neighbours.least_share(spread, 10) and neighbours.least_share(spread[:5], 10) == 1.0


def test_forest_finds_the_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 32))
    forest = neighbours.Forest(x)
    hits = 0
    for i, rows in enumerate(forest.candidates(x[:40], neighbours.wanted(neighbours.least_share(x, 10), len(x)))):
        want = np.argsort(((x - x[i]) ** 2).sum(1))[:10]
        hits += len(set(want.tolist()) & set(rows.tolist()))
    assert hits >= 0.9 * 400
    assert len(forest.candidates(x[:1], 10_000)[0]) == 4000


def test_kept_lines():
    import xxhash

    key = lambda s: xxhash.xxh64_intdigest(s.encode(), 42) - ((xxhash.xxh64_intdigest(s.encode(), 42) >> 63) << 64)
    text = "  one two three \nx y\none two three\nlast line here"
    told = lines._arrays([key("one two three"), 5], [1, None])
    assert lines._kept(text, 1, *told) == ("  one two three \nx y\nlast line here", 4, 1)
    assert lines._kept(text, 2, *told) == lines._kept(text, None, *told) == ("x y\nlast line here", 4, 2)
    assert lines._kept("", 2, *told) == lines._kept("", 2, *lines._arrays([], [])) == ("", 1, 0)
