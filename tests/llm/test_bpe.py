"""Tree concatenation against the tokenizers library: ids of any text, however it is cut, and decoding."""

import copy
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("locutio.llm")

from locutio.llm import bpe
from locutio.llm.packing import TOKENIZER, _tools

own = _tools(TOKENIZER)[0]
LONG = "long words " * 4000 + "x" * 20_000 + " \n" * 2000 + "é1" * 1000


def coder_with(**sizes: int) -> bpe.Coder:
    out = copy.copy(bpe.coder(TOKENIZER))
    vars(out).update(sizes)
    return out


def wanted(text: str) -> list[int]:
    return own.encode(text, add_special_tokens=False).ids


PIECES = st.sampled_from([*"aabc1 '\n\t!é世🙂 　", "'ll", "'re", "  ", " the", "aaaa", "<|endoftext|>", "<|endof", "İ", "́", "12"])
TEXT = st.lists(PIECES, max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(1, 5), st.integers(1, 3), st.sampled_from([0, 4, 512]))
def test_any_cut_gives_the_ids_of_the_whole(text, leaf, look, short):
    assert coder_with(leaf=leaf, look=look, short=short).encode(text).tolist() == wanted(text)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 7))
def test_parts_join_to_the_whole(text, part):
    at = bpe.cuts(text, part, ["<|endoftext|>"])
    coder = coder_with(leaf=3, look=1, short=2)
    assert at[0] == 0 and at[-1] == len(text) and coder.folded([coder.encode(text[lo:hi]) for lo, hi in zip(at, at[1:])]).tolist() == wanted(text)


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefghij", "01", "!?.", " ", "\n", "世界人", "é", "aA'"])
def test_long_unsplit_text(alphabet):
    rng = random.Random(alphabet)
    for n in (2000, 5003):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        for leaf, look in ((64, 1), (700, 16)):
            assert coder_with(leaf=leaf, look=look, short=8).encode(text).tolist() == wanted(text)


def test_windows_stay_small():
    """In text without a split the two sides agree after a few ids; only what is near a cut is encoded again."""
    rng = random.Random(3)
    text = "".join(rng.choice("etaoinshr") for _ in range(40_000))
    coder = coder_with(leaf=1000)
    seen = []
    inner = coder._bytes_ids
    coder._bytes_ids = lambda piece: seen.append(len(piece)) or inner(piece)
    assert coder.encode(text).tolist() == wanted(text)
    assert seen and sum(seen) < len(text) / 4


def test_decoding_equals_the_library():
    rng = np.random.default_rng(2)
    coder = bpe.coder(TOKENIZER)
    for n in (0, 1, 5, 300):
        ids = rng.integers(0, 50257, n).astype(np.uint32)
        assert coder.text(ids) == own.decode(ids.tolist(), skip_special_tokens=False)
    assert coder.text(np.array([64, 60_000, 50256], np.uint32)) == own.decode([64, 60_000, 50256], skip_special_tokens=False)


ROWS = [(1, "Plain words, isn't it? <|endoftext|> after"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (5, LONG), (None, LONG), (6, LONG + "!"), (7, "same"), (7, "same"), (None, None), (8, "<|endoftext|>" * 7000)]


def test_documents(spark):
    docs = spark.createDataFrame([(*r, "k", 1, b"") for r in ROWS], "doc_id long, text string, key string, part int, ids binary")
    want = sorted((i or 0, t or "") for i, t in ROWS)
    for part in (1 << 16, 1000):
        ids = bpe.encode(docs, part=part)
        assert sorted((r.doc_id or 0, hashlib.sha256(r.ids).hexdigest()) for r in ids.collect()) == sorted((i, hashlib.sha256(np.array(wanted(t), "<u4").tobytes()).hexdigest()) for i, t in want)
    assert sorted((r.doc_id or 0, r.text) for r in bpe.decode(ids).collect()) == want
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(ids, step=1000).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted((i, len(w := wanted(t)), sha(",".join(map(str, w))), sha(t)) for i, t in want)
    assert bpe.digests(bpe.encode(docs.limit(0))).count() == 0


def test_a_task_that_is_lost_gives_the_same(spark):
    docs = spark.createDataFrame([(k, LONG[k:]) for k in range(4)], "doc_id long, text string")
    assert len({tuple(sorted((r.doc_id, bytes(r.ids)) for r in bpe.encode(docs.repartition(n)).collect())) for n in (1, 3)}) == 1
