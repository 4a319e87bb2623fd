"""Near dedup against brute force over all pairs, with similarities on both sides of 0.8."""

import numpy as np
import pytest

pytest.importorskip("locutio.llm")

from locutio.llm import simhash


def test_near_dedup_is_exact(spark):
    rng = np.random.default_rng(8)
    say = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    footer = say(60)
    rows, i = [], 0
    for g in range(40):
        base = say(int(rng.integers(20, 200))) + (footer if g % 3 == 0 else [])
        for k in range(6):
            copy = list(base)
            for at in range(0, len(copy), 1 + len(copy) // (1 + k)):
                copy[at] = f"x{i}"
            if k == 5:
                copy = copy[: int(len(copy) * 0.82)]
            rows.append((i := i + 1, " ".join(copy)))
    rows += [(1000, rows[0][1]), (1001, "two words"), (1002, "two  Words"), (None, rows[0][1])]
    known = [(k, t) for k, t in rows if k]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in known]
    group = list(range(len(known)))
    near = 0
    for a in range(len(known)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                near += 1
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    want = {known[k][0] for k in range(len(known)) if group[k] == k}
    kept = [r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert {k for k in kept if k} == want and None in kept and near > 50 and len(want) > 60


def test_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        common = rng.integers(-(2**62), 2**62, int(rng.integers(0, 3000)))
        a, b = (np.unique(np.concatenate([common, rng.integers(-(2**62), 2**62, int(rng.integers(0, 300)))])) for _ in range(2))
        apart = len(np.setxor1d(a, b))
        assert simhash.least_apart(simhash.parity(a), simhash.parity(b)) <= apart and simhash.least_apart(simhash.parity(a), simhash.parity(a)) == 0
    wide = [np.unique(rng.integers(-(2**62), 2**62, 20_000)) for _ in range(2)]
    assert 9 * simhash.least_apart(*map(simhash.parity, wide)) > 40_000
