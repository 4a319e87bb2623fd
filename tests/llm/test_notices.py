"""Licence scan: whole licences, notices in running text, wrong names, and a brute-force scan."""

import random
import re
import textwrap

import pytest

pytest.importorskip("locutio.llm")

from locutio.llm import licenses


def found(text: str) -> list[tuple[str, int, str]]:
    """(template, words that differ, differences) of the confirmed places of a text."""
    out = []
    for _, block, lines in licenses.blocks(text, re.compile(licenses.CANDIDATE)):
        out += [(name, n, said) for name, _, n, said, confirmed in licenses.judge(block, lines) if confirmed]
    return out


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_own_text_wrapped_and_within_other_words(name):
    text = licenses.TEMPLATES[name]
    head = "Thing, a small library\n\nCopyright (c) 2019 Somebody Else\n\n"
    for form in (text, head + text, head + "\n".join(textwrap.wrap(text, 70)) + "\n\nmain() starts here", "Here we go on with a word or two. " * 60 + text + " and so on it went" * 60):
        assert found(form) == [(name, 0, "")]


def test_names_and_versions_may_not_differ():
    assert found("Released under the GPL License.") == found("Licensed under CC BY-ND-NC 4.0.") == found("Apache License, Version 1.1") == []
    assert found("Licensed under the Apache License, Version 3.0.") == found("Licensed under CC BY 3.0.") == found("Our licence fee rose again, said the minister") == []
    assert found("Distributed under the MIT License, see below") == [("MIT-notice", 1, "-Released")]
    assert [f[0] for f in found(licenses.TEMPLATES["GPL-3.0-or-later"].replace("General", "Lesser General"))] == ["LGPL-3.0-or-later"]


def test_two_notices_side_by_side():
    text = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\nx\nLicensed under CC BY 4.0."
    assert [f[0] for f in found(text)] == ["MIT-notice", "Apache-2.0-notice", "CC-BY-4.0-notice"]
    assert [f[0] for f in found(" ".join(["Released under the MIT License."] * 50))] == ["MIT-notice"] * 50


def distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_scan_equals_all_runs_of_words(spark):
    """Against the least distance between a notice and any run of words of a text."""
    rng = random.Random(2)
    names = [n for n in licenses.TEMPLATES if n.endswith("-notice")]
    rows = [(0, None), (1, ""), (2, "nothing here"), (None, licenses.TEMPLATES["MIT-notice"])]
    for k in range(3, 90):
        words = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 40))]
        notice = licenses.TEMPLATES[rng.choice(names)].rstrip(".").split()
        if rng.random() < 0.4:
            notice[rng.randrange(len(notice))] = rng.choice(["odd", "MIT", "2.0"])
        at = rng.randrange(len(words) + 1)
        rows.append((k, " ".join(words[:at] + notice + words[at:])))
    got = licenses.scanned(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, line string")).collect()
    for i, t in rows:
        words = [w.lower() for w in licenses._WORD.findall(t or "")]
        told = {r.license: r.n_different for r in got if r.doc_id == i and r.confirmed}
        for name in names:
            own = [w.lower() for w in licenses._WORD.findall(licenses.TEMPLATES[name])]
            least = min((distance(own, words[a:b]) for a in range(len(words)) for b in range(a + 1, min(len(words), a + len(own) + 2) + 1)), default=99)
            if name in told:
                assert least == told[name] <= licenses.MOST_DIFFERENT * len(own), (t, name)
            elif least == 0:
                assert told, (t, name)
    assert sum(r.confirmed for r in got) > 50 and all(r.differences == "" for r in got if not r.confirmed)
