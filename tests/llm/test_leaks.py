"""Leaks that differ from their item in some slots or some words."""

import random
import time

import pytest

pytest.importorskip("locutio.llm")

from locutio.llm import decontaminate


def leak(item: str, text: str):
    """What the operator finds, from all pairs of windows."""
    (icodes, iwords), (codes, words) = (decontaminate.template(x or "") for x in (item, text))
    width = min(decontaminate.WINDOW, len(icodes))
    there, own = decontaminate.template_windows(icodes, iwords), decontaminate.template_windows(codes, words, width) if len(codes) >= width else []
    low = lambda w: decontaminate._surface(w).lower()
    spots = [(p, q, [low(words[t]) for t in range(p, p + width) if codes[t] < 1024]) for p in range(len(own)) for q in range(len(there)) if own[p] == there[q]]
    return decontaminate.aligned(icodes.tolist(), [low(w) for w in iwords], spots) if spots else None


def matched(item: str, text: str) -> list[int]:
    return [7] if leak(item, text) else []


def test_templates_find_replaced_slots_that_are_consistent():
    item = "Tom Brown had 12 apples and gave 5 apples to his friend while Mary Smith kept 12 kg for later. How many does he have?"
    assert matched(item, "said Tom Brown had 12 apples and gave 5 apples to his friend while Mary Smith kept 12 kg for later. How many does he have? Yes") == [7]
    changed = "now Jim Green had 7 apples and gave 3 apples to his friend while Sue Jones kept {} lb for later. How many does he have?"
    assert matched(item, changed.format(7)) == [7] and matched(item, changed.format(9)) == []
    assert matched("two words", "they said two words again") == [7] and matched(item, "") == matched("", "some text") == []


def test_a_conflicting_slot_costs_its_windows_only():
    rest = " ".join(f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta") for b in ("x", "y", "z", "w", "v", "u", "t"))
    item = f"there were 3 apples {rest} and then came 3 pears"
    assert matched(item, item.replace("3 pears", "4 pears")) == [7]
    two = f"there were 3 apples {rest} and then came 5 pears at last"
    assert matched(two, two.replace("3 apples", "9 apples").replace("5 pears", "9 pears")) == [7]
    table = "one value 1 2 3 4 5 6 7 8 and"
    assert matched(table, "one value 10 20 30 40 50 60 70 80 and") == []


def test_a_long_run_is_a_leak_of_any_item():
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    assert matched(" ".join(words), "before it " + " ".join(words[100:250]) + " and after") == [7]
    assert matched(" ".join(words), "before it " + " ".join(words[100:112]) + " and after") == []
    assert matched(" ".join(words), "before it " + " ".join(words[100:113]) + " and after") == [7]


def test_one_mapping_over_all_alignments():
    item = "yesterday our friend Tom went over the long bridge with Anna because the small boat was gone again"
    first, second = item.replace("Tom", "Jim").replace("Anna", "Sue"), item.replace("Tom", "Bob").replace("Anna", "Sue")
    assert matched(item, first) == matched(item, second) == matched(item, first + " . And " + second) == [7]
    halves = " ".join(first.split()[:10]) + " stop here now " + " ".join(second.split()[2:12])
    assert leak(item, halves) is None or leak(item, halves)[2] < leak(item, first)[2]


def test_join_equals_all_pairs(spark):
    rng = random.Random(5)
    plain = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu") for b in ("na", "re", "so")]
    say = lambda n: " ".join(rng.choice([*plain, *plain, "Tom", "Ann", "3", "40", "km", "."]) for _ in range(n))
    items = [(k, say(rng.randrange(2, 40))) for k in range(30)] + [(31, None), (None, say(20)), (32, "")]
    texts = [None, "", "  ", "word"]
    for k in range(150):
        parts = [say(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            words = rng.choice(items[:30])[1].split()
            at = rng.randrange(0, len(words))
            parts += [" ".join(rng.choice(["Tom", "5", w, w, w, w, w, w]) for w in words[at // 2 : len(words) - at // 3]), say(4)]
        texts.append(" ".join(parts))
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(500, texts[10], "y"), (None, texts[11], "z")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string, __leaks string"), spark.createDataFrame(items, "item_id long, text string")
    want = {t: sorted((i, *found) for i, item in items if i is not None and item and (found := leak(item, t))) for t in texts if t is not None}
    got = decontaminate.contaminated(df, bench).collect()
    told = {r.doc_id: sorted((x.item_id, x.first, x.tokens, x.share, x.exact) for x in r.leaks) for r in got}
    assert len(got) == len(rows) and all(told[i] == want.get(t, []) for i, t, _ in rows) and sum(map(bool, want.values())) > 20
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t, _ in rows if not want.get(t))
    assert decontaminate.contaminated(df, bench.limit(0)).where("size(leaks) > 0").count() == decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_tables_of_numbers_meet_only_where_they_are_equal(spark):
    rng = random.Random(9)
    numbers = [str(rng.randrange(10**6)) for _ in range(100_000)]
    items = [(k, " ".join(str(rng.randrange(10**6)) for _ in range(300))) for k in range(5)] + [(9, " ".join(numbers[5000:5300]))]
    docs = spark.createDataFrame([(1, " ".join(numbers)), (2, " ".join(numbers[:4000]))], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: [9], 2: []} and time.perf_counter() - began < 60


def test_weak_windows_are_told_by_their_values():
    weak = lambda text: decontaminate.template_windows(*decontaminate.template(text)).tolist()
    assert weak("sum of 1 2 3 4 5 6") != weak("sum of 1 2 3 4 5 7") and weak("sum of 1 2 3 4 5 6") == weak("Sum of 1 2 3 4 5 6")
    assert weak("we saw 3 apples and then 5 pears") == weak("we saw 4 apples and then 6 pears")
