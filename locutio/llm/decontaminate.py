"""Benchmark decontamination over canonical templates.

Numbers, units and names of a text become typed placeholders, and eight-token windows of these templates are hashed. The benchmark's windows are a
table; a filter of their hashes, of bounded size, keeps the texts' other windows from being shuffled, and a hash join with the table on the window
removes what the filter lets through by chance. The windows of a text and an item are then aligned and their slots compared: a window counts if its
slots are literally equal (windows with few plain words are hashed with their values, as they can count in no other way), or if each changed value of the item stands for one value of the document and each of the document for one of the item,
within numbers, units and names and over all alignments that count. That also finds questions whose numbers, names or units were replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import checkpointed, filtering, per_document, table

WINDOW = 8
#: Share of an item's windows that a document must hold.
COVERAGE = 0.5
#: So many literal tokens in one run of matched windows make a leak whatever the item's length.
RUN = 13
#: Where slots differ, a window must hold so many different plain words for each of its tokens; a table of numbers is no template.
LITERAL = 0.3
#: Up to so many leaking texts go to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb lbs oz t ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years c f k % percent $ eur usd euro euros dollar dollars pound pounds cent cents mph kmh w kw kwh j kj cal kcal v hz khz mhz ghz b kb mb gb tb meter meters metre metres mile miles inch inches foot feet gram grams litre litres liter liters degrees".split())
#: A token, with the sentence mark before it if there is one.
_TOKEN = re.compile(r"[.!?:|\n][^\w%$€£]*(?:\d[\d.,]*\d|\d|[%$€£]|[^\W\d_]+)|\d[\d.,]*\d|\d|[%$€£]|[^\W\d_]+")
_NUMBER, _UNIT, _NAME = 11, 12, 13
_known: dict[str, int] = {}


def _surface(token: str) -> str:
    return re.sub(r"^[^\w%$€£]+", "", token) if token[0] in ".!?:|\n" else token


def _code(token: str) -> int:
    word = _surface(token)
    if word[0].isdigit():
        code = _NUMBER
    elif not word[0].isalpha():
        code = _UNIT
    elif word == token and word[0].isupper():
        code = _NAME
    else:
        code = xxhash.xxh64_intdigest(word.lower(), 7) | 1024
    _known[token] = code
    return code


def template(text: str) -> tuple[np.ndarray, list[str]]:
    """uint64 code and token of each token. A number is a run of digits; a unit follows a number; a name is capitalised inside a sentence."""
    if len(_known) > 400_000:
        _known.clear()
    words = _TOKEN.findall(text)
    if not words:
        return np.empty(0, np.uint64), words
    codes = np.array([_known.get(w) or _code(w) for w in words], np.uint64)
    if codes[0] == _NAME:
        codes[0] = xxhash.xxh64_intdigest(words[0].lower(), 7) | 1024
    for i in np.flatnonzero(codes[:-1] == _NUMBER).tolist():
        if _surface(words[i + 1]).lower() in UNITS:
            codes[i + 1] = _UNIT
    return codes, words


def windows(codes: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """A hash of each k tokens in a row; of all tokens if there are fewer; none without tokens."""
    if not len(codes):
        return codes
    k = min(k, len(codes))
    out = np.zeros(len(codes) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ codes[j : len(codes) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def template_windows(codes: np.ndarray, words: list[str], k: int = WINDOW) -> np.ndarray:
    """windows, where those with too few plain words to be a template are told by their slots' values too: such a window counts only if these are literally
    equal, and a table of numbers doesn't meet every other one."""
    out = windows(codes, k)
    slots = codes < 1024
    if not slots.any():
        return out
    k = min(k, len(codes))
    sums = np.concatenate([[0], np.cumsum(slots)])
    some = np.flatnonzero(sums[k:] > sums[:-k])
    own = np.sort(np.lib.stride_tricks.sliding_window_view(codes, k)[some], 1)
    plain = own >= 1024
    weak = some[plain[:, 0] + (plain[:, 1:] & (own[:, 1:] != own[:, :-1])).sum(1) < LITERAL * k]
    if len(weak):
        exact = codes.copy()
        inside = np.zeros(len(codes) + 1, np.int64)
        np.add.at(inside, weak, 1)
        np.add.at(inside, weak + k, -1)
        for t in np.flatnonzero(slots & (np.cumsum(inside)[:-1] > 0)).tolist():
            exact[t] = xxhash.xxh64_intdigest(_surface(words[t]).lower(), int(codes[t])) | 1024
        out[weak] = windows(exact, k)[weak]
    return out


def conflicting(pairs: dict[int, tuple[int, str, str]]) -> set[int]:
    """The slots, of (kind, value of the item, value of the text), whose values differ and don't map one to one within their kind."""
    there: dict[tuple[int, str], set[str]] = defaultdict(set)
    back: dict[tuple[int, str], set[str]] = defaultdict(set)
    for kind, a, b in pairs.values():
        there[kind, a].add(b)
        back[kind, b].add(a)
    return {s for s, (kind, a, b) in pairs.items() if a != b and (len(there[kind, a]) > 1 or len(back[kind, b]) > 1)}


def aligned(codes: list[int], words: list[str], spots: list[tuple[int, int, list[str]]], coverage: float = COVERAGE, k: int = WINDOW) -> tuple[int, int, float, bool] | None:
    """(first token, tokens, share, exact) of a leak of the item (codes, words) in a text, or None.

    spots: (place in the text, place in the item, the window's slot values in the text) of windows with equal hashes. Windows of one shift are an
    alignment. Alignments are taken with the longest first, each only if its changed slots map one to one, and as the alignments before it map them.
    """
    width, total = min(k, len(codes)), max(1, len(codes) - k + 1)
    slots = [t for t, c in enumerate(codes) if c < 1024]
    by_shift: dict[int, dict[int, list[str]]] = defaultdict(dict)
    for p, q, values in spots:
        by_shift[p - q][q] = values
    judged = []
    for shift, at in by_shift.items():
        pairs = {t: (codes[t], words[t], value) for q, values in at.items() for t, value in zip((t for t in slots if q <= t < q + width), values)}
        wrong, changed = conflicting(pairs), {t for t, (_, a, b) in pairs.items() if a != b}
        good = []
        for q in sorted(at):
            own = range(q, q + width)
            if changed.isdisjoint(own) or (wrong.isdisjoint(own) and len({codes[t] for t in own if codes[t] >= 1024}) >= LITERAL * width):
                good.append(q)
        if good:
            judged.append((-len(good), shift, good, changed, pairs))
    there: dict[tuple[int, str], str] = {}
    back: dict[tuple[int, str], str] = {}
    covered: set[int] = set()
    first, exact, tokens, longest = None, True, 0, 0
    for _, shift, good, changed, pairs in sorted(judged, key=lambda x: x[:2]):
        inside = {t for q in good for t in range(q, q + width)}
        new = {pairs[t] for t in changed & inside}
        if any(there.get((kind, a), b) != b or back.get((kind, b), a) != a for kind, a, b in new):
            good = [q for q in good if changed.isdisjoint(range(q, q + width))]
            inside, new = {t for q in good for t in range(q, q + width)}, set()
        if not good:
            continue
        there |= {(kind, a): b for kind, a, b in new}
        back |= {(kind, b): a for kind, a, b in new}
        covered |= set(good)
        tokens += len(inside)
        exact &= not new
        cuts = [0, *(i for i in range(1, len(good)) if good[i] > good[i - 1] + 1), len(good)]
        longest = max(longest, *(sum(t not in changed for t in range(good[a], good[b - 1] + width)) for a, b in zip(cuts, cuts[1:])))
        first = min(x for x in (first, shift + min(inside)) if x is not None)
    if covered and (len(covered) >= coverage * total or longest >= RUN):
        return first, tokens, len(covered) / total, exact
    return None


def _item_windows(items: DataFrame) -> DataFrame:
    """(h, width, item_id, item, q) of the windows of each item; item is a hash of its text."""
    schema = pa.schema([("h", pa.int64()), ("width", pa.int64()), ("item_id", pa.int64()), ("item", pa.int64()), ("q", pa.int64())])

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for item_id, item, text in rows:
            codes, words = template(text)
            for q, h in enumerate(template_windows(codes, words).view(np.int64).tolist()):
                yield h, min(WINDOW, len(codes)), item_id, item, q

    return per_document(items, kernel, schema, "h long, width long, item_id long, item long, q long")


def _filter_bits(count: int) -> int:
    """log2 of the bits of the window filter: 64 for each window of the benchmark, at least a kilobyte and at most 16 MB. A fuller filter lets more through."""
    return min(27, max(13, (64 * max(count, 1)).bit_length()))


def _window_filter(found: DataFrame, bits: int) -> np.ndarray:
    """The filter's bytes: built by a distinct aggregation of 64-bit words on the executors."""
    mask = F.lit((1 << bits) - 1)
    low, high = F.col("h").bitwiseAND(mask), F.shiftright("h", 64 - bits).bitwiseAND(mask)
    places = found.select(F.explode(F.array(low, high)).alias("place"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))
    rows = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[np.asarray(rows["word"], np.int64)] = np.asarray(rows["mask"], np.int64)
    return out.view(np.uint64)


def _text_windows(docs: DataFrame, shared, bits: int, widths: list[int]) -> DataFrame:
    """(key, p, h, slots) of the windows of each text of docs (key, text) that pass the filter; slots are the window's slot values."""
    schema = pa.schema([("key", pa.binary()), ("p", pa.int64()), ("h", pa.int64()), ("slots", pa.list_(pa.string()))])

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = shared.value
        for key, text in rows:
            codes, words = template(text)
            for width in widths:
                if len(codes) < width:
                    continue
                own = template_windows(codes, words, width)
                ok = np.ones(len(own), bool)
                for place in (own & np.uint64((1 << bits) - 1), own >> np.uint64(64 - bits)):
                    ok &= (held[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                for p in np.flatnonzero(ok).tolist():
                    yield key, p, int(own[p].view(np.int64)), [_surface(words[t]).lower() for t in range(p, p + width) if codes[t] < 1024]

    return per_document(docs, kernel, schema, "key binary, p long, h long, slots array<string>")


def _leaks(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """(key, leaks) of the texts of docs that hold an item; key is the MD5 of the text, so copies are judged once."""
    spark = docs.sparkSession
    items = benchmark.where("text is not null and item_id is not null").select("item_id", F.xxhash64("text").alias("item"), "text").distinct()
    found = checkpointed(_item_windows(items))
    widths = sorted(r["width"] for r in found.select("width").distinct().collect())
    bits = _filter_bits(found.count())
    shared = spark.sparkContext.broadcast(_window_filter(found, bits))
    texts = docs.where("text is not null").select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    passed = _text_windows(texts, shared, bits, widths).dropDuplicates(["key", "p", "h"])
    hits = passed.join(found, "h").groupBy("key", "item_id", "item").agg(F.collect_list(F.struct("p", "q", "slots")).alias("spots"))
    asked = hits.join(items.select("item_id", "item", "text"), ["item_id", "item"]).select("key", "item_id", "text", "spots")

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        known: tuple = ()
        for key, item_id, text, spots in rows:
            if not known or known[0] != text:
                codes, words = template(text)
                known = text, codes.tolist(), [_surface(w).lower() for w in words]
            leak = aligned(known[1], known[2], [(x["p"], x["q"], x["slots"]) for x in spots], coverage)
            if leak:
                yield key, item_id, *leak

    schema = pa.schema([("key", pa.binary()), ("item_id", pa.int64()), ("first", pa.int64()), ("tokens", pa.int64()), ("share", pa.float64()), ("exact", pa.bool_())])
    rows = per_document(asked, kernel, schema, "key binary, item_id long, first long, tokens long, share double, exact boolean")
    return checkpointed(rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("item_id", "first", "tokens", "share", "exact"))).alias("leaks")))


def _by_text(docs: DataFrame, leaks: DataFrame, how: str) -> DataFrame:
    """docs joined with leaks on the MD5 of the text; up to BROADCAST_ROWS leaks go to every executor, so that texts aren't shuffled."""
    small = leaks.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(leaks) if small else leaks, F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("key"), how)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, leaks array<struct<item_id, first, tokens, share, exact>>) of each row of docs.

    Null and empty texts hold nothing; items without a text or an id are left out, an item that repeats counts once. An item below the window's length
    counts as one window; a share of half the windows, or a run of RUN literal tokens, makes a leak. Rows are judged by their text alone.
    """
    leaks = _leaks(docs.select("text"), benchmark, coverage)
    found = _by_text(docs.select("doc_id", "text"), leaks, "left")
    return found.select("doc_id", F.coalesce("leaks", F.array().cast(leaks.schema["leaks"].dataType)).alias("leaks"))


@filtering
def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item; each is judged by its own text."""
    return _by_text(docs, _leaks(docs.select("text"), benchmark, COVERAGE).select("key"), "left_anti").select(docs.columns)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.col("leaks.item_id")))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.array_join(ids.cast("array<string>"), ",").alias("item_ids"), F.coalesce(F.array_max("leaks.share"), F.lit(0.0)).alias("share"))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLE_SQL: dict[str, str] = {}
