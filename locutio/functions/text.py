"""Column functions on text and time literals. All of them stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda that names an outer expression evaluates it again for every element.

    element_at finds the type of what it takes once; get asks the whole body for it at every call, so nested lets would cost their depth each time.
    """
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def running(values: Column, zero: Column, kind: str) -> Column:
    """Sum of what comes before each value, added from the left. Sums are kept every 256 values, then every 16, and each value adds up what is left, so its
    cost is some thirty steps a value and a long array isn't copied at each of them."""
    add = lambda s, x: s + x
    none = F.array().cast("array<int>")

    def sums(own: Column) -> Column:
        upto = lambda bits: F.when(F.size(own) > 0, F.sequence(F.lit(0), F.shiftright(F.size(own) - 1, bits))).otherwise(none)
        start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), zero.alias("at"))
        step = lambda acc, b: F.struct(F.array_append(acc.out, acc.at).alias("out"), F.aggregate(F.slice(own, b * 256 + 1, 256), acc.at, add).alias("at"))
        beyond = lambda bases: F.transform(upto(4), lambda g: F.aggregate(F.slice(own, F.shiftright(g, 4) * 256 + 1, g.bitwiseAND(15) * 16), F.get(bases, F.shiftright(g, 4)), add))
        within = lambda bases: F.transform(own, lambda _, i: F.aggregate(F.slice(own, F.shiftright(i, 4) * 16 + 1, i.bitwiseAND(15)), F.get(bases, F.shiftright(i, 4)), add))
        return let(let(F.aggregate(upto(8), start, step, lambda acc: acc.out), beyond), within)

    return let(values, sums)


def _folding() -> tuple[str, str]:
    """Lower-case letters of the Latin, Greek and Cyrillic blocks that canonical decomposition turns into one base letter and marks."""
    source, target = [], []
    for c in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        letter = chr(c)
        parts = unicodedata.normalize("NFD", letter)
        base = "".join(p for p in parts if not 0x300 <= ord(p) <= 0x36F)
        if base != letter and len(base) == 1 and letter.lower() == letter:
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


_FROM, _TO = _folding()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), "[\\u0300-\\u036f]", "")


def normalise(text: Column) -> Column:
    """fold, plain apostrophes and single blanks: what the lexical gate matches on."""
    return F.regexp_replace(F.translate(fold(text), "‘’`", "'''"), "(?U)\\s+", " ")


def squeeze(text: Column) -> Column:
    """Single blanks, none outside."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def bare_word(word: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(word), "[^\\p{L}\\p{N}]", "")


def punctuation_density(text: Column) -> Column:
    """Sentence ends for each 1000 characters; 0 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.regexp_count(text, F.lit("[.!?…]")).cast("double") * 1000 / n).otherwise(F.lit(0.0))


def seconds(mark: Column) -> Column:
    """``1:02:03,5`` and the like as seconds; 0 if a part is no number."""
    parts = F.transform(F.split(F.regexp_replace(F.trim(mark), "^([^,]*),", "$1."), ":"), lambda p: F.when(F.trim(p) == "", F.lit(0.0)).otherwise(p.try_cast("double")))
    return F.coalesce(F.aggregate(parts, F.lit(0.0), lambda s, p: s * 60 + p), F.lit(0.0))


def clock(s: Column) -> Column:
    """Seconds as HH:MM:SS, rounded down; hours go beyond 99; what is negative or not finite counts as 0."""
    good = F.when(s.isNull() | F.isnan(s) | (s < 0) | (s == float("inf")), F.lit(0.0)).otherwise(s.cast("double"))
    whole = F.floor(good).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600).cast("bigint"), F.floor((whole % 3600) / 60).cast("bigint"), whole % 60)


def fixed(x: Column, digits: int) -> Column:
    """x rounded on its exact binary value to so many digits, ties away from below: what a fixed-point format gives for x >= 0."""
    step = 2 ** (digits + 1)
    tie = (x * step == F.floor(x * step)) & (F.floor(x * step) % 2 != 0)
    return F.when(tie, F.floor(x * 10**digits + 0.5) / 10**digits).otherwise(F.replace(F.format_number(x, digits), F.lit(","), F.lit("")).cast("double"))


# Markup and entities of a subtitle line, in the order of removal.
LINE_MARKUP = [
    (r"<\d{2}:\d{2}:\d{2}[.,]\d{3}>", ""),
    (r"(?i)</?[cvbi][^>]*>", ""),
    (r"<[^>]{1,40}>", ""),
    (r"&nbsp;", " "),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&#39;|&apos;", "'"),
    (r"&quot;", '"'),
    (r"\{\\an?\d\}", ""),
]


def clean_line(line: Column) -> Column:
    for pattern, new in LINE_MARKUP:
        line = F.regexp_replace(line, pattern, new)
    return trimmed(line)


def trimmed(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def claim_id(index: Column) -> Column:
    """a0000, a0001, ...; longer from a10000 on."""
    digits = index.cast("string")
    return F.concat(F.lit("a"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")))


def short_sha256(data: Column) -> Column:
    return F.substring(F.sha2(data, 256), 1, 12)


def file_key(name: Column, content: Column) -> Column:
    """Key of a file from its name and bytes."""
    return short_sha256(F.concat(name.cast("binary"), content.cast("binary")))


def url_key(url: Column, forced_asr: bool = False) -> Column:
    joined = F.concat(url, F.lit("#asr")) if forced_asr else url
    return short_sha256(F.lower(trimmed(joined)).cast("binary"))


def evaluation_key(model: Column, prompt_hash: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\u0000", model, prompt_hash, text).cast("binary")), 1, 16)


def percent(x: Column) -> Column:
    """Whole percent, padded to three places, or n/d."""
    return F.coalesce(F.concat(F.lpad(F.floor(x * 100 + 0.5).cast("bigint").cast("string"), 3, " "), F.lit("%")), F.lit(" n/d"))


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def script_safe(json: Column) -> Column:
    """A JSON text that can't close the script element it stands in."""
    for a, b in (("<", "\\u003c"), (">", "\\u003e"), (chr(0x2028), "\\u2028"), (chr(0x2029), "\\u2029")):
        json = F.replace(json, F.lit(a), F.lit(b))
    return json
