"""Spelling variants by full neighbourhood generation.

Words are counted with DataFrame functions. The vocabulary is dealt over all tasks, and each word's distinct deletions, replacements and insertions
over the observed alphabet are generated, as hashes: a word's prefix and suffix sums give each neighbour's hash in a few operations, so a long word
costs its length times the alphabet and no more. A bit filter of the vocabulary, of bounded size, stops neighbours that are no word; what it lets
through becomes text and meets the vocabulary in a hash join on the word itself. Generation and join are exact, so no distance is ever computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import checkpointed, per_document, table
from .sql import CRC_TABLES, crc_of

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, TIMES, CUT_EACH = 6, 5, 5, 199
#: Words that a task generates the neighbours of; characters of a slice of a long text; neighbours that are held at once; log2 of the filter's bits at most.
WORDS_A_TASK, SLICE, HELD, FILTER_BITS = 4096, 1 << 16, 1 << 22, 29
#: A vocabulary of up to so many bytes goes to every executor; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def runs(text: Column) -> Column:
    """The maximal runs of letters of text, as an array of arrays: a long text is cut between runs first, so that no array holds all of it."""
    slices = F.when(F.length(text) > SLICE, F.regexp_extract_all(text, F.lit(rf"[\s\S]{{1,{SLICE}}}(?![{LETTERS}])|[{LETTERS}]+"), F.lit(0)))
    return F.coalesce(slices, F.array(F.coalesce(text, F.lit(""))))


def occurrences(docs: DataFrame, cut_each: int = CUT_EACH) -> DataFrame:
    """(word) of each run of each text, A to Z in lower case. Where cut_each divides h, the CRC-32 of ``<doc_id>:<run>``, the run loses its code
    point h % length."""
    sliced = docs.select("doc_id", F.explode(runs(F.col("text"))).alias("slice"))
    words = sliced.select("doc_id", F.explode(F.regexp_extract_all("slice", F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("w")).select("doc_id", F.translate("w", UPPER, LOWER).alias("w"))
    hashed = words.select("w", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("w"))).alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    less = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))
    return hashed.select(F.when(F.col("h") % cut_each == 0, less).otherwise(F.col("w")).alias("word"))


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, cut_each: int = CUT_EACH) -> DataFrame:
    """(word, n) of the words with at least min_length code points and min_count occurrences."""
    words = occurrences(docs, cut_each).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, FACTOR), dtype=np.uint64)])


def hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit number of each row of code points (words of one length)."""
    return (points.astype(np.uint64) * _powers(points.shape[1] - 1)).sum(1, dtype=np.uint64) if points.shape[1] else np.zeros(len(points), np.uint64)


def places(own: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter of 2 ** bits bits."""
    mixed = (own ^ (own >> np.uint64(29))) * MIX
    return mixed >> np.uint64(64 - bits), ((mixed ^ (mixed >> np.uint64(31))) * FACTOR) >> np.uint64(64 - bits)


def in_filter(held: np.ndarray, own: np.ndarray, bits: int) -> np.ndarray:
    first, second = places(own.reshape(-1), bits)
    ok = (held[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8)) & 1 == 1
    at = np.flatnonzero(ok)
    second = second[at]
    ok[at] = (held[second >> np.uint64(3)] >> (second & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok.reshape(own.shape)


def neighbours(points: np.ndarray, alphabet: np.ndarray, held: np.ndarray, bits: int, room: int = HELD) -> Iterator[tuple[int, str]]:
    """(row, neighbour) of the words of one length in points (a row each) for their distinct deletions, replacements and insertions that pass the filter.

    A deletion in a run of one letter is taken at the run's end only, and a letter is put in only before another one, so none comes twice.
    """
    n, length = points.shape
    own, power = points.astype(np.uint64), _powers(length + 1)
    terms = own * power[:length]
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, 1, dtype=np.uint64)], 1)
    after = before[:, -1:] - before
    letters = alphabet.astype(np.uint64)
    inverse = np.uint64(pow(int(FACTOR), -1, 1 << 64))
    word = lambda r, at, skip, c: "".join(map(chr, [*points[r, :at], *c, *points[r, at + skip :]]))

    step = max(1, room // max(1, n * len(letters)))
    for lo in range(0, length + 1, step):
        at = np.arange(lo, min(length + 1, lo + step))
        inside = at[at < length]
        if len(inside):
            last = np.ones((n, len(inside)), bool)
            more = inside[inside + 1 < length]
            last[:, : len(more)] = points[:, more] != points[:, more + 1]
            gone = before[:, inside] + after[:, inside + 1] * inverse
            for r, k in zip(*np.nonzero(last & in_filter(held, gone, bits))):
                yield int(r), word(r, inside[k], 1, ())
            base = before[:, inside] + after[:, inside + 1]
            changed = base[:, :, None] + (letters[None] * power[inside][:, None])[None]
            for r, k, c in zip(*np.nonzero((points[:, inside, None] != alphabet) & in_filter(held, changed, bits))):
                yield int(r), word(r, inside[k], 1, (alphabet[c],))
        grown = (before[:, at] + after[:, at] * FACTOR)[:, :, None] + (letters[None] * power[at][:, None])[None]
        fresh = np.ones(grown.shape, bool)
        fresh[:, : len(inside)] = points[:, inside, None] != alphabet
        for r, k, c in zip(*np.nonzero(fresh & in_filter(held, grown, bits))):
            yield int(r), word(r, at[k], 0, (alphabet[c],))


def _points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def _by_length(words: list[str]) -> Iterator[list[str]]:
    lengths: dict[int, list[str]] = {}
    for w in words:
        lengths.setdefault(len(w), []).append(w)
    yield from lengths.values()


def _filter(vocab: DataFrame, bits: int) -> np.ndarray:
    """The filter's bytes, built by an aggregation of 64-bit words on the executors."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same in _by_length(batch.column("word").to_pylist()):
                both = np.concatenate(places(hashes(_points(same)), bits))
                yield pa.RecordBatch.from_arrays([pa.array(both.astype(np.int64))], names=["place"])

    found = vocab.select("word").mapInArrow(kernel, "place long")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))
    rows = found.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(one).alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), "<i8")
    out[np.asarray(rows["at"], np.int64)] = np.asarray(rows["mask"], np.int64)
    return out.view(np.uint8)


def near_words(vocab: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, most_bits: int = FILTER_BITS) -> DataFrame:
    """(word, near, n) of each two words of vocab (word, n), distinct words, that differ by exactly one inserted, deleted or replaced code point, and of
    each word with itself; n is that of near."""
    spark = vocab.sparkSession
    size = vocab.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    letters = vocab.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.uint32)  # at most the letters that a run may hold
    bits = min(most_bits, max(13, (16 * size["n"]).bit_length()))
    shared = spark.sparkContext.broadcast(_filter(vocab, bits))

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        def found(words: list[str]) -> Iterator[tuple]:
            held = shared.value
            for same in _by_length(words):
                group = max(1, HELD // ((len(same[0]) + 1) * max(1, len(alphabet))))
                for at in range(0, len(same), group):
                    part = same[at : at + group]
                    yield from zip(part, part)
                    for r, near in neighbours(_points(part), alphabet, held, bits):
                        yield part[r], near

        some: list[str] = []
        weight = 0
        for (word,) in rows:
            some.append(word)
            weight += len(word)
            if weight >= 1 << 16:
                yield from found(some)
                some, weight = [], 0
        yield from found(some)

    # few bytes make many neighbours, so the words are dealt by number and not by size
    dealt = vocab.select("word").repartition(max(8, size["n"] // WORDS_A_TASK), "word")
    asked = per_document(dealt, kernel, pa.schema([("word", pa.string()), ("near", pa.string())]), "word string, near string", rows=1 << 14)
    known = vocab.select(F.col("word").alias("near"), "n")
    return asked.join(F.broadcast(known) if size["bytes"] + 16 * size["n"] <= broadcast_bytes else known, "near").select("word", "near", "n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form), distinct words without a cycle: the last word that forms lead to. A round doubles the steps taken."""
    at = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if not at.join(further, "root", "left_semi").limit(1).count():
            return at
        at = checkpointed(at.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES, cut_each: int = CUT_EACH) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the vocabulary of docs.

    form is the near word with the largest n, ties to the smallest in code-point order, if that n is at least times the word's own; root is where
    forms lead. Null and empty texts have no words; each row counts, also one that repeats; a row without a doc_id counts with an empty one. No
    words, no rows. Other columns aren't read. Long words are as good as short ones.
    """
    vocab = checkpointed(vocabulary(docs.select("doc_id", "text"), min_length, min_count, cut_each))
    own = F.col("word") == F.col("near")
    best = F.min(F.when(~own, F.struct((-F.col("n")).alias("less"), F.col("near").alias("form"))))
    found = near_words(vocab).groupBy("word").agg(F.max(F.when(own, F.col("n"))).alias("n"), F.count_if(~own).alias("n_near"), best.alias("best"))
    led = -F.col("best.less") >= times * F.col("n")
    judged = checkpointed(found.select("word", "n", "n_near", F.when(led, F.col("best.form")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n")))
    ends = roots(judged.where("form is not null").select("word", "form"))
    out = judged.where("form is not null").join(ends, "word").unionByName(judged.where("form is null").withColumn("root", F.col("word")))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


QUERIES = {"op12_spelling": op12_spelling}
ORACLE_SQL = {
    "op12_spelling": f"""
with recursive o as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{UPPER}', '{LOWER}') as w from documents),
p as (select doc_id, w, doc_id || ':' || w as m, count(*) as n from o group by all),
m as (select distinct m from p),
{CRC_TABLES}
h as (select m, crc as h from ({crc_of("m")})),
c as (select case when h % 199 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, n from p join h using (m)),
v as (select word, sum(n)::bigint as n from c where length(word) >= 6 group by 1 having sum(n) >= 5),
g as (select word, n, unnest(range(1, length(word) + 1)) as i from v),
k as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as cut from g),
e as (select word, near from (
        select a.word, b.word as near from k a join k b on a.cut = b.cut and a.i = b.i and a.word <> b.word
        union all select k.word, v.word from k join v on v.word = k.cut union all select v.word, k.word from k join v on v.word = k.cut) group by all),
r as (select e.word, near, v.n, row_number() over (partition by e.word order by v.n desc, near) as r, count(*) over (partition by e.word) as n_near from e join v on v.word = e.near),
f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when r.n >= 5 * v.n then near end as form, case when r.n >= 5 * v.n then r.n end as form_n
      from v left join (select * from r where r = 1) r on r.word = v.word),
w as (select word, word as root, 0 as d from f union all select w.word, f.form, d + 1 from w join f on f.word = w.root where f.form is not null)
select f.word, form, root, n, n_near, form_n from f join (select word, arg_max(root, d) as root from w group by 1) using (word)
"""
}
