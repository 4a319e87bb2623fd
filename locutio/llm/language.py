"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams (1 to 3 characters, words padded) in all learning documents, by rank. A
document is ranked the same way and goes to the language whose profile has the smallest out-of-place distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import checkpointed, per_document, table

#: N-grams of a profile and of a document.
RANKS = 400
#: Profiles go to every executor: RANKS rows a language, for at most so many languages. More raise an error.
MAX_LANGUAGES = 1000
_PIECE = 1 << 20
_NO_LETTER = re.compile(r"[\W\d_]")
_classes: dict = {}


def _letters() -> np.ndarray:
    """Lower-case code of each letter up to U+FFFF; 0 for what is no letter."""
    if "letters" not in _classes:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _classes["letters"] = out
    return _classes["letters"]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the words of a text, as 63-bit codes, with counts. Words are runs of letters; 1 stands for a word's edge."""
    codes, counts = [], []
    ends = [0]
    while text and ends[-1] < len(text):  # a piece ends where no letter is
        ends.append(m.start() if (m := _NO_LETTER.search(text, ends[-1] + _PIECE)) else len(text))
    for at, end in zip(ends, ends[1:]):
        raw = np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.concatenate([[0], _letters()[raw], [0]]).astype(np.uint64)
        edge = x == 0
        x = x[~(edge & np.concatenate([[False], edge[:-1]]))]
        if len(x) < 3:
            continue
        x = np.where(x == 0, np.uint64(1), x)
        two = (x[:-1] << np.uint64(21)) | x[1:]
        three = (two[:-1] << np.uint64(21)) | x[2:]
        # no n-gram reaches over a word's edge
        grams = np.concatenate([x[x != 1], two, three[x[1:-1] != 1]])
        c, n = np.unique(grams, return_counts=True)
        codes.append(c)
        counts.append(n)
    if not codes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(codes) == 1:
        return codes[0], counts[0]
    c, back = np.unique(np.concatenate(codes), return_inverse=True)
    return c, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent codes first, ties to the smaller code."""
    if len(codes) > 4 * ranks:
        least = np.partition(counts, len(counts) - ranks)[len(counts) - ranks]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:ranks]


def profiles(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, gram, rank) from the rows (lang, text) of docs with neither null; counted over all of them, partial sums in each task."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            c, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return c, np.bincount(back, np.concatenate([p[1] for p in parts]), len(c)).astype(np.int64)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = held.setdefault(lang, [])
                parts.append(ngram_counts(text))
                if len(parts) >= 64:
                    held[lang] = [merged(parts)]
        for lang, parts in held.items():
            c, n = merged(parts)
            for at in range(0, len(c), 50_000):
                k = len(c[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(c[at : at + k].astype(np.int64)), pa.array(n[at : at + k])], names=["lang", "gram", "n"])

    counts = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(counted, "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # a limit on the row number itself is applied in each task before the shuffle, so one language costs a task its first ranks only
    return total.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= ranks).select("lang", "gram", (F.col("nth") - 1).alias("rank"))


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], ranks: int = RANKS) -> None:
        self.languages = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.languages)}
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64).astype(np.uint64))
        self.place = np.full((len(self.languages), len(self.grams) + 1), -1, np.int32)
        for lang, gram, rank in rows:
            self.place[at[lang], np.searchsorted(self.grams, np.uint64(gram))] = rank
        self.ranks = ranks

    def best(self, text: str | None) -> tuple[str, float]:
        """Language and 1 minus the distance's share of the largest possible; und and 0 without a letter or without profiles."""
        top = ranked(*ngram_counts(text), self.ranks)
        if not len(top) or not self.languages:
            return "und", 0.0
        k = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        k = np.where(self.grams[k] == top, k, len(self.grams))
        there = self.place[:, k]
        far = np.where(there < 0, self.ranks, np.abs(there - np.arange(len(top)))).sum(1)
        i = int(far.argmin())
        return self.languages[i], 1 - float(far[i]) / (self.ranks * len(top))


def identified(docs: DataFrame, learn: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs from profiles of learn (lang, text). Ties go to the first language by name."""
    own = checkpointed(profiles(learn, ranks))
    if (n := own.select("lang").distinct().count()) > MAX_LANGUAGES:
        raise ValueError(f"{n} languages; at most {MAX_LANGUAGES} profiles are sent to the executors")
    local = own.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast([*zip(*(c.to_pylist() for c in local.columns), strict=True)])
    held: list[Profiles] = []

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        if not held:
            held.append(Profiles(shared.value, ranks))
        for doc_id, text in rows:
            yield doc_id, *held[0].best(text)

    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    return per_document(docs.select("doc_id", "text"), kernel, schema, "doc_id long, lang_pred string, score double")


def held_out() -> object:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identified(docs, docs.where(~held_out()).select("lang", "text"))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language": op3_language}
ORACLE_SQL: dict[str, str] = {}
