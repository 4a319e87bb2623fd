"""Toxicity by a chain of linear classifiers.

Each category has a logistic model over the presence of words; the models stand in a chain, and a later one also gets the probabilities of the
categories before it. In training those are out-of-fold predictions, so that a later model meets inputs of the quality it will get; in scoring they
come from the models fitted on the whole sample. The models are fitted on a bounded sample of labelled documents and score every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import appended, checkpointed, filtering, per_document, table

#: At most so many labelled documents, those with the smallest hash of doc_id, are used for fitting.
SAMPLE = 10_000
#: Words of a model: of those in at least so many documents of the sample, so many with the largest chi-square.
MIN_DOCUMENTS, WORDS = 8, 500
#: Words that reach the driver for each category, those with the largest chi-square over the sample.
VOCABULARY = 1500
#: Weight of the absolute values of a model's word weights against its mean loss, and steps of the fit.
PENALTY, ROUNDS = 0.002, 300
FOLDS = 3
#: Probabilities from which a category may count as present; each category takes the one with the best F1 on its out-of-fold predictions.
THRESHOLDS = [k / 20 for k in range(2, 17)]
#: Category and its condition on the labels, in the order of the chain. The table has two labels; the third category is where they meet.
CATEGORIES = [("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_low_quality", "toxic = 1 and quality = 0")]
#: The category that decides.
DECIDES = "toxic"
_WORD = re.compile(r"[^\W\d_]+")


#: Lengths of the word beginnings that are counted as stems.
STEMS = (5, 7)


def words_of(text: str | None) -> set[str]:
    """The words of a text, and ``stem**`` and ``stem***`` for a stem that begins two, or three or more, different longer words."""
    words = set(_WORD.findall(text.lower())) if text else set()
    out = words
    for n in STEMS:
        more = [(stem, k) for stem, k in Counter([w[:n] for w in words if len(w) > n]).items() if k > 1]
        out = out | {stem + "**" for stem, _ in more} | {stem + "***" for stem, k in more if k > 2}
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Linear:
    """Logistic regression over present words and given probabilities, by accelerated proximal gradients; an L1 penalty leaves out words of chance."""

    def __init__(self, rows: list[list[int]], names: list[str], chained: np.ndarray, y: np.ndarray) -> None:
        count = np.bincount(np.concatenate([*map(np.asarray, rows), np.empty(0, int)]).astype(int), minlength=len(names)).astype(float)
        n, pos = max(1, len(rows)), float(y.sum())
        with_y = np.bincount(np.concatenate([*(np.asarray(r) for r, v in zip(rows, y) if v), np.empty(0, int)]).astype(int), minlength=len(names)).astype(float)
        expected = count * pos / n
        chi = np.where(count > 0, (with_y - expected) ** 2 / np.maximum(expected * (1 - count / n), 1e-9), 0)
        chosen = np.sort(np.argsort(-chi, kind="stable")[:WORDS])
        place = np.full(len(names), -1)
        place[chosen] = np.arange(len(chosen))
        cols = [place[np.asarray(r, int)] for r in rows]
        cols = [c[c >= 0] for c in cols]
        at = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
        col = np.concatenate([*cols, np.empty(0, int)]).astype(int)
        k, m = len(chosen), chained.shape[1]
        logit = _logit(chained)
        self.middle = logit.mean(0) if len(logit) else np.zeros(m)
        spread = logit.std(0) if len(logit) else np.ones(m)
        self.spread = np.where(spread > 1e-6, spread, np.inf)  # a category that never varies says nothing
        logit = (logit - self.middle) / self.spread
        times = lambda w: np.bincount(at, w[col], minlength=len(rows)) + logit @ w[k:-1] + w[-1]
        back = lambda e: np.concatenate([np.bincount(col, e[at], minlength=k), logit.T @ e, [e.sum()]])
        v = np.ones(k + m + 1)
        for _ in range(20):
            v = back(times(v)) / n
            v /= largest if (largest := float(np.linalg.norm(v))) else 1.0
        rate = 1 / (0.26 * max(float(np.linalg.norm(back(times(v)) / n)), 1e-9))
        w = np.zeros(k + m + 1)
        w[-1] = np.log((pos + 0.5) / (n - pos + 0.5))
        ahead, t = w, 1.0
        for _ in range(ROUNDS):
            new = ahead - rate * back((1 / (1 + np.exp(-np.clip(times(ahead), -30, 30))) - y) / n)
            new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - rate * PENALTY, 0)
            later = (1 + (1 + 4 * t * t) ** 0.5) / 2
            ahead, w, t = new + (t - 1) / later * (new - w), new, later
        self.words = {names[c]: float(v) for c, v in zip(chosen, w) if v}
        self.chain, self.bias = w[k:-1].tolist(), float(w[-1])
        self.threshold = 0.5

    def __call__(self, words: set[str], before: list[float]) -> float:
        own = self.words
        z = self.bias + sum(own[w] for w in sorted(words & own.keys()))
        if before:
            z += float((_logit(np.array(before)) - self.middle) / self.spread @ np.array(self.chain))
        return float(1 / (1 + np.exp(-min(max(z, -30), 30))))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Of THRESHOLDS the one with the largest F1, ties to the one nearest to a half, then to the smaller."""
    f1 = lambda t: 2 * float(((p >= t) & (y > 0)).sum()) / max(1.0, float((p >= t).sum() + (y > 0).sum()))
    return min(THRESHOLDS, key=lambda t: (-f1(t), abs(t - 0.5), t))


def fit_chain(words: pa.ListArray, labels: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """A model for each column of labels from the words of each example; an empty sample gives none."""
    if not len(words):
        return []
    flat = words.flatten().dictionary_encode()
    index, ends = np.asarray(flat.indices), np.asarray(words.offsets) - words.offsets[0].as_py()
    often = np.flatnonzero(np.bincount(index, minlength=len(flat.dictionary)) >= min(MIN_DOCUMENTS, len(words)))
    place = np.full(len(flat.dictionary), -1)
    place[often] = np.arange(len(often))
    names = flat.dictionary.take(pa.array(often)).to_pylist()
    rows = [r[r >= 0] for r in (place[index[a:b]] for a, b in zip(ends[:-1], ends[1:]))]
    fold = np.arange(len(rows)) % folds
    chained, models = np.empty((len(rows), 0)), []
    for y in labels.T.astype(float):
        out = np.zeros(len(rows))
        for f in range(folds):
            held, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(held) and len(rest):
                own = Linear([rows[i] for i in rest], names, chained[rest], y[rest])
                out[held] = [own({names[j] for j in rows[i]}, chained[i].tolist()) for i in held]
        models.append(Linear(rows, names, chained, y))
        models[-1].threshold = best_threshold(out, y)
        chained = np.column_stack([chained, out])
    return models


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[pa.ListArray, np.ndarray]:
    """Words and category flags of at most limit labelled documents. Rows with a null label or text are no examples; of repeated doc_ids one counts.

    Only the words that may enter a model reach the driver: those of the vocabulary, which is counted and chosen on the executors."""
    flags = [F.expr(c).cast("int").alias(f"y{k}") for k, (_, c) in enumerate(CATEGORIES)]
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = chosen.select("doc_id", *flags).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, *y in rows:
            yield doc_id, sorted(words_of(text)), y

    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.string())), ("y", pa.list_(pa.int32()))])
    rows = per_document(texts, kernel, schema, "doc_id long, words array<string>, y array<int>")
    rows = checkpointed(rows.groupBy("doc_id").agg(F.min(F.struct("words", "y")).alias("r")).select("doc_id", "r.words", "r.y"))
    held = [F.sum(F.get("y", F.lit(k))) for k in range(len(CATEGORIES))]
    n, *positive = rows.agg(F.count("*"), *held).first()
    words = rows.select(F.explode("words").alias("word"), "y").groupBy("word").agg(F.count("*").alias("c"), *(h.alias(f"p{k}") for k, h in enumerate(held)))
    words = checkpointed(words.where(F.col("c") >= min(MIN_DOCUMENTS, n)))
    vocabulary: set[str] = set()
    for k, p in enumerate(positive):
        expected = F.col("c") * float(p or 0) / max(n, 1)
        chi = (F.col(f"p{k}") - expected) ** 2 / F.greatest(expected * (1 - F.col("c") / max(n, 1)), F.lit(1e-9))
        vocabulary |= {r["word"] for r in words.orderBy(F.desc(chi), "word").limit(VOCABULARY).select("word").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def known(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, words, y in rows:
            yield doc_id, [w for w in words if w in shared.value], y

    found = per_document(rows, known, schema, "doc_id long, words array<string>, y array<int>").toArrow().sort_by("doc_id").combine_chunks()
    words, y = found["words"].combine_chunks(), np.array(found["y"].to_pylist(), int).reshape(-1, len(CATEGORIES))
    return words if isinstance(words, pa.Array) else words.chunk(0), y


def _judged(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(fit_chain(*labelled_sample(docs, labels, sample)))
    names = [c for c, _ in CATEGORIES]
    decides = names.index(DECIDES)

    def kernel(text: str | None) -> tuple:
        words, before = words_of(text), []
        for model in shared.value:
            before.append(model(words, before))
        before += [0.0] * (len(names) - len(before))
        return *before, bool(words) and bool(shared.value) and before[decides] >= shared.value[decides].threshold

    return appended(docs, ["text"], kernel, [*((c, pa.float64(), "double") for c in names), ("flagged", pa.bool_(), "boolean")])


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, a double for each category, flagged) of each row of docs. A null or empty text has no words, so it gets the models' bias and is not
    flagged; without labelled documents every probability is 0."""
    found = _judged(docs.select("doc_id", "text"), labels, sample)
    return found.select("doc_id", *(F.col(f"__{c}").alias(c) for c, _ in CATEGORIES), F.col("__flagged").alias("flagged"))


@filtering
def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that the chain flags; every row is judged by its own text, in one pass."""
    return _judged(docs, labels, sample).where("not __flagged").select(docs.columns)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("flagged", "is_toxic")


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
