"""How the tables of the test data stand in for speeches, cues, results and control sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexicon import Entry, Gate
from ..sources.subtitles import CUES

# Frequent function-word runs, a lexicon that fires on invented prose.
TEST_ENTRIES = [
    Entry("of the", "of the", "en"), Entry("and the", "and the", "en"), Entry("in the", "in the", "en"), Entry("that", "that", "en"), Entry("de la", "de la", "es"), Entry("que", "que", "es"),
    Entry("le", "le", "fr"), Entry("des", "des", "fr"), Entry("der", "der", "de"), Entry("die", "die", "de"), Entry("que la", "que la", "es"),
]
TEST_GATE = Gate(TEST_ENTRIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Labels of up to so many bytes as stored go to every executor.
SMALL_LABELS = 8 << 20


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Inputs below are dealt over all cores first: a small file is one row group, which one task would read and parse alone.
SMALL = 128 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    if _bytes(docs) < SMALL:
        return docs.repartition(spark.sparkContext.defaultParallelism)
    return docs


def speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, content): each line of a document a paragraph."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", "lang", "source", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, indice, texto): lines of 15 characters or more."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("indice", "texto"))
    return docs.where(F.length("texto") >= 15)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, segmentos): the turns of a conversation as cues, each as long as it takes to say at 2.5 words a second."""
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    start = F.struct(F.array().cast(CUES).alias("out"), F.lit(0.0).alias("now"))

    def step(acc, t):
        end = acc.now + F.size(F.split(t.text, " ")) / 2.5
        return F.struct(F.array_append(acc.out, F.struct(acc.now.alias("inicio"), end.alias("fin"), t.text.alias("texto"))).alias("out"), end.alias("now"))

    return ordered.select(F.col("conv_id").alias("doc_id"), F.aggregate("t", start, step, lambda a: a.out).alias("segmentos"))


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, segmentos): twelve words a cue, which overlap by four in documents with an even id and not in the others."""
    docs = documents(spark, sf_dir).select("doc_id", F.filter(F.split("text", "\\s+"), lambda w: w != "").alias("w"))
    move = F.when(F.col("doc_id") % 2 == 0, 8).otherwise(12)
    n = F.greatest(F.lit(1), F.ceil(F.size("w") / move)).cast("int")
    cue = lambda k: F.struct(k.cast("double").alias("inicio"), (k + 1.5).cast("double").alias("fin"), F.array_join(F.slice("w", k * move + 1, 12), " ").alias("texto"))
    return docs.where(F.size("w") > 0).select("doc_id", F.transform(F.sequence(F.lit(0), n - 1), cue).alias("segmentos"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of an ungated run over the labelled documents: (doc_id, indice, lang, source, marcadores, preseleccionada, evaluada, score)."""
    labels = table(spark, sf_dir, "labels")
    docs = documents(spark, sf_dir).select("doc_id", F.lit(0).alias("indice"), "lang", "source", "text", "n_chars")
    marks = TEST_GATE.markers(F.col("text")).alias("marcadores")
    if _bytes(labels) <= SMALL_LABELS:
        # only texts that are labelled are gated, and none is shuffled
        found = docs.join(F.broadcast(labels), "doc_id").select("*", marks)
    else:
        found = docs.select("doc_id", "indice", "lang", "source", marks, "n_chars").join(labels, "doc_id")
    score = F.col("n_chars") % 101 / 100
    return found.select("doc_id", "indice", "lang", "source", "marcadores", (F.size("marcadores") > 0).alias("preseleccionada"), (F.col("quality") == 1).alias("evaluada"), score.alias("score"))
