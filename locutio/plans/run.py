"""The whole run over many speeches: files to cues, claims, verdicts, summary and stored tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..criteria.base import Criterion
from ..criteria.registry import DEFAULT, criterion
from ..functions.languages import detected
from ..operators import evaluate, metrics, report, segment, store
from ..operators.evaluate import Backend
from ..operators.stored import stored
from ..sources.subtitles import PARSER_VERSION, transcripts

SCHEMA_VERSION = 1


@dataclass
class Options:
    criterion: str = DEFAULT
    model: str = "qwen2.5:3b"
    threshold: float = evaluate.THRESHOLD
    retries: int = evaluate.RETRIES
    concurrency: int | None = None
    lang: str | None = None
    use_gate: bool = True
    limit: int | None = None
    cache: DataFrame | None = None
    write_cache: bool = True
    force: bool = False
    store: str | None = None
    progress: Callable[[dict], None] | None = None

    def __post_init__(self) -> None:
        for ok, said in (
            (0 <= self.threshold <= 1, "umbral debe estar entre 0 y 1"),
            (self.limit is None or self.limit >= 1, "limite debe ser 1 o mas"),
            (self.retries >= 0, "reintentos debe ser 0 o mas"),
            (self.concurrency is None or 1 <= self.concurrency <= 16, "concurrencia debe estar entre 1 y 16"),
        ):
            if not ok:
                raise ValueError(said)


@dataclass
class Run:
    transcripts: DataFrame
    claims: DataFrame
    results: DataFrame
    summary: DataFrame
    criterion: Criterion
    threshold: float
    write_cache: bool = True
    model: str = Options.model

    def recall(self) -> DataFrame:
        """Recall of the gate; only an ungated run tells it."""
        rows = self.results.withColumn("score", F.col("evaluacion.score"))
        out = metrics.gate_recall(rows, ["doc_id"], self.threshold)
        return out.withColumn("veredicto", metrics.recall_verdict(F.col("recall")))

    def report(self, path: str) -> None:
        """A page and an export for each document with claims, under path/paginas and path/csv."""
        rows = stored(report.report_rows(self.results))
        report.write_pages(report.pages(rows, self.criterion, self.threshold), f"{path}/paginas")
        report.write_pages(report.csv_pages(report.visible(rows, self.threshold)), f"{path}/csv")

    def write(self, path: str) -> None:
        """Tables transcripts, claims, results, summary and cache under path, a store that many runs share.

        A run replaces what the store holds of its own documents: transcripts by document, the next three by criterion, model and document, with the
        versions of prompt, schema and validator. The cache grows by the keys it lacks, unless the run was told not to write it.
        """
        documents = stored(self.transcripts.select("doc_id"))
        store.upsert(self.transcripts, documents, path, "transcripts", {})
        stamp = {"hash_prompt": self.criterion.prompt_hash, "version_esquema": SCHEMA_VERSION, "version_validador": self.criterion.validator_version}
        for name in ("claims", "results", "summary"):
            rows = getattr(self, name).withColumns({k: F.lit(v) for k, v in stamp.items()})
            store.upsert(rows, documents, path, name, {"criterio": self.criterion.id, "modelo": self.model})
        if not self.write_cache:
            return
        fresh = evaluate.new_cache_rows(self.results)
        if (before := read_cache(fresh.sparkSession, path, self.criterion.id)) is not None:
            fresh = fresh.join(before.select("clave"), "clave", "left_anti")
        fresh.withColumn("criterio", F.lit(self.criterion.id)).write.mode("append").partitionBy("criterio").parquet(f"{path}/cache")


def parsed_once(files: DataFrame, path: str | None, force: bool = False, lang: str | None = None) -> DataFrame:
    """Transcripts of files: those that the store at path holds with cues, made by the present parser, are taken from there, only the others are parsed.
    force parses all. idioma_documento is lang or what the whole text is in, duracion the end of the last cue."""

    def told(found: DataFrame) -> DataFrame:
        cues = F.col("segmentos")
        named = F.lit(lang) if lang else F.when(F.size(cues) > 0, detected(segment.joined_text(cues))).otherwise("und")
        return found.withColumn("idioma_documento", named).withColumn("duracion", F.get(cues, F.size(cues) - 1).fin)

    rows = store.read(files.sparkSession, path, "transcripts") if path and not force else None
    held = store.current(rows, {"version_parseo": PARSER_VERSION})
    if held is None:
        return told(transcripts(files))
    held = held.where(F.size("segmentos") > 0).join(files.select("doc_id").distinct(), "doc_id", "left_semi")
    new = told(transcripts(files.join(held.select("doc_id"), "doc_id", "left_anti")))
    return new.unionByName(held.select(new.columns))


def read_cache(spark: SparkSession, path: str, criterion_id: str) -> DataFrame | None:
    """Stored verdicts of a criterion in the present version, or None if nothing is stored."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(f"{path}/cache")
    except AnalysisException:
        return None
    return rows.where((F.col("criterio") == criterion_id) & (F.col("version") == evaluate.CACHE_VERSION)).select("clave", "evaluacion")


def run(files: DataFrame, backend: Backend, options: Options | None = None) -> Run:
    """files (doc_id, path, content). Files without cues stay in transcripts with their problem and give no claims."""
    o = options or Options()
    c = criterion(o.criterion)
    parsed = parsed_once(files, o.store, o.force, o.lang)
    if o.store:
        # the store's files are replaced by what is read from them
        parsed = stored(parsed)
    # every round and every table reads the claims, so they are made once
    claims = stored(segment.claims(parsed.select("doc_id", "segmentos"), c.gate, o.lang, o.use_gate, o.limit))
    if o.concurrency is not None and isinstance(backend, evaluate.External):
        backend = evaluate.External(backend.make, o.concurrency)
    results = stored(evaluate.evaluated(claims, c, backend, o.model, o.retries, None if o.force else o.cache, o.progress))
    return Run(parsed, claims, results, metrics.full_summary(results, ["doc_id"], o.threshold), c, o.threshold, o.write_cache, o.model)


def transcript_facts(parsed: DataFrame) -> DataFrame:
    """(doc_id, n_cues, duracion, palabras): length in seconds is the end of the last cue."""
    from ..functions.text import word_count

    cues = F.col("segmentos")
    return parsed.select("doc_id", F.size(cues).alias("n_cues"), F.get(cues, F.size(cues) - 1).fin.alias("duracion"), word_count(segment.joined_text(cues)).alias("palabras"))
