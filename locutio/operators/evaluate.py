"""Evaluation of selected claims by a model behind a port, with a versioned cache and retries.

Claims with one text are asked once: the distinct keys that the cache doesn't hold go to the backend, and the verdicts are joined back. A backend is any
object with ``answers(asked, attempt)``: rows (clave, sistema, prompt) in, rows (clave, texto, fallo, ms, ms_carga, ms_generacion, tokens) out. Rounds are
whole DataFrames: the first sends the prompt, later ones a correction to what failed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..criteria.base import VERDICT, Criterion
from ..functions.text import evaluation_key, fixed
from .stored import stored

ANSWER = "clave string, texto string, fallo string, ms double, ms_carga double, ms_generacion double, tokens bigint"
RETRIES, THRESHOLD, CACHE_VERSION = 2, 0.7, 2
OMITTED = "no contiene ningun marcador lexico del criterio (prefiltro)"
NO_JSON = "el modelo no devolvio un JSON valido"
NO_ANSWER = "sin respuesta"
#: Fixed value: seconds to wait after a call that failed.
PAUSE = 0.4


class Backend(Protocol):
    def answers(self, asked: DataFrame, attempt: int) -> DataFrame: ...


class Scripted:
    """The same list of answers for each key, in order; the last repeats. An Exception in the list is a transport failure."""

    def __init__(self, script: list[str | Exception], ms: float = 1.0, tokens: int = 10) -> None:
        self.script, self.ms, self.tokens = script, ms, tokens

    def answers(self, asked: DataFrame, attempt: int) -> DataFrame:
        said = self.script[min(attempt, len(self.script)) - 1]
        failed = isinstance(said, Exception)
        text, error = (F.lit(None).cast("string"), F.lit(str(said))) if failed else (F.lit(said), F.lit(None).cast("string"))
        took = F.lit(0.0 if failed else self.ms)
        return asked.select("clave", text.alias("texto"), error.alias("fallo"), took.alias("ms"), F.lit(0.0).alias("ms_carga"), took.alias("ms_generacion"), F.lit(0 if failed else self.tokens).cast("bigint").alias("tokens"))


class Replay:
    """Answers that were recorded: (clave, intento, texto, ...); the last attempt of a key repeats."""

    def __init__(self, recorded: DataFrame) -> None:
        self.recorded = recorded

    def answers(self, asked: DataFrame, attempt: int) -> DataFrame:
        own = self.recorded.where(F.col("intento") <= attempt).groupBy("clave").agg(F.max_by("texto", "intento").alias("texto"))
        found = asked.select("clave").join(own, "clave", "left")
        zero = F.lit(0.0)
        return found.select("clave", "texto", F.when(F.col("texto").isNull(), "sin respuesta grabada").alias("fallo"), zero.alias("ms"), zero.alias("ms_carga"), zero.alias("ms_generacion"), F.lit(0).cast("bigint").alias("tokens"))


class External:
    """Any callable (system, prompt) -> dict of text and timings, run where the rows are; a partition for each concurrent caller.

    make runs once a partition, so a model is loaded once. An exception is the row's failure and not the job's.
    """

    def __init__(self, make: Callable[[], Callable[[str, str], dict]], concurrency: int = 1) -> None:
        self.make, self.concurrency = make, concurrency

    def answers(self, asked: DataFrame, attempt: int) -> DataFrame:
        make = self.make

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = make()
            for batch in batches:
                rows = []
                for key, system, prompt in zip(batch.clave, batch.sistema, batch.prompt):
                    try:
                        r = call(system, prompt)
                        rows.append((key, r["texto"], None, r.get("ms", 0.0), r.get("ms_carga", 0.0), r.get("ms_generacion", 0.0), r.get("tokens", 0)))
                    except Exception as e:  # noqa: BLE001  a failed call is a result
                        rows.append((key, None, str(e), 0.0, 0.0, 0.0, 0))
                        time.sleep(PAUSE)
                yield pd.DataFrame(rows, columns=["clave", "texto", "fallo", "ms", "ms_carga", "ms_generacion", "tokens"])

        return asked.select("clave", "sistema", "prompt").repartition(self.concurrency, "clave").mapInPandas(ask, ANSWER)


def keyed(claims: DataFrame, criterion: Criterion, model: str) -> DataFrame:
    return claims.withColumn("clave", evaluation_key(F.lit(model), F.lit(criterion.prompt_hash), F.col("texto")))


def evaluated(claims: DataFrame, criterion: Criterion, backend: Backend, model: str = "qwen2.5:3b", retries: int = RETRIES, cache: DataFrame | None = None, progress: Callable[[dict], None] | None = None) -> DataFrame:
    """claims plus evaluada, desde_cache, evaluacion, ajustes, error, motivo_omision, intentos, ms_llm, ms_carga, ms_generacion and tokens.

    cache holds (clave, evaluacion) and may be None, which reads nothing. A cached verdict counts no attempt. Claims that the gate left out take no part in
    the joins. A key for which the backend returns no row has failed in that attempt. progress is told of each round: vuelta, preguntadas, listas, llamadas,
    tokens and tokens_por_segundo of that round's keys.
    """
    rows = keyed(claims, criterion, model)
    picked = F.coalesce("preseleccionada", F.lit(False))
    omitted, selected = rows.where(~picked), rows.where(picked)
    if cache is not None:
        hit = cache.select("clave", F.col("evaluacion").alias("_cached")).dropDuplicates(["clave"])
        selected = selected.join(hit, "clave", "left")
    else:
        selected = selected.withColumn("_cached", F.lit(None).cast(VERDICT))
    # ids repeat across documents, and equal texts may differ in language: the first document's is asked
    first = F.struct(*(c for c in ("doc_id", "id") if c in claims.columns), F.coalesce("idioma_nombre", F.lit("")))
    open_ = selected.where("_cached is null").groupBy("clave").agg(F.min_by("texto", first).alias("texto"), F.min_by("idioma_nombre", first).alias("idioma_nombre"))
    open_ = open_.withColumn("problema", F.lit(None).cast("string"))
    zero = {"ms": F.lit(0.0), "ms_carga": F.lit(0.0), "ms_generacion": F.lit(0.0), "tokens": F.lit(0).cast("bigint"), "llamadas": F.lit(0).cast("bigint")}
    open_ = open_.select("*", *(v.alias(f"_{k}") for k, v in zero.items()))
    done: DataFrame | None = None
    for attempt in range(1, retries + 2):
        text, lang = F.col("texto"), F.col("idioma_nombre")
        prompt = criterion.prompt(text, lang) if attempt == 1 else criterion.correction(text, lang, F.col("problema"))
        asked = open_.select("clave", F.lit(criterion.system_prompt).alias("sistema"), prompt.alias("prompt"))
        got = backend.answers(asked, attempt).withColumnRenamed("texto", "_answer")
        tried = open_.join(got.withColumn("_got", F.lit(True)), "clave", "left")
        tried = tried.withColumn("fallo", F.coalesce("fallo", F.when(F.col("_got").isNull(), NO_ANSWER))).drop("_got")
        for k in ("ms", "ms_carga", "ms_generacion", "tokens"):
            tried = tried.withColumn(f"_{k}", F.col(f"_{k}") + F.coalesce(k, F.lit(0)))
        tried = tried.withColumn("_llamadas", F.col("_llamadas") + F.col("fallo").isNull().cast("bigint"))
        verdict = F.when(F.col("fallo").isNull(), criterion.validated(F.col("_answer")))
        tried = tried.withColumn("_v", verdict).withColumn("problema", F.coalesce(F.col("fallo"), F.col("_v").problema))
        # each answer is asked for once, so a round ends in a table
        tried = stored(tried.select("clave", "texto", "idioma_nombre", "problema", *(f"_{k}" for k in zero), "_v", F.lit(attempt).alias("_n")))
        ok = F.coalesce(F.col("_v.ok"), F.lit(False))
        if progress is not None:
            progress(_round(tried, ok, attempt))
        over = tried if attempt == retries + 1 else tried.where(ok)
        done = over if done is None else done.unionByName(over)
        open_ = tried.where(~ok).drop("_v", "_n")
    out = selected.join(done.drop("texto", "idioma_nombre"), "clave", "left").unionByName(omitted, allowMissingColumns=True)
    cached = F.col("preseleccionada") & F.col("_cached").isNotNull()
    good = F.col("preseleccionada") & F.coalesce(F.col("_v.ok"), F.lit(False))
    asked = F.col("preseleccionada") & ~cached
    return out.select(
        *claims.columns,
        "clave",
        (cached | good).alias("evaluada"),
        cached.alias("desde_cache"),
        F.when(cached, F.col("_cached")).when(good, F.col("_v")).alias("evaluacion"),
        F.when(good & ~cached & (F.size("_v.ajustes") > 0), F.col("_v.ajustes")).alias("ajustes"),
        F.when(asked & ~good, F.coalesce("problema", F.lit(NO_JSON))).alias("error"),
        F.when(~F.col("preseleccionada"), F.lit(OMITTED)).alias("motivo_omision"),
        F.when(asked, F.col("_n")).otherwise(0).alias("intentos"),
        *(F.when(asked, F.col(f"_{k}")).otherwise(v).alias("ms_llm" if k == "ms" else k) for k, v in zero.items()),
    )


def _round(tried: DataFrame, ok: Column, attempt: int) -> dict:
    """What a round has done, from its table."""
    told = tried.agg(F.count("*").alias("preguntadas"), F.count_if(ok).alias("listas"), *(F.coalesce(F.sum(f"_{k}"), F.lit(0)).alias(k) for k in ("llamadas", "tokens", "ms_generacion"))).first()
    rate = round(told["tokens"] / told["ms_generacion"] * 1000, 1) if told["ms_generacion"] else 0.0
    return {"vuelta": attempt, "preguntadas": told["preguntadas"], "listas": told["listas"], "llamadas": told["llamadas"], "tokens": told["tokens"], "tokens_por_segundo": rate}


def new_cache_rows(results: DataFrame) -> DataFrame:
    """(clave, evaluacion, version) of fresh verdicts, to be appended to the cache."""
    fresh = results.where(F.col("evaluada") & ~F.col("desde_cache"))
    return fresh.select("clave", "evaluacion").dropDuplicates(["clave"]).withColumn("version", F.lit(CACHE_VERSION))


def run_counters(results: DataFrame) -> DataFrame:
    """One row: calls, load time, tokens, generation time, cache hits and tokens a second, weighted. A text asked once counts once."""
    once = results.where("preseleccionada").groupBy("clave").agg(*(F.max(c).alias(c) for c in ("llamadas", "ms_carga", "tokens", "ms_generacion")), F.count_if("desde_cache").alias("hits"))
    total = once.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("llamadas", "ms_carga", "tokens", "ms_generacion")), F.coalesce(F.sum("hits"), F.lit(0)).alias("desde_cache"))
    rate = F.coalesce(fixed(F.try_divide(F.col("tokens"), F.col("ms_generacion")) * 1000, 1), F.lit(0.0))
    return total.withColumn("tokens_por_segundo", rate)
