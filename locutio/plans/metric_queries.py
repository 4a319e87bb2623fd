"""Queries of metrics: tables with empty cells, words for a recall, and what evaluation took."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from .inputs import table, verdicts
from .queries import _SQL_PAIRS, _SQL_VERDICTS, _pairs, query

_LABELS = ["ninguna", "corta", "razonable", "nunca"]


@query(
    f"""with p as {_SQL_PAIRS}, g as (select i - 1 as orden, ({_LABELS})[i] as esperado from unnest(range(1, 5)) as u(i))
select orden::integer as orden, g.esperado, {", ".join(f"(count(*) filter (where obtenido = '{x}'))::bigint as {x}" for x in _LABELS)} from g left join p on p.esperado = g.esperado group by all"""
)
def confusion_cells(spark, sf):
    """The confusion matrix with all its cells, also those of a label that never occurs."""
    return metrics.confusion_table(_pairs(spark, sf), _LABELS)


@query(
    f"""with r as (select lang, count(*) filter (where evaluada and score >= 0.7) as high, count(*) filter (where evaluada and score >= 0.7 and n_mark > 0) as caught from {_SQL_VERDICTS} group by lang),
s as (select *, caught / nullif(high, 0) as r, caught || ' de ' || high || ' puntajes altos (' || floor(caught / nullif(high, 0) * 100 + 0.5)::bigint || ' %): ' as n from r)
select lang, case when r is null then 'sin puntajes altos: la sensibilidad del prefiltro no se puede medir aqui' when r >= 0.95 then 'el prefiltro retiene ' || n || 'se puede usar' else 'el prefiltro solo retiene ' || n || 'faltan marcadores' end as said from s"""
)
def recall_words(spark, sf):
    found = metrics.gate_recall(verdicts(spark, sf), ["lang"])
    return found.select("lang", metrics.recall_text(F.col("recall"), F.col("altas"), F.col("capturadas")).alias("said"))


@query(
    """with o as (select event_type, user_id, max(1 + event_id % 2) as llamadas, max(event_id % 30) as tokens, max(floor(value)) as ms_generacion, max(event_id % 9) as ms_llm, count(*) filter (where event_id % 5 = 0) as hits
  from events where event_id % 3 > 0 group by all)
select event_type, sum(llamadas)::bigint as llamadas, sum(tokens)::bigint as tokens, sum(ms_llm)::double as ms_llm, sum(hits)::bigint as desde_cache, round(coalesce(sum(tokens) / nullif(sum(ms_generacion), 0) * 1000, 0)::double, 1) as rate from o group by event_type"""
)
def run_performance(spark, sf):
    """Events as evaluated claims, users as their keys: a key counts once a group."""
    k = F.col("event_id")
    rows = table(spark, sf, "events").select(
        "event_type", F.col("user_id").cast("string").alias("clave"), (k % 3 > 0).alias("preseleccionada"), (1 + k % 2).alias("llamadas"), (k % 30).alias("tokens"), F.lit(0.0).alias("ms_carga"),
        F.floor("value").cast("double").alias("ms_generacion"), (k % 9).cast("double").alias("ms_llm"), (k % 5 == 0).alias("desde_cache"),
    )
    p = F.col("rendimiento")
    return metrics.performance(rows, ["event_type"]).select("event_type", p.llamadas.alias("llamadas"), p.tokens.alias("tokens"), p.ms_llm.alias("ms_llm"), p.desde_cache.alias("desde_cache"), p.tokens_por_segundo.alias("rate"))
