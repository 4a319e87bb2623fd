"""Queries of language detection by profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.profiles import CYRILLIC, LANGUAGES, PROFILES, RANKS
from ..operators import detect
from .inputs import documents, lines
from .queries import LINES, query, quoted

_GRAMS = "(values " + ", ".join(f"({quoted(code)}, {quoted(g)}, {w})" for code in LANGUAGES if code not in CYRILLIC for g, w in PROFILES[code].items()) + ") t(idioma, gram, w)"


def _sql_ranked(source: str, key: str, to: str) -> str:
    """CTEs up to one named to (key, idioma, puntaje, k): the candidates of each text of source, whose texts are in Latin letters."""
    return f"""{to}_x as (select {key}, lower(trim(regexp_replace(texto, '\\s+', ' ', 'g'))) as low from {source}),
{to}_w as (select {key}, unnest(list_filter(string_split_regex(low, '[^\\p{{L}}]+'), lambda y: y <> '')) as w from {to}_x where length(low) >= 20),
{to}_n as (select {key}, sum(length(w)) as n from {to}_w group by all), {to}_t as (select {key}, w, count(*) as times from {to}_w group by all),
{to}_g as (select w, substr(' ' || w || ' ', i, 3) as gram from (select distinct w from {to}_w), unnest(range(1, length(w) + 1)) as z(i)),
{to}_p as (select {to}_g.w, idioma, sum(t.w) as s from {to}_g join (select * from {_GRAMS}) t using (gram) group by all),
{to}_s as (select {key}, idioma, sum(times * s) as s from {to}_t join {to}_p using (w) group by all),
{to} as (select *, s / (n * {RANKS}.0) as puntaje, row_number() over (partition by {key} order by s desc, idioma) as k from {to}_s join {to}_n using ({key}))"""


@query(
    f"""with d as (select doc_id, text as texto from documents), {_sql_ranked("d", "doc_id", "r")}
select d.doc_id, coalesce(max(idioma) filter (where k = 1), 'und') as idioma, coalesce(string_agg(idioma, '|' order by k) filter (where k <= 6), '') as candidates, round(coalesce(max(puntaje) filter (where k = 1), 0)::double, 6) as score
from d left join r on r.doc_id = d.doc_id group by d.doc_id"""
)
def language_profiles(spark, sf):
    """The language of each whole document and its candidates, of all languages that have a profile."""
    found = detect.ranked(documents(spark, sf).select("doc_id", F.col("text").alias("texto")), ["doc_id"])
    c = F.col("candidatos")
    return found.select("doc_id", detect.first(c).alias("idioma"), F.array_join(F.transform(c, lambda x: x.idioma), "|").alias("candidates"), F.round(F.coalesce(F.try_element_at(c, F.lit(1)).puntaje, F.lit(0.0)), 6).alias("score"))


@query(
    f"""with d as (select doc_id, text as texto from documents), {_sql_ranked("d", "doc_id", "r")},
c as (select doc_id, max(idioma) filter (where k = 1) as first, list(idioma) filter (where k <= 6) as cand from r group by doc_id),
l as (select doc_id, indice, texto from {LINES}), t as (select distinct md5(texto) as h, texto from l where length(trim(regexp_replace(texto, '\\s+', ' ', 'g'))) >= 140),
{_sql_ranked("t", "h", "o")}
select l.doc_id, l.indice::integer as indice, case when list_contains(cand, o.idioma) then o.idioma else coalesce(first, 'und') end as idioma from l left join c using (doc_id) left join o on o.k = 1 and o.h = md5(l.texto)"""
)
def language_two_levels(spark, sf):
    """Lines as claims: a long one may have a language of its own, if its document has that among its candidates."""
    claims = lines(spark, sf).select("doc_id", "indice", "texto", F.lit("").alias("idioma"))
    return detect.relabelled(claims, documents(spark, sf).select("doc_id", F.col("text").alias("texto"))).select("doc_id", "indice", "idioma")
