"""Queries of the gate as a join."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import phrases
from .inputs import TEST_ENTRIES, TEST_GATE, lines, table
from .queries import FOLD, LINES, query

_TOKENS = r"regexp_extract_all(regexp_replace({0}, '\s+', ' ', 'g'), '\p{{L}}+|[^\p{{L}} ]| ')"


_LABELS = "[" + ", ".join(f"case when regexp_matches(f, '(^|[^\\p{{L}}]){e.pattern.replace(' ', chr(92) + 's+')}([^\\p{{L}}]|$)') then '{e.label}' end" for e in TEST_ENTRIES) + "]"


@query(
    f"""with l as (select doc_id, indice, {FOLD.format("texto")} as f from {LINES}), m as (select doc_id, indice, list_filter({_LABELS}, lambda x: x is not null) as m from l)
select doc_id, indice::integer as indice, array_to_string(m, '|') as markers, len(m) > 0 as preseleccionada from m"""
)
def gate_join(spark, sf):
    """The gate of the other queries, as a join: the same markers for each line."""
    rows = phrases.marked(lines(spark, sf), TEST_GATE.frame(spark, "test"))
    return rows.select("doc_id", "indice", F.array_join("marcadores", "|").alias("markers"), "preseleccionada")


@query(
    f"""with b as (select {_TOKENS.format(FOLD.format("text"))} as t from benchmark),
p as (select distinct t[i] || ' ' || t[i + 2] as patron from b, unnest(range(1, greatest(len(t) - 1, 1))) as u(i) where t[i + 1] = ' ' and regexp_matches(t[i], '^\\p{{L}}') and regexp_matches(t[i + 2], '^\\p{{L}}')),
l as (select doc_id, indice, {_TOKENS.format(FOLD.format("texto"))} as t from {LINES}),
r as (select distinct doc_id, indice, t[i] || ' ' || t[i + 2] as patron from l, unnest(range(1, greatest(len(t) - 1, 1))) as u(i) where t[i + 1] = ' ' and regexp_matches(t[i], '^\\p{{L}}') and regexp_matches(t[i + 2], '^\\p{{L}}'))
select doc_id, indice::integer as indice, count(*) as n, md5(string_agg(patron, '|' order by patron)) as patterns_md5 from r join p using (patron) group by all"""
)
def gate_vocabulary(spark, sf):
    """Lines that hold word pairs of the benchmark: a lexicon of as many patterns as that table has pairs."""
    pairs = table(spark, sf, "benchmark").select(F.explode(phrases.runs(F.col("text"), [3])).alias("patron")).where(F.col("patron").rlike(r"^\p{L}+ \p{L}+$")).distinct()
    found = phrases.hits(lines(spark, sf), pairs.select("patron", F.lit(0).alias("ord"), F.col("patron").alias("etiqueta")), ["doc_id", "indice"])
    return found.select("doc_id", "indice", F.size("marcadores").cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort("marcadores"), "|").cast("binary")).alias("patterns_md5"))
