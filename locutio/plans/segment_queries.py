"""Queries of the segmenter's joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import segment
from .inputs import documents, table
from .queries import Q, query


@query(Q["time_interpolation"][1])
def time_join(spark, sf):
    """The same offsets as time_interpolation, timed by the as-of join: turns are rows from the table to the result."""
    turns = table(spark, sf, "conversations").where("text is not null").withColumn("d", F.size(F.split("text", " ")) / 2.5)
    before = F.coalesce(F.sum("d").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    cues = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("indice"), before.alias("inicio"), (before + F.col("d")).alias("fin"), F.col("text").alias("texto"))
    placed = segment.placed_cues(cues)
    points = placed.groupBy("doc_id").agg(F.max("hasta").alias("n")).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"), "n")
    points = points.select("doc_id", "k", F.floor(F.col("n") * F.col("k") / 8).alias("offset"))
    return segment.timed_by_join(points, placed).select(F.col("doc_id").alias("conv_id"), "k", F.round("segundos", 6).alias("at"))


@query(
    """with l as (select doc_id, i - 1 as i, length(trim(regexp_replace(string_split(text, chr(10))[i], '\\s+', ' ', 'g'))) as n from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) as u(i))
select doc_id, i::integer as indice, coalesce(sum(n + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as desde, (coalesce(sum(n + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) + n)::bigint as hasta from l where n > 0"""
)
def line_offsets(spark, sf):
    """Where each line of whole documents stands in the text joined by blanks, a row a line."""
    lines = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("indice", "texto"))
    own = lines.select("doc_id", "indice", F.col("indice").cast("double").alias("inicio"), F.col("indice").cast("double").alias("fin"), "texto")
    return segment.placed_cues(own).select("doc_id", F.col("inicio").cast("int").alias("indice"), "desde", "hasta")
