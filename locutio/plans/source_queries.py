"""Queries of files: documents written as subtitle, marked and plain text files, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clock
from ..operators import segment
from ..sources import subtitles
from .inputs import documents, table
from .queries import _SQL_CLEAN, query

_SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
# each line numbered, so that no two are equal; its cue begins at as many seconds as there are lines before it, and lasts one and a half
_SQL_LINES = f"""l as (select doc_id, i - 1 as i, 'n' || (i - 1) || ' ' || string_split(text, chr(10))[i] as h, len(string_split(text, chr(10))) as n from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) as u(i)),
c as (select doc_id, i, n, {_SQUEEZED.format(_SQL_CLEAN)} as t, {_SQUEEZED.format("h")} as raw from l)"""


def _files(spark, sf, kind):
    """(doc_id, path, content) of documents as files of one kind, a cue a line."""
    said = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("n"), i.cast("string"), F.lit(" "), x))
    if kind == "srt":
        block = lambda x, i: F.concat(i.cast("string"), F.lit("\n"), clock(i.cast("double")), F.lit(",000 --> "), clock(i + 1.5), F.lit(",500\n"), x)
        content = F.array_join(F.transform(said, block), "\r\n\r\n")
    else:
        content = F.array_join(F.transform(said, lambda x, i: F.concat(F.lit("["), clock(i.cast("double")), F.lit("] "), x)), "\n")
    return documents(spark, sf).select("doc_id", F.lit(f"talk.{kind}").alias("path"), content.alias("content"))


def _told(parsed):
    rows = parsed.select("doc_id", "motor", "timestamps_reales", F.posexplode_outer("segmentos").alias("k", "c")).where("k is not null")
    return rows.select("doc_id", "motor", "timestamps_reales", "k", "c.inicio", "c.fin", F.md5(F.col("c.texto").cast("binary")).alias("text_md5"))


@query(f"with {_SQL_LINES} select doc_id, 'srt' as motor, true as timestamps_reales, i::integer as k, i::double as inicio, (floor(i + 1.5) + 0.5)::double as fin, md5(t) as text_md5 from c")
def srt_cues(spark, sf):
    """The cues of each document written as an SRT file and parsed again."""
    return _told(subtitles.transcripts(_files(spark, sf, "srt")))


@query(
    f"""with {_SQL_LINES}, m as (select *, greatest(1.0, len(string_split(t, ' ')) / 2.5) as d from c),
p as (select doc_id, string_agg('[' || lpad((i // 3600)::varchar, 2, '0') || ':' || lpad((i % 3600 // 60)::varchar, 2, '0') || ':' || lpad((i % 60)::varchar, 2, '0') || '] ' || h, chr(10) order by i) as t from l group by doc_id having count(*) < 3)
select doc_id, 'texto-con-marcas' as motor, true as timestamps_reales, i::integer as k, i::double as inicio, case when i + 1 < n then i + 1.0 else i + d end::double as fin, md5(t) as text_md5 from m where n >= 3
union all select doc_id, 'texto', false, 0, 0.0, greatest(1.0, len(string_split({_SQUEEZED.format("t")}, ' ')) / 2.5)::double, md5({_SQUEEZED.format("t")}) from p"""
)
def marked_cues(spark, sf):
    """The cues of each document written with a time mark before each line; one with fewer than three lines is plain text."""
    return _told(subtitles.transcripts(_files(spark, sf, "txt")))


@query(
    """with e as (select user_id, event_id, event_type, epoch_us(ts) / 1e6 as s from events),
f as (select *, case when s - (lag(s) over w + 30) >= 0.65 then 1 else 0 end as cut from e window w as (partition by user_id order by s, event_id)),
g as (select *, sum(cut) over (partition by user_id order by s, event_id) as block from f)
select user_id, block::integer as block, string_agg(event_type, ' ' order by s, event_id) as texto from g group by user_id, block"""
)
def pause_parts(spark, sf):
    """The events of a user as cues of thirty seconds, cut where there is a pause."""
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(s.alias("inicio"), "event_id", F.col("event_type").alias("texto")))).alias("e"))
    cues = rows.select("user_id", F.transform("e", lambda x: F.struct(x.inicio.alias("inicio"), (x.inicio + 30).alias("fin"), x.texto.alias("texto"))).alias("c"))
    placed = cues.select("user_id", segment.joined_text(F.col("c")).alias("t"), segment.anchors(F.col("c")).alias("m"))
    return placed.select("user_id", F.posexplode(segment.pause_blocks(F.col("t"), F.col("m"))).alias("block", "texto")).select("user_id", "block", F.rtrim("texto").alias("texto"))
