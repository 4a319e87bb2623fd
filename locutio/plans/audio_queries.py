"""Queries of decoding audio."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.audio import decode_wav
from .inputs import table
from .queries import query


def little(n: Column, width: int) -> Column:
    """The low width bytes of a whole number as hex digits, lowest byte first."""
    return F.concat(*(F.lpad(F.hex(F.shiftright(n.cast("bigint"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(width)))


def wav(pcm: Column, channels: int, rate: int) -> Column:
    """The bytes of a 16-bit WAV file of interleaved samples, with a chunk of odd length before the samples."""
    data = F.array_join(F.transform(pcm, lambda s: little(s, 2)), "")
    size = F.size(pcm) * 2
    word = lambda n: little(F.lit(n), 4)
    text = lambda s: F.lit(s.encode().hex())
    form = F.concat(text("fmt "), word(16), little(F.lit(1), 2), little(F.lit(channels), 2), word(rate), word(rate * channels * 2), little(F.lit(channels * 2), 2), little(F.lit(16), 2))
    return F.unhex(F.concat(text("RIFF"), little(size + 36 + 12, 4), text("WAVE"), form, text("LIST"), word(3), text("abc"), F.lit("00"), text("data"), little(size, 4), data))


@query(
    """with e as (select user_id, array_agg((floor(value * 7)::bigint % 65536 - 32768) order by event_id) as s from events group by 1), p as (select *, len(s) // 2 as n from e)
select user_id, n::bigint as n_frames, round((n / 16000.0)::double, 9) as seconds, round(coalesce(list_sum(list_transform(range(1, n + 1), lambda i: (s[2 * i - 1] + s[2 * i]) / 2 / 32768.0 * (i % 7 + 1))), 0)::double, 6) as weighed, null::varchar as problem from p"""
)
def wav_samples(spark, sf):
    """The values of each user's events, made the bytes of a stereo file, read back as mono samples."""
    e = table(spark, sf, "events").select("user_id", "event_id", ((F.floor(F.col("value") * 7) % 65536) - 32768).alias("s"))
    own = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "s"))), lambda x: x.s).alias("pcm"))
    got = decode_wav(own.select(F.col("user_id").alias("doc_id"), wav(F.col("pcm"), 2, 16000).alias("content")))
    weighed = F.aggregate(F.transform("muestras", lambda x, i: x.cast("double") * ((i + 1) % 7 + 1)), F.lit(0.0), lambda a, x: a + x)
    return got.select(F.col("doc_id").cast("bigint").alias("user_id"), F.size("muestras").cast("bigint").alias("n_frames"), F.round("duracion", 9).alias("seconds"), F.round(weighed, 6).alias("weighed"), F.col("problema").alias("problem"))
