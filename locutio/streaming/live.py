"""Streams of cues: the gate without state, pauses and rolling captions with keyed state, and verdicts asked once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..criteria.base import Criterion
from ..operators import evaluate
from ..operators.lexicon import Gate
from ..operators.segment import MIN_PAUSE
from ..sources.subtitles import TAIL


def gated_stream(cues: DataFrame, gate: Gate) -> DataFrame:
    """Cues with a marker; works on a stream as on a table."""
    return cues.withColumn("marcadores", gate.markers(F.col("texto"))).where(F.size("marcadores") > 0)


#: Milliseconds of event time after which an open block ends without a next cue, and after which a silent document is forgotten.
QUIET, FORGOTTEN = 60_000, 24 * 3_600_000


def pause_blocks_stream(cues: DataFrame, pause: float = MIN_PAUSE, timeout: str = "10 minutes", quiet: int = QUIET, forgotten: int = FORGOTTEN) -> DataFrame:
    """(doc_id, bloque, inicio, fin, texto) of each run of cues (doc_id, inicio, fin, texto, ts) without a pause, as soon as the next begins or the
    watermark on ts has moved on by quiet since the block's last cue came. The pause lies between one cue's end and the next one's start.

    State: one open block a document, then the number of its next block, and nothing once the watermark has moved on by forgotten; a document that speaks
    again after that begins at block 0.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        block = list(state.get) if state.exists else None
        if state.hasTimedOut and block[3] is None:
            state.remove()
        elif state.hasTimedOut:
            out.append((key[0], *block))
            state.update((block[0] + 1, 0.0, 0.0, None))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + forgotten)
        else:
            rows = pd.concat(list(parts)).sort_values(["inicio", "fin"])
            for r in rows.itertuples():
                if block and block[3] is None:
                    block = [block[0], r.inicio, r.fin, r.texto]
                elif block and r.inicio - block[2] >= pause:
                    out.append((key[0], *block))
                    block = [block[0] + 1, r.inicio, r.fin, r.texto]
                elif block:
                    block = [block[0], block[1], max(block[2], r.fin), f"{block[3]} {r.texto}"]
                else:
                    block = [0, r.inicio, r.fin, r.texto]
            state.update(tuple(block))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + quiet)
        yield pd.DataFrame(out, columns=["doc_id", "bloque", "inicio", "fin", "texto"])

    shape = "bloque int, inicio double, fin double, texto string"
    return cues.withWatermark("ts", timeout).groupBy("doc_id").applyInPandasWithState(step, f"doc_id string, {shape}", shape, "append", GroupStateTimeout.EventTimeTimeout)


def without_overlap_stream(cues: DataFrame, timeout: str = "10 minutes", forgotten: int = FORGOTTEN) -> DataFrame:
    """Each cue (doc_id, inicio, fin, texto, ts) without the words that end what was said before in its document; state: the last sixty words, until the
    watermark on ts has moved on by forgotten."""
    import re

    def bare(w: str) -> str:
        return re.sub(r"[\W_]", "", w.lower())

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            tail = state.get[0].split() if state.exists else []
            for r in pd.concat(list(parts)).sort_values("inicio").itertuples():
                words = r.texto.split()
                a, b = [bare(w) for w in tail], [bare(w) for w in words[:TAIL]]
                n = next((n for n in range(min(len(a), len(b)), 1, -1) if a[-n:] == b[:n]), 0)
                if rest := words[n:]:
                    out.append((key[0], r.inicio, r.fin, " ".join(rest)))
                    tail = (tail + rest)[-TAIL:]
            state.update((" ".join(tail),))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + forgotten)
        yield pd.DataFrame(out, columns=["doc_id", "inicio", "fin", "texto"])

    own = cues.withWatermark("ts", timeout).groupBy("doc_id")
    return own.applyInPandasWithState(step, "doc_id string, inicio double, fin double, texto string", "tail string", "append", GroupStateTimeout.EventTimeTimeout)


def asked_once(keyed: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Rows (clave, ts, ...) without those whose key came before within the lateness."""
    return keyed.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["clave"])


def windows(cues: DataFrame, length: str = "30 seconds", slide: str = "20 seconds") -> DataFrame:
    """(doc_id, ventana, n): cues in each recogniser window."""
    return cues.withWatermark("ts", "1 minute").groupBy("doc_id", F.window("ts", length, slide).alias("ventana")).agg(F.count("*").alias("n"))


def evaluated_stream(
    claims: DataFrame, criterion: Criterion, backend: evaluate.Backend, path: str, checkpoint: str, model: str = "qwen2.5:3b", retries: int = evaluate.RETRIES, **trigger: object
) -> StreamingQuery:
    """Start a query that evaluates a stream of claims (as the gate leaves them) and keeps results and cache as tables under path.

    Each micro-batch is joined with the cache as it then is, and only keys that it lacks are asked; their verdicts are added to it before the batch's
    results. A batch that is run again after a failure finds what it had asked in the cache, and replaces its own results (lote is its number), so no key is
    asked twice and no result is there twice.
    """
    from ..plans.run import read_cache

    def evaluated(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        results = evaluate.stored(evaluate.evaluated(batch, criterion, backend, model, retries, read_cache(spark, path, criterion.id)))
        fresh = evaluate.new_cache_rows(results).withColumn("criterio", F.lit(criterion.id))
        fresh.write.mode("append").partitionBy("criterio").parquet(f"{path}/cache")
        own = results.withColumn("criterio", F.lit(criterion.id)).withColumn("lote", F.lit(number))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("criterio", "lote").parquet(f"{path}/results")

    return claims.writeStream.foreachBatch(evaluated).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Progress(StreamingQueryListener):
    """Tells tell, as a dict, of each micro-batch: nombre, lote, filas, por_segundo, estado (rows of state) and marca (the watermark); and of the end of a
    query with its error, if any. Add it with spark.streams.addListener."""

    def __init__(self, tell: Callable[[dict], None]) -> None:
        self.tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: N802  names of the interface
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        state = sum(o.numRowsTotal for o in p.stateOperators)
        self.tell({"nombre": p.name, "lote": p.batchId, "filas": p.numInputRows, "por_segundo": p.processedRowsPerSecond, "estado": state, "marca": p.eventTime.get("watermark")})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tell({"fin": str(event.id), "error": event.exception})
