"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most the sequence length. A count of pieces for each length, at most as many numbers as a sequence has tokens, goes to
the driver; best-fit decreasing runs on these counts and gives a plan of slots: for ranks from a to b within a length, sequence numbers and an
offset. Pieces take their slots by joining on length and rank. The rank is a prefix sum over small buckets of doc_ids, so that no task holds all pieces
of a common length.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import checkpointed, per_document, table

SEQUENCE = 2048
TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Ranks are counted within (length, bucket); more buckets make smaller groups.
BUCKETS = 512
_worker: dict = {}


def _tools(name: str) -> tuple:
    """The tokenizer, its vocabulary as merge ranks, which gives the same ids several times as fast, and the strings of its special tokens."""
    if name not in _worker:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(public_tokenizers.path(name))
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _worker[name] = own, fast, [t.content for t in own.get_added_tokens_decoder().values()]
    return _worker[name]


def token_bytes(text: str, name: str = TOKENIZER) -> bytes:
    """The ids of text, 4 little-endian bytes each. A text that holds a special token's string goes through the tokenizer itself, which alone knows its id."""
    own, fast, special = _tools(name)
    if any(s in text for s in special):
        return np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


def pieces(docs: DataFrame, sequence: int = SEQUENCE, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids binary) of each document's ids and an end id; null text is empty.

    Only documents over the sequence length are cut: a first piece of what is over, then full ones, which need no planning."""

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            ids = token_bytes(text or "", name) + END.to_bytes(4, "little")
            n = len(ids) // 4
            at, piece = 0, 0
            while at < n:
                length = (n % sequence or sequence) if piece == 0 else sequence
                part = ids[4 * at : 4 * (at + length)]
                yield doc_id, piece, at, length, zlib.crc32(part), part
                at, piece = at + length, piece + 1

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
    return per_document(docs.select("doc_id", "text"), kernel, schema, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, last rank, first sequence, offset); rank r of the row lies in sequence first + (r - first rank).

    Open sequences are kept as runs of consecutive numbers with equal room. Each step takes a whole run, splits one, or opens one run for each
    number of equal pieces, so the plan has a few rows a length whatever the counts are.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    new = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            heapq.heappush(runs[room], (first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                n = max(1, left // (sequence // length))
                put(sequence, new, n)
                new += n
                continue
            room = rooms[k]
            first, n = heapq.heappop(runs[room])
            if not runs[room]:
                del runs[room], rooms[k]
            used = min(n, left)
            rows.append((length, rank, rank + used - 1, first, sequence - room))
            put(room, first + used, n - used)
            put(room - length, first, used)
            left, rank = left - used, rank + used
    return rows


def packed(parts: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """parts (doc_id, piece, length, ...) plus sequence_id and offset: each sequence is filled from 0 without gaps."""
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, sequence), "length long, first long, last long, first_sequence long, offset long")
    keyed = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    ranked = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("nth") + F.coalesce("before", F.lit(0)))
    placed = ranked.join(F.broadcast(slots), ["length"]).where("rank between first and last")
    return placed.select(*parts.columns, (F.col("first_sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, sequence: int = SEQUENCE, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of docs. Without documents there are no pieces. The plan has at
    most a few rows a length, so it can go to every executor; the prefix sums are joined where the ranks are counted. Rows that repeat a doc_id are packed
    each, in the order of their ids' checksums; other columns are not read."""
    parts = checkpointed(pieces(docs, sequence, name).drop("ids"))
    return packed(parts, sequence)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": op6_packing}
ORACLE_SQL: dict[str, str] = {}
