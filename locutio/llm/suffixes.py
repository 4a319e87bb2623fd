"""Removal of repeated 50-byte strings with suffix arrays built block by block.

Every 50-byte string has an anchor, the 20 bytes in it with the smallest hash (its upper 32 bits, the first of equal ones), so equal strings have equal anchors. A document is a chain of units, runs
of neighbouring strings with one anchor. Units are named by two 64-bit hashes, of the anchor and of the whole unit; units whose anchor lies in one
document only can't repeat, and units with equal names repeat whole: both are settled by the names alone, which stand for long ties. What is left, units
that share an anchor and differ, mostly at the ends of a repeated passage, is compared by its text: the suffixes of an anchor's units are sorted one
bucket of leading bytes at a time, ties of 32 bytes are resolved by the precomputed ranks of a difference-cover sample, and neighbours in the
sorted order with 50 common bytes are equal strings.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import checkpointed, table

LENGTH, ANCHOR = 50, 20
_SPAN = LENGTH - ANCHOR + 1
PERIOD = 32
#: Suffixes sorted at once and bytes of unit text held at once, unless one anchor has more.
BLOCK, CHUNK = 1 << 18, 4 << 20
#: One document in so many is looked at for hot anchors; an anchor with over LEAST, and one part in HOT, of the units seen is hot and dealt to PARTS groups.
SAMPLED, LEAST, HOT = 32, 16, 2000
PARTS = 128
_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = 0x9E3779B97F4A7C15


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each width bytes in a row."""
    h, have = _TABLE[data], 1
    out: np.ndarray | None = None
    done = 0
    with np.errstate(over="ignore"):
        while True:
            if width & have:
                out = h.copy() if out is None else out[: len(h) - done] * np.uint64(pow(_FACTOR, have, 2**64)) + h[done : done + len(out)][: len(h) - done]
                done += have
            if have * 2 > width:
                break
            h = h[:-have] * np.uint64(pow(_FACTOR, have, 2**64)) + h[have:]
            have *= 2
        out = out[: len(data) - width + 1]
        out = out ^ (out >> np.uint64(31))
        return out * np.uint64(0xBF58476D1CE4E5B9)


def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, anchor hash) of each unit of a text, in order."""
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _rolling(data, ANCHOR)
    # the upper half of a hash and the place in one number: the least is the anchor, the first of equal ones, wherever a string stands
    value, have = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
    while have < _SPAN:
        step = min(have, _SPAN - have)
        value = np.minimum(value[step:], value[:-step])
        have += step
    at = (value & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return first, np.diff(np.concatenate([first, [len(at)]])), h[at[first]]


@functools.cache
def _cover(period: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a residue is in a difference cover, and for residues i, j the least shift that takes both into it."""
    r = int(np.ceil(np.sqrt(period)))
    inside = np.zeros(period, bool)
    inside[:r] = True
    inside[r::r] = True
    i, j, d = np.ogrid[:period, :period, :period]
    both = inside[(i + d) % period] & inside[(j + d) % period]
    return inside, both.argmax(2)


class SuffixSorter:
    """Suffixes of data in order, a block at a time."""

    def __init__(self, data: np.ndarray) -> None:
        self.n = len(data)
        self.padded = np.concatenate([data, np.zeros(PERIOD + LENGTH, np.uint8)])
        self.inside, self.shift = _cover(PERIOD)
        self.rank = np.full(self.n + 2 * PERIOD, -1, np.int64)
        own = np.flatnonzero(self.inside[np.arange(self.n) % PERIOD])
        order, keys = self._by_prefix(own)
        new = np.concatenate([[False], (keys[1:] != keys[:-1]).any(1)]) if len(own) else np.empty(0, bool)
        self.rank[own[order]] = np.cumsum(new)
        step, top = PERIOD, int(new.sum())
        while top < len(own) - 1 and step < 2 * self.n:
            there = np.minimum(own + step, self.n + PERIOD)
            key = self.rank[own] * (len(own) + 2) + self.rank[there] + 1
            values, back = np.unique(key, return_inverse=True)
            self.rank[own] = back
            top, step = len(values) - 1, step * 2

    def words(self, at: np.ndarray) -> np.ndarray:
        """8 bytes from each place, so that numbers order as bytes."""
        return np.lib.stride_tricks.sliding_window_view(self.padded, 8)[at].view(">u8")[:, 0].astype(np.uint64)

    def _by_prefix(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.stack([self.words(at + k) for k in range(0, PERIOD, 8)], axis=1) if len(at) else np.empty((0, PERIOD // 8), np.uint64)
        order = np.lexsort(keys.T[::-1])
        return order, keys[order]

    def _after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = self.shift[a % PERIOD, b % PERIOD]
        return self.rank[a + d] > self.rank[b + d]

    def blocks(self, starts: np.ndarray) -> Iterator[np.ndarray]:
        """The starts in the order of their suffixes; each array holds one bucket of two leading bytes, or several small ones."""
        lead = self.padded[starts].astype(np.int64) * 256 + self.padded[starts + 1]
        sizes = np.bincount(lead, minlength=65536)
        by_lead = np.argsort(lead, kind="stable")
        ends = np.cumsum(sizes)
        at = 0
        while at < len(starts):
            bucket = np.searchsorted(ends, at, "right")
            stop = max(int(ends[bucket]), int(ends[np.searchsorted(ends, at + BLOCK, "right") - 1]) if at + BLOCK < len(starts) else len(starts))
            own = starts[by_lead[at:stop]]
            order, keys = self._by_prefix(own)
            yield self._resolved(own[order], (keys[1:] == keys[:-1]).all(1))
            at = stop

    def _resolved(self, found: np.ndarray, tied: np.ndarray) -> np.ndarray:
        """Order within ties: odd and even neighbours change places, in all small ties at once; large ties are sorted one by one."""
        run = np.concatenate([[0], np.cumsum(~tied)]) if len(found) else np.empty(0, int)
        sizes = np.bincount(run)
        for r in np.flatnonzero(sizes > 24):
            lo, hi = np.searchsorted(run, r), np.searchsorted(run, r, "right")
            rank, shift = self.rank, self.shift
            def compare(a, b):
                d = shift[a % PERIOD, b % PERIOD]
                return int(rank[a + d] - rank[b + d])
            found[lo:hi] = sorted(found[lo:hi].tolist(), key=functools.cmp_to_key(compare))
        left = np.flatnonzero(tied & (sizes[run[1:]] <= 24)) if len(found) > 1 else np.empty(0, int)
        for odd in range(int(sizes[sizes <= 24].max(initial=0)) if len(left) else 0):
            lo = left[left % 2 == odd % 2]
            swap = lo[self._after(found[lo], found[lo + 1])]
            found[swap], found[swap + 1] = found[swap + 1].copy(), found[swap].copy()
        return found

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether 50 bytes from a and b are equal."""
        out = np.ones(len(a), bool)
        for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            out &= self.words(a + k) == self.words(b + k)
        return out


def _starts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes joined; text, place in it and place in the whole of each 50-byte string."""
    sizes = np.array([len(t) for t in texts], np.int64)
    count = np.maximum(sizes - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return np.frombuffer(b"".join(texts), np.uint8), owner, place, (np.cumsum(sizes) - sizes)[owner] + place


def repeated(texts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of each 50-byte string of texts that also starts in a text with a smaller doc.

    A string whose hash no other has is alone; only the others, and the texts that hold them, are sorted.
    """
    data, owner, place, starts = _starts(texts)
    if not len(starts):
        return owner, place
    value = _rolling(data, LENGTH)[starts]
    ordered = np.sort(value)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    at = np.searchsorted(twice, value)
    open_ = twice[np.minimum(at, len(twice) - 1)] == value if len(twice) else np.zeros(len(value), bool)
    if not open_.any():
        return owner[:0], place[:0]
    kept = np.unique(owner[open_])
    data, own, own_place, own_starts = _starts([texts[i] for i in kept])
    in_kept = np.zeros(len(texts), bool)
    in_kept[kept] = True
    asked = open_[in_kept[owner]]
    own, own_place, own_starts = kept[own[asked]], own_place[asked], own_starts[asked]
    where = np.full(len(data) + 1, -1, np.int64)
    where[own_starts] = np.arange(len(own_starts))
    sorter = SuffixSorter(data)
    hits = []
    for block in sorter.blocks(own_starts):
        first = np.concatenate([[0], np.flatnonzero(~sorter.same(block[1:], block[:-1])) + 1])
        of = docs[own[where[block]]]
        least = np.repeat(np.minimum.reduceat(of, first), np.diff(np.concatenate([first, [len(block)]])))
        hits.append(where[block[of > least]])
    hit = np.sort(np.concatenate(hits))
    return own[hit], own_place[hit]


def _unit_rows(docs: DataFrame) -> DataFrame:
    """(h, u, doc_id, row, start, n) of the units of each row of docs (doc_id, row, text)."""
    names = ["h", "u", "doc_id", "row", "start", "n"]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)

        for batch in batches:
            for doc_id, row, text in zip(*batch.columns):
                raw = text.as_buffer().to_pybytes()
                first, n, h = units(np.frombuffer(raw, np.uint8))
                if not len(first):
                    continue
                digest = xxhash.xxh3_64_intdigest
                u = np.fromiter((digest(raw[a:b]) for a, b in zip(first.tolist(), (first + n + LENGTH - 1).tolist())), np.uint64, len(first))
                ids = [np.full(len(first), x.as_py(), np.int64) for x in (doc_id, row)]
                held.append((h.view(np.int64), u.view(np.int64), *ids, first.astype(np.int32), n.astype(np.int32)))
                size += len(first)
                if size > 50_000:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    rows = docs.where("doc_id is not null and text is not null").where(F.octet_length("text") >= LENGTH)
    return rows.select("doc_id", "row", F.col("text").cast("binary").alias("text")).mapInArrow(mapped, "h long, u long, doc_id long, row long, start int, n int")


def hot_anchors(docs: DataFrame) -> list[int]:
    """Anchors that hold over one part in HOT of the units of a sample of documents. They are dealt in another way, so what the sample misses costs
    time and no row; there are at most HOT of them."""
    some = docs.where(F.pmod(F.xxhash64("doc_id", "row"), F.lit(SAMPLED)) == 0)
    counts = checkpointed(_unit_rows(some).groupBy("h").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r["h"] for r in counts.where(F.col("n") > max(LEAST, total // HOT)).collect()]


def repeats(docs: DataFrame, packed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, row, start, length) byte ranges, overlapping, of strings that also start in a document with a smaller doc_id. docs: (doc_id, row, text),
    packed: (doc_id, row, ztext). And (doc_id, row, at) with the runs (start, n) of strings of hot anchors that repeat, if there are hot anchors.

    Units are dealt by their anchor, those of a hot anchor by one of PARTS groups of documents as well, so no task holds all rows of an anchor. A unit that
    a smaller document of its group has is settled there; only the least document of each group, at most PARTS for a unit, meets the least of all groups in
    a join. What is left of hot anchors is compared string by string in the same way; no step makes a row for each document that a string repeats in.
    """
    hot = hot_anchors(docs)
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)
    rows = _unit_rows(docs).withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("doc_id", "row"), F.lit(PARTS)).cast("int")).otherwise(0)).repartition("h", "salt")
    unit, anchor = Window.partitionBy("h", "salt", "u"), Window.partitionBy("h", "salt")
    rows = rows.withColumn("least", F.min("doc_id").over(unit))
    rows = rows.withColumn("lo", F.min("doc_id").over(anchor)).withColumn("hi", F.max("doc_id").over(anchor)).withColumn("ulo", F.min("u").over(anchor)).withColumn("uhi", F.max("u").over(anchor))
    whole = F.col("doc_id") > F.col("least")
    cold = (F.col("hi") > F.col("lo")) & (whole | (F.col("ulo") < F.col("uhi")))
    shared = checkpointed(rows.where(is_hot | cold).select("h", "u", "doc_id", "row", "start", "n", whole.alias("whole"), is_hot.alias("hot")))
    place = ["h", "doc_id", "row", "start", "n"]
    settled, asked = shared.where("whole").select(*place), shared.where("not whole and not hot").select(*place, F.lit(False).alias("hot"))
    if hot:
        # the least document of a unit is the least of its group; a document's places of one unit stay together
        own = checkpointed(shared.where("hot and not whole").groupBy("h", "u", "doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("at")))
        least = checkpointed(own.groupBy("h", "u").agg(F.min("doc_id").alias("least")))
        own = checkpointed(own.join(least, ["h", "u"]).select("h", "doc_id", "row", "at", (F.col("doc_id") > F.col("least")).alias("whole")))
        whole_units = own.where("whole").select("doc_id", "row", "at")
        asked = asked.unionByName(own.where("not whole").select("h", "doc_id", "row", F.inline("at")).select(*place, F.lit(True).alias("hot")))
    asked = asked.groupBy("doc_id", "row").agg(*(F.collect_list(c).alias(c) for c in ("h", "start", "n", "hot")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                doc_id, row, ztext = (batch.column(k)[at].as_py() for k in range(3))
                raw = unzipped(ztext)
                h, start, n, hot = (batch.column(k)[at].values for k in range(3, 7))
                a, b = np.asarray(start), np.asarray(start) + np.asarray(n) + LENGTH - 1
                texts = [raw[x:y] for x, y in zip(a.tolist(), b.tolist())]
                ids = [pa.array(np.full(len(h), x, np.int64)) for x in (doc_id, row)]
                yield pa.RecordBatch.from_arrays([h, *ids, start, pa.array(texts, pa.binary()), hot], names=["h", "doc_id", "row", "start", "text", "hot"])

    once = packed.dropDuplicates(["doc_id", "row"])
    texts = once.join(asked, ["doc_id", "row"]).select("doc_id", "row", "ztext", "h", "start", "n", "hot").mapInArrow(cut, "h long, doc_id long, row long, start int, text binary, hot boolean")
    if hot:
        texts = checkpointed(texts)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def found(part: pa.Table) -> pa.RecordBatch:
            doc, row, start = (np.asarray(part[c]) for c in ("doc_id", "row", "start"))
            text, place = repeated(part["text"].to_pylist(), doc)
            first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)])) if len(text) else np.empty(0, int)
            n = np.diff(np.concatenate([first, [len(text)]])) if len(text) else first
            of = text[first]
            return pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(row[of]), pa.array((start[of] + place[first]).astype(np.int32)), pa.array((n + LENGTH - 1).astype(np.int32))], names=["doc_id", "row", "start", "length"])

        for batch in batches:
            h = np.asarray(batch.column(0))
            edge = int(np.searchsorted(h, h[-1])) if len(h) else 0
            if size > CHUNK and len(h) and (edge or held[-1].column(0)[-1].as_py() != h[0]):
                yield found(pa.Table.from_batches([*held, batch.slice(0, edge)]))
                held, size, batch = [], 0, batch.slice(edge)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield found(pa.Table.from_batches(held))

    rest = texts.where("not hot").drop("hot").repartition("h").sortWithinPartitions("h").mapInArrow(compared, "doc_id long, row long, start int, length int")
    spans = settled.select("doc_id", "row", "start", (F.col("n") + LENGTH - 1).alias("length")).unionByName(rest)
    if not hot:
        return spans, None

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                _, of, place, _ = _starts(texts := part.column(2).to_pylist())
                said = [texts[t][p : p + LENGTH] for t, p in zip(of.tolist(), place.tolist())]
                start = np.asarray(part.column(3))[of] + place
                yield pa.RecordBatch.from_arrays([pa.array(said, pa.binary()), *(part.column(k).take(pa.array(of)) for k in (0, 1)), pa.array(start.astype(np.int32))], names=["string", "doc_id", "row", "start"])

    # as with units: a string that a smaller document of its group has is settled there, and the least document of each group meets the least of all groups
    said = texts.where("hot").select("doc_id", "row", "text", "start").mapInArrow(strings, "string binary, doc_id long, row long, start int")
    said = said.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row"), F.lit(PARTS)).cast("int"))
    said = checkpointed(said.withColumn("lo", F.min("doc_id").over(Window.partitionBy("string", "salt"))))
    again = said.where("doc_id > lo").select("doc_id", "row", "start", F.lit(LENGTH).alias("length"))
    own = checkpointed(said.where("doc_id = lo").groupBy("string", "doc_id", "row").agg(F.collect_list(F.struct("start", F.lit(1).alias("n"))).alias("at")))
    least = checkpointed(own.groupBy("string").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("string", "least"))
    met = own.join(least, "string").where("doc_id > least").select("doc_id", "row", "at")
    hot_spans = whole_units.unionByName(met).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("at")).alias("at"))
    return spans.unionByName(again), hot_spans


def unzipped(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def zipped(docs: DataFrame) -> DataFrame:
    """(doc_id, row, ztext): the bytes of each text, compressed before they are shuffled; null is empty."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([tool.compress(t or b"") for t in part.column(2).to_pylist()], pa.binary())], names=["doc_id", "row", "ztext"])

    return docs.select("doc_id", "row", F.col("text").cast("binary").alias("text")).mapInArrow(mapped, "doc_id long, row long, ztext binary")


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of each row of docs.

    Texts are UTF-8 bytes, null is empty; texts under 50 bytes have nothing to remove. A row without a doc_id is neither cut nor a source. Rows that
    repeat a doc_id are one document: each is cut by what starts in smaller doc_ids, and they don't cut each other. Other columns are not read.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    packed = zipped(docs).repartition("doc_id", "row")
    spans, hot_spans = repeats(docs, packed)
    spans = spans.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "length")).alias("spans")).select("doc_id", "row", "spans.start", "spans.length")
    found = packed.join(spans, ["doc_id", "row"], "left")
    if hot_spans is not None:
        none = F.array().cast("array<int>")
        found = found.join(hot_spans, ["doc_id", "row"], "left").select(
            "doc_id", "ztext", F.concat(F.coalesce("start", none), F.coalesce("at.start", none)).alias("start"), F.concat(F.coalesce("length", none), F.coalesce(F.transform("at.n", lambda n: n + (LENGTH - 1)), none)).alias("length")
        )


    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids, n_bytes, n_removed, n_spans, kept = [], [], [], [], []
                for doc_id, ztext, start, length in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    raw = unzipped(ztext)
                    ids.append(doc_id)
                    n_bytes.append(len(raw))
                    if start:
                        edges = np.zeros(len(raw) + 1, np.int64)
                        a = np.minimum(np.array(start), len(raw))
                        np.add.at(edges, a, 1)
                        np.add.at(edges, np.minimum(a + np.array(length), len(raw)), -1)
                        gone = np.cumsum(edges[:-1]) > 0
                        n_removed.append(int(gone.sum()))
                        n_spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                        raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    else:
                        n_removed.append(0)
                        n_spans.append(0)
                    kept.append(raw)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return found.select("doc_id", "ztext", "start", "length").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffixes(spark, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_suffixes": op4_suffixes}
ORACLE_SQL: dict[str, str] = {}
