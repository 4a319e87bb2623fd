"""SimHash near-dedup with a binary-trie self-join.

Fingerprints are sorted in the order of their bits, which makes every node of a binary trie a range of the sorted array. The self-join walks pairs of
nodes together, level by level, adds one to a pair's error count where the two take different branches, and drops the pair as soon as the count
exceeds the budget. The walk is vectorised over all node pairs of one level.

The trie is cut into tasks by blocks of bits: two fingerprints within the budget agree on some block (for 3 errors and 4 blocks always, by the
pigeonhole principle), so each block value is the root of a trie of its own. Equal fingerprints are merged before, with a map-side minimum, so
groups of copies of any size cost one row; each task returns a spanning forest of the links it finds and never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import checkpointed, connected_components, filtering, joined, per_document, releasing, small_batches, table

SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FRONTIER = 1 << 18


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of so many words, repeats included; of the whole sequence if it is shorter; none without words."""
    found = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits of a longer hash; the first are h itself."""
    if k == 0:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray, bits: int = 64) -> bytes:
    """A bit is 1 if it is set in over half of the hashes. Big-endian bytes, 64 bits a word."""
    if not len(hashes):
        return bytes(bits // 8)
    out = []
    for k in range(bits // 64):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 32768):
            part = _mixed(hashes[at : at + 32768], k)
            counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32 if len(part) > 255 else np.uint8)
        out.append(np.packbits(counts * 2 > len(hashes)).tobytes())
    return b"".join(out)


def simhash(docs: DataFrame, words: int = 3, bits: int = 64, distinct: bool = False) -> DataFrame:
    """(doc_id, fp binary) for each row of docs. A null text has no words; without words the fingerprint is zero. distinct: count a shingle once."""

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            h = shingle_hashes(text, words)
            yield doc_id, fingerprint(np.unique(h) if distinct else h, bits)

    return per_document(docs.select("doc_id", "text"), kernel, pa.schema([("doc_id", pa.int64()), ("fp", pa.binary())]), "doc_id long, fp binary")


def trie_links(fps: np.ndarray, group: np.ndarray, budget: int) -> np.ndarray:
    """Labels (an index of a row each) of what is linked within budget differing bits, within each group.

    fps: (n, bytes) uint8, rows distinct in a group and sorted by group, then bytes. The pair frontier is cut into pieces that are walked depth
    first, so memory stays bounded; what is found goes into the labels at once.
    """
    n, width = fps.shape
    labels = np.arange(n)
    edges = np.flatnonzero(np.diff(group)) + 1
    lo = np.concatenate([[0], edges])
    hi = np.concatenate([edges, [n]])
    words = fps.reshape(n, width // 8, 8).view(">u8")[:, :, 0].astype(np.uint64) if n else np.empty((0, width // 8), np.uint64)
    todo = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int32))]
    while todo:
        depth, alo, ahi, blo, bhi, err = todo.pop()
        keep = (alo != blo) | (ahi - alo > 1)
        alo, ahi, blo, bhi, err = (x[keep] for x in (alo, ahi, blo, bhi, err))
        single = ((ahi - alo == 1) & (bhi - blo == 1)) if depth < width * 8 else np.ones(len(alo), bool)
        if single.any():
            for at in range(0, int(single.sum()), 65536):
                i, j = alo[single][at : at + 65536], blo[single][at : at + 65536]
                near = np.bitwise_count(words[i] ^ words[j]).sum(1, dtype=np.int64) <= budget
                labels = joined(labels, i[near], j[near])
            alo, ahi, blo, bhi, err = (x[~single] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if len(alo) > _FRONTIER:
            half = len(alo) // 2
            todo += [(depth, alo[s], ahi[s], blo[s], bhi[s], err[s]) for s in (slice(half, None), slice(half))]
            continue
        ones = np.concatenate([[0], np.cumsum((words[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1))]).astype(np.int64)
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        own = alo == blo
        parts = [(alo, amid, blo, bmid, err, slice(None)), (amid, ahi, bmid, bhi, err, slice(None)), (alo, amid, bmid, bhi, err + 1, slice(None)), (amid, ahi, blo, bmid, err + 1, ~own)]
        new = [np.concatenate([p[k][p[5]] for p in parts]) for k in range(5)]
        ok = (new[4] <= budget) & (new[1] > new[0]) & (new[3] > new[2])
        todo.append((depth + 1, *(x[ok] for x in new)))
    return labels


def links(classes: DataFrame, bits: int, budget: int, key_bits: int = 16) -> DataFrame:
    """(u, v) links between the doc_ids that stand for distinct fingerprints (fp, root), a spanning forest for each block value.

    A block has 16 bits, of which the last key_bits are its value."""
    value = lambda k: F.conv(F.hex(F.substring("fp", 1 + 2 * k, 2)), 16, 10).cast("int").bitwiseAND((1 << key_bits) - 1)
    blocks = F.array(*(F.struct(F.lit(k).alias("block"), value(k).alias("key")) for k in range(bits // 16)))
    rows = classes.where("root is not null").select("fp", "root", F.explode(blocks).alias("b")).select("b.block", "b.key", "fp", "root")
    dealt = rows.repartition("block", "key").sortWithinPartitions("block", "key", "fp")
    width = bits // 8

    def found(block: list, key: list, fp: list, root: list) -> Iterator[pa.RecordBatch]:
        change = np.array([False] + [(a, b) != (c, d) for a, b, c, d in zip(block[1:], key[1:], block, key)])
        group = np.cumsum(change)
        labels = trie_links(np.frombuffer(b"".join(fp), np.uint8).reshape(-1, width), group, budget)
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        roots = np.array(root, np.int64)
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(roots[linked]), pa.array(roots[labels[linked]])], names=["u", "v"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        for batch in batches:
            for column, more in zip(held, batch.columns):
                column.extend(more.to_pylist())
            if len(held[0]) >= 100_000:
                last = (held[0][-1], held[1][-1])
                cut = len(held[0])
                while cut and (held[0][cut - 1], held[1][cut - 1]) == last:
                    cut -= 1
                if cut:
                    yield from found(*(c[:cut] for c in held))
                    held = [c[cut:] for c in held]
        if held[0]:
            yield from found(*held)

    return dealt.mapInArrow(releasing(mapped), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 64, budget: int = 3, distinct: bool = False, key_bits: int = 16) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the smallest doc_id reachable over links of at most budget differing bits.

    With 64 bits and budget 3 the four 16-bit blocks find every link. With more bits and a budget over one error a block the blocks find a link with
    the probability that one of them agrees; see the README. Rows without a doc_id get a fingerprint and no component.
    """
    prints = checkpointed(simhash(docs, words, bits, distinct))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("root"))
    components = connected_components(links(classes, bits, budget, key_bits))
    reached = classes.join(components, F.col("root") == F.col("node"), "left").select("fp", F.coalesce("component", "root").alias("component_id"))
    return prints.join(reached, "fp").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Up to so many ids (about 32 bytes each in a hash table) go to every executor, so that texts aren't shuffled; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Near copies: Jaccard similarity of the sets of five-word shingles at least 4 in 5.
NEAR_WORDS, NEAR_PART, NEAR_WHOLE = 5, 4, 5
#: Shingles that so many documents of one batch hold come last in the order of prefixes; at most so many are told to the executors (16 bytes each).
_COMMON, _TOLD = 4, 300_000
#: Guesses of near copies that each document confirms before all others are sought, and how far back a guess looks in a bucket.
_GUESSES, _BACK = 3, 1024


def _few(rows: DataFrame) -> DataFrame:
    """rows (stored), marked for a broadcast if their number is small enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents hold, sorted, and roughly how many; it only sets an order, so what it lacks costs time and no pair."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def batch_of() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= _COMMON
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], names=["shingle", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.append(np.unique(shingle_hashes(text.as_py(), NEAR_WORDS)))
                n += len(held[-1])
                if n >= 500_000:
                    yield batch_of()
                    held, n = [], 0
        if held:
            yield batch_of()

    found = docs.select("text").mapInArrow(releasing(counted), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(_TOLD).toArrow()
    keys, counts = np.asarray(found["shingle"], np.int64), np.asarray(found["n"], np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def parity(own: np.ndarray) -> bytes:
    """For each value of a shingle's last bits whether an odd number of the set has it: two to four bits a shingle, 64 at least, a power of two."""
    bits = max(64, 1 << ((4 * len(own)).bit_length() - 1))
    return np.packbits((np.bincount(own & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """How many shingles are in one of two sets only, at least: the places where their parities differ, the longer one folded to the other's length."""
    x, y = sorted((a, b), key=len)
    u, v, bits = int.from_bytes(x, "big"), int.from_bytes(y, "big"), 8 * len(y)
    while bits > 8 * len(x):
        bits //= 2
        v = (v >> bits) ^ (v & ((1 << bits) - 1))
    return (u ^ v).bit_count()


def _prefixes(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, n, prefix, parity, fp): the sets' sizes and first shingles, rare ones first, of which similar sets share one; their parity and
    64-bit fingerprint."""
    shared = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs))

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        keys, counts = shared.value
        for doc_id, text in rows:
            own = np.unique(shingle_hashes(text, NEAR_WORDS))
            fp = int.from_bytes(fingerprint(own), "big", signed=True)
            own = own.view(np.int64)
            weight = np.zeros(len(own), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                weight = np.where(keys[at] == own, counts[at], 0)
            first = np.lexsort((own, weight))[: len(own) - -(-NEAR_PART * len(own) // NEAR_WHOLE) + 1]
            yield doc_id, xxhash.xxh3_128_digest(own.tobytes()), len(own), own[first].tolist(), parity(own), fp

    schema = pa.schema([("doc_id", pa.int64()), ("sig", pa.binary()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("parity", pa.binary()), ("fp", pa.int64())])
    return per_document(docs.select("doc_id", "text"), kernel, schema, "doc_id long, sig binary, n long, prefix array<long>, parity binary, fp long")


def _paired(first: np.ndarray, count: np.ndarray, size: np.ndarray, at_most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) row pairs, row i with count[i] rows from first[i] on, whose sizes and places allow the similarity. size: n * 2**32 + place."""
    n, rest = size >> 32, (size >> 32) - (size & 0xFFFFFFFF)
    rows = np.flatnonzero(count > 0)
    total = np.cumsum(count[rows])
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + at_most, "right")))
        own = rows[at:upto]
        i = np.repeat(own, count[own])
        j = np.repeat(first[own] - np.cumsum(count[own]) + count[own], count[own]) + np.arange(len(i))
        ok = NEAR_WHOLE * np.minimum(n[i], n[j]) >= NEAR_PART * np.maximum(n[i], n[j])
        ok &= (NEAR_WHOLE + NEAR_PART) * np.minimum(rest[i], rest[j]) >= NEAR_PART * (n[i] + n[j])
        yield i[ok], j[ok]
        at = upto


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first row and the end of its run of equal keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.concatenate([[0], np.flatnonzero(new), [n]]) if n else np.zeros(1, int)
    sizes = np.diff(starts)
    return np.repeat(starts[:-1], sizes), np.repeat(starts[1:], sizes)


def nearest_earlier(shingle: np.ndarray, size: np.ndarray, fp: np.ndarray, back: int = _BACK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier, differing bits): for each row the row of its bucket before it with the nearest fingerprint, among the bucket's first and at
    most so many last before it. Rows are sorted by shingle."""
    first, end = _runs(shingle)
    row = np.arange(len(shingle))
    count = np.where(row == first, end - row - 1, np.minimum(end - row - 1, back))
    best = np.full(len(shingle), np.iinfo(np.int64).max)
    for i, j in _paired(row + 1, count, size):
        np.minimum.at(best, j, np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64) << 40 | i)
    later = np.flatnonzero(best < np.iinfo(np.int64).max)
    return later, best[later] & ((1 << 40) - 1), best[later] >> 40


def _by_shingle(dealt: DataFrame, kernel, ddl: str) -> DataFrame:
    """kernel over whole buckets of rows (long columns, the first the shingle) that are dealt and sorted by shingle."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            x = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], np.int64).reshape(batch.num_columns, -1)
            cut = int(np.searchsorted(x[0], x[0][-1])) if x.shape[1] else 0
            if cut or (held and x.shape[1] and held[-1][0][-1] != x[0][0]):
                yield from kernel(np.concatenate([*held, x[:, :cut]], 1))
                held, x = [], x[:, cut:]
            if x.shape[1]:
                held.append(x)
        if held:
            yield from kernel(np.concatenate(held, 1))

    return dealt.mapInArrow(releasing(mapped), ddl)


def _guessed(firsts: DataFrame) -> DataFrame:
    """Rows (u, v, bits, null, null) of guessed links, and rows (root, null, null, shingle, size) of the buckets with two rows or more."""
    size = (F.shiftleft(F.col("n"), 32) + F.col("pos")).alias("size")
    rows = firsts.select(F.col("doc_id").alias("root"), "n", "fp", F.posexplode("prefix").alias("pos", "shingle")).select("shingle", "root", size, "fp")
    names = ["u", "v", "bits", "shingle", "size"]

    def kernel(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        first, end = _runs(x[0])
        x = x[:, end - first > 1]
        later, earlier, bits = nearest_earlier(x[0], x[2], x[3].view(np.uint64))
        none = pa.nulls(len(later), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x[1][later]), pa.array(x[1][earlier]), pa.array(bits), none, none], names=names)
        none = pa.nulls(x.shape[1], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x[1]), none, none, pa.array(x[0]), pa.array(x[2])], names=names)

    return _by_shingle(rows.repartition("shingle").sortWithinPartitions("shingle", "root"), kernel, "u long, v long, bits long, shingle long, size long")


def _across(rows: DataFrame, components: DataFrame) -> DataFrame:
    """(u, v) pairs of one bucket of rows (shingle, root, size) and different components that can be similar."""
    told = checkpointed(rows.join(components, F.col("root") == F.col("node"), "left").select("shingle", F.coalesce("component", "root").alias("c"), "root", "size"))
    mixed = told.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("shingle")

    def kernel(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        end, own_end = _runs(x[0])[1], _runs(x[0], x[1])[1]
        for i, j in _paired(own_end, end - own_end, x[3]):
            u, v = x[2][i], x[2][j]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    return _by_shingle(told.join(mixed, "shingle").repartition("shingle").sortWithinPartitions("shingle", "c", "root"), kernel, "u long, v long").distinct()


def _possible(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(u, v, apart) of pairs whose parities allow the similarity: where they differ, some shingle is in one set only, so sets differ in that many
    shingles at least. No similar pair is lost."""
    side = lambda k, c: firsts.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(c))
    both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "nu", "nv", "a", "b")

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for u, v, n, m, a, b in rows:
            apart = least_apart(a, b)
            if (NEAR_WHOLE + NEAR_PART) * apart <= (NEAR_WHOLE - NEAR_PART) * (n + m):
                yield u, v, apart

    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("apart", pa.int64())])
    return per_document(both, kernel, schema, "u long, v long, apart long").groupBy("u", "v").agg(F.min("apart").alias("apart"))


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The (u, v) of pairs (stored) whose whole sets of shingles are similar enough."""

    def whole(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield doc_id, np.unique(shingle_hashes(text, NEAR_WORDS)).tobytes()

    nodes = checkpointed(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    texts = docs.select("doc_id", "text").join(_few(nodes), "doc_id", "left_semi")
    sets = checkpointed(per_document(texts, whole, pa.schema([("root", pa.int64()), ("own", pa.binary())]), "root long, own binary"))
    both = pairs.join(sets.select(F.col("root").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("root").alias("v"), F.col("own").alias("b")), "v").select("u", "v", "a", "b")

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        for u, v, a, b in rows:
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if NEAR_WHOLE * common >= NEAR_PART * (len(x) + len(y) - common):
                yield u, v

    return per_document(both, kernel, pa.schema([("u", pa.int64()), ("v", pa.int64())]), "u long, v long")


def near_copies(docs: DataFrame) -> DataFrame:
    """(node, component) of the documents that have a near copy: components over every pair with five-word Jaccard similarity of 0.8 or more.

    Links are guessed first: the trie's links of the sets' fingerprints, and for each document the nearest fingerprints before it in the buckets of
    prefix filtering. At most three guesses a document are confirmed on whole texts, so a group of copies costs a few links each and not all pairs.
    Prefix filtering then gives every pair that can be similar and that these links leave in different components, and these are confirmed too, the
    likeliest pair of each two components before the others.
    """
    docs = docs.where("doc_id is not null")
    with small_batches(docs.sparkSession, 1000):
        return _near_copies(docs)


def _near_copies(docs: DataFrame) -> DataFrame:
    prints = checkpointed(_prefixes(docs))
    classes = prints.groupBy("sig").agg(F.min("doc_id").alias("root"), F.count("*").alias("held")).where("held > 1")
    equal = checkpointed(prints.select("sig", "doc_id").join(classes, "sig").where("doc_id <> root").select("sig", "doc_id", "root").distinct())
    firsts = prints.join(_few(equal.select("sig", "doc_id")), ["sig", "doc_id"], "left_anti")
    found = checkpointed(_guessed(firsts))
    prefixes = found.where("v is null").select("shingle", F.col("u").alias("root"), "size")
    fingerprints = firsts.groupBy("fp").agg(F.min("doc_id").alias("root")).select(F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), "root")
    trie = links(fingerprints, 64, 3).select("u", "v", F.lit(3).cast("long").alias("bits"))
    guesses = found.where("v is not null").select("u", "v", "bits").unionByName(trie).where("u <> v")
    nearest = guesses.groupBy("u").agg(F.slice(F.array_sort(F.collect_set(F.struct("bits", "v"))), 1, _GUESSES).alias("g"))
    guesses = checkpointed(_possible(nearest.select("u", F.explode("g").alias("g")).select("u", "g.v").distinct(), firsts).select("u", "v"))
    near = checkpointed(_confirmed(guesses, docs).unionByName(equal.select(F.col("doc_id").alias("u"), F.col("root").alias("v"))))
    components = checkpointed(connected_components(near))
    rest = checkpointed(_possible(_across(prefixes, components), firsts))
    # one link is enough between two components, so the likeliest pair of each two goes first
    best = _apart(rest, components).groupBy("lo", "hi").agg(F.min(F.struct("apart", "u", "v")).alias("p")).select("p.u", "p.v")
    components = checkpointed(connected_components(_with(components, _confirmed(checkpointed(best), docs))))
    return connected_components(_with(components, _confirmed(checkpointed(_apart(rest, components).select("u", "v")), docs)))


def _with(components: DataFrame, links: DataFrame) -> DataFrame:
    return components.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links)


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """pairs (u, v, apart) whose ends are in different components, with these as lo and hi."""
    side = lambda k: components.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    a, b = F.coalesce("cu", "u"), F.coalesce("cv", "v")
    return pairs.join(side("u"), "u", "left").join(side("v"), "v", "left").select("u", "v", "apart", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <> hi")


@filtering
def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id: one document of each group of near copies (0.8 on five words) stays.

    A document without any word is like no other and stays; so does a row without a doc_id. Rows that repeat a doc_id stay or go together. Other
    columns go through, whatever their names.
    """
    some = docs.where("text is not null").where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select("doc_id", "text")
    gone = checkpointed(near_copies(some).where("node <> component").select(F.col("node").alias("doc_id")).distinct())
    return docs.join(_few(gone), "doc_id", "left_anti").select(docs.columns)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLE_SQL: dict[str, str] = {}
