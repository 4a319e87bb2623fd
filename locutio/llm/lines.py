"""Line dedup by the spread of a line over distinct sites.

Each line hash gets a HyperLogLog sketch of its sites, kept as rows: (line hash, register, rank) under a maximum, which merges by aggregation and
combines on the map side, so a line that a third of all rows hold costs each task a few rows. Its registers bound the sites from below and the
copies of a line from above; lines that these leave open get an exact distinct count. Lines on enough sites are boilerplate: the document with the smallest doc_id keeps the first of them, every other goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import appended, checkpointed, filtering, table

REGISTERS = 256
MIN_SITES = 10
#: Up to so many boilerplate hashes (16 bytes each) go to every executor; more are joined to their documents by a shuffle.
BROADCAST_LINES = 1_000_000


def _line_rows(docs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, site, line) of each line that isn't blank."""
    lines = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("site"), F.explode(F.split("text", "\n")).alias("line"), *also)
    return lines.where(F.trim("line") != "").select("doc_id", "site", F.xxhash64(F.trim("line")).alias("line"), *also)


def line_spread(docs: DataFrame, registers: int = REGISTERS) -> DataFrame:
    """(line, sites double, keeper, used, held): estimated number of distinct sites of each line hash, the smallest doc_id that holds it, and two
    bounds of that number: the registers used, below, and the times it stands anywhere, above."""
    h = F.xxhash64("site")
    bits = registers.bit_length() - 1
    rank = F.lit(64 - bits + 1) - F.when(F.shiftrightunsigned(h, bits) == 0, 0).otherwise(F.length(F.bin(F.shiftrightunsigned(h, bits))))
    rows = _line_rows(docs).select("line", "doc_id", h.bitwiseAND(registers - 1).cast("int").alias("register"), rank.cast("int").alias("rank"))
    sketch = rows.groupBy("line", "register").agg(F.max("rank").alias("rank"), F.min("doc_id").alias("keeper"), F.count("*").alias("held"))
    merged = sketch.groupBy("line").agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count("*").alias("used"), F.min("keeper").alias("keeper"), F.sum("held").alias("held"))
    m = float(registers)
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.lit(m) - F.col("used") + F.col("s"))
    small = F.lit(m) * F.log(F.lit(m) / (F.lit(m) - F.col("used")))
    return merged.select("line", F.when((raw <= 2.5 * m) & (F.col("used") < registers), small).otherwise(raw).alias("sites"), "keeper", "used", "held")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, registers: int = REGISTERS) -> DataFrame:
    """(line, keeper) of the line hashes on min_sites or more distinct sites. Exact: only what both bounds of the sketch leave open is counted."""
    spread = checkpointed(line_spread(docs, registers).where(F.col("held") >= min_sites))
    sure = spread.where(F.col("used") >= min_sites).select("line", "keeper")
    near = spread.where(F.col("used") < min_sites)
    pairs = _line_rows(docs).select("line", "site").distinct().join(near.select("line"), "line", "left_semi")
    exact = pairs.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return sure.unionByName(near.join(exact, "line", "left_semi").select("line", "keeper"))


def _kept(text: str, doc_id: int | None, lines: np.ndarray, keepers: np.ndarray, no_keeper: np.ndarray) -> tuple[str, int, int]:
    """text without the lines whose hash is among lines (sorted), but for the first of each that doc_id keeps; number of lines, and of those removed."""
    own = text.split("\n")
    at = [k for k, line in enumerate(own) if line.strip(" ")]
    if not at or not len(lines):
        return text, len(own), 0
    h = np.array([xxhash.xxh64_intdigest(own[k].strip(" ").encode("utf-8", "surrogatepass"), 42) for k in at], np.uint64).view(np.int64)
    place = np.minimum(np.searchsorted(lines, h), len(lines) - 1)
    gone, seen = set(), set()
    for k in np.flatnonzero(lines[place] == h).tolist():
        p = int(place[k])
        if doc_id is None or no_keeper[p] or keepers[p] != doc_id or p in seen:
            gone.add(at[k])
        seen.add(p)
    return "\n".join(line for k, line in enumerate(own) if k not in gone), len(own), len(gone)


def _arrays(lines: list[int], keepers: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes = np.array(lines, np.int64)
    order = np.argsort(hashes)
    return hashes[order], np.array([k or 0 for k in keepers], np.int64)[order], np.array([k is None for k in keepers], bool)[order]


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of each row of docs: text without the lines that are boilerplate.

    Lines are what newlines part; they count as equal if they are so without outer spaces, whatever their length, and blank lines always stay. A site is
    the column source; a null source is one site. The smallest doc_id that holds a line keeps its first copy, in each row that repeats that doc_id. A row
    without a doc_id counts for the sites and keeps no boilerplate. A null text stays null with no lines.
    """
    return _stripped(docs.select("doc_id", "text", "source"), min_sites, broadcast_lines).select("doc_id", F.col("__text").alias("text"), F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


def _stripped(docs: DataFrame, min_sites: int, broadcast_lines: int) -> DataFrame:
    found = checkpointed(boilerplate(docs, min_sites))
    fields = [("text", pa.string(), "string"), ("n_lines", pa.int64(), "bigint"), ("n_removed", pa.int64(), "bigint")]
    if found.count() <= broadcast_lines:
        local = found.toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(_arrays(local["line"].to_pylist(), local["keeper"].to_pylist()))

        def kernel(doc_id: int | None, text: str | None) -> tuple:
            return (None, 0, 0) if text is None else _kept(text, doc_id, *shared.value)

        return appended(docs, ["doc_id", "text"], kernel, fields)

    # a row is known by its doc_id, which may be null, and its text
    keyed = docs.withColumn("__row", F.xxhash64("text"))
    own = _line_rows(keyed, "__row").select("doc_id", "__row", "line").distinct().join(found, "line")
    own = own.groupBy(F.col("doc_id").alias("__id"), F.col("__row").alias("__key")).agg(F.collect_list(F.struct("line", "keeper")).alias("__lines"))
    both = keyed.join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__key")), "left").select(*docs.columns, "__lines")

    def joined(doc_id: int | None, text: str | None, lines: list | None) -> tuple:
        return (None, 0, 0) if text is None else _kept(text, doc_id, *_arrays([x["line"] for x in lines or ()], [x["keeper"] for x in lines or ()]))

    return appended(both, ["doc_id", "text", "__lines"], joined, fields)


@filtering
def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with text replaced by what is left of it (and n_chars by its length); a document that was nothing but boilerplate goes."""
    left = _stripped(docs, MIN_SITES, BROADCAST_LINES).where("__text is null or __n_removed = 0 or __text rlike '[^ \\n]'")
    new = {"text": F.col("__text"), "n_chars": F.when(F.col("__n_removed") > 0, F.length("__text").cast("bigint")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return left.select(*(new[c].alias(c) if new.get(c) is not None else F.col(c) for c in docs.columns))


def op7_lines(spark, sf_dir: str) -> DataFrame:
    found = without_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


QUERIES = {"op7_lines": op7_lines}
ORACLE_SQL = {
    "op7_lines": r"""
with l as (select doc_id, coalesce(source, '') as site, i, string_split(text, chr(10))[i] as line
           from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) as t(i) where text is not null),
k as (select *, trim(line, ' ') as t, trim(line, ' ') <> '' as counts from l),
b as (select t, min(doc_id) as keeper from k where counts group by t having count(distinct site) >= 10),
f as (select k.*, b.keeper, b.t is not null and k.counts as bad, row_number() over (partition by k.doc_id, k.t order by i) as nth
      from k left join b on k.t = b.t),
g as (select *, bad and not coalesce(doc_id = keeper and nth = 1, false) as gone from f),
h as (select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
             coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '') as kept from g group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, case when d.text is not null then sha256(kept) end as kept_sha256
from documents d left join h using (doc_id)
"""
}
