"""The lexical gate as a join: what texts say, as runs of tokens, meets a table of patterns.

For lexicons that are tables and may be large. A text falls into tokens (runs of letters, single other characters, blanks); runs with as many tokens as
some pattern has are exploded and joined with the patterns on the run itself, by broadcast if the lexicon is small. A run begins and ends where no letter
goes on, so the hits are those of the regular-expression gate. Only hits are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, normalise, trimmed

#: A lexicon of up to so many bytes goes to every executor; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
TOKEN = r"\p{L}+|[^\p{L} ]| "


def tokens(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(TOKEN), F.lit(0))


def runs(text: Column, sizes: list[int]) -> Column:
    """The distinct runs of sizes tokens of a text, without a blank or a cut word at either end; none for null."""

    def of(own: Column, letters: Column) -> Column:
        def sized(m: int) -> Column:
            last = F.size(own) - m
            starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
            opens = lambda i: (F.get(own, i) != " ") & (F.get(letters, i) | (i == 0) | ~F.get(letters, i - 1))
            closes = lambda i: (F.get(own, i) != " ") & (F.get(letters, i) | (i == F.size(own) - 1) | ~F.get(letters, i + 1))
            return F.transform(F.filter(starts, lambda i: opens(i) & closes(i + m - 1)), lambda i: F.array_join(F.slice(own, i + 1, m), ""))

        return F.array_distinct(F.concat(*map(sized, sizes))) if sizes else F.array().cast("array<string>")

    found = let(tokens(normalise(text)), lambda own: let(F.transform(own, lambda t: t.rlike(r"^\p{L}")), lambda letters: of(own, letters)))
    return F.coalesce(found, F.array().cast("array<string>"))


def patterns(lexicon: DataFrame) -> DataFrame:
    """(patron, etiqueta, ord): each pattern with each of its labels, normalised; empty patterns go."""
    norm = lexicon.select(trimmed(normalise(F.col("patron"))).alias("patron"), "ord", "etiqueta").where("patron <> ''")
    return norm.groupBy("patron", "etiqueta").agg(F.min("ord").alias("ord"))


def hits(rows: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "texto", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(keys, marcadores) of the rows whose text holds a pattern: its labels, each once, in the order of the list. Rows with equal keys count as one.

    lexicon (ord, patron, etiqueta). The numbers of tokens that its patterns have, and its size, are read first.
    """
    known = patterns(lexicon)
    facts = known.agg(F.collect_set(F.size(tokens(F.col("patron")))).alias("sizes"), F.coalesce(F.sum(F.octet_length("patron") + F.octet_length("etiqueta") + 32), F.lit(0)).alias("bytes")).first()
    small = facts["bytes"] <= broadcast_bytes
    said = rows.select(*keys, F.explode(runs(F.col(text), sorted(facts["sizes"]))).alias("patron"))
    met = said.join(F.broadcast(known) if small else known.hint("shuffle_hash"), "patron")
    labels = met.groupBy(*keys, "etiqueta").agg(F.min("ord").alias("ord")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "etiqueta"))).alias("l"))
    return labels.select(*keys, F.transform("l", lambda x: x.etiqueta).alias("marcadores"))


def marked(rows: DataFrame, lexicon: DataFrame, text: str = "texto", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """rows plus marcadores and preseleccionada, as the gate gives them. Markers belong to a text, so rows meet them by its MD5 and equal texts are judged
    alike; a null or empty text has none."""
    key = F.md5(F.col(text).cast("binary"))
    found = hits(rows.select(F.col(text).alias("_text"), key.alias("_key")), lexicon, ["_key"], "_text", broadcast_bytes)
    out = rows.join(found.withColumnRenamed("marcadores", "_found"), key == F.col("_key"), "left")
    none = F.array().cast("array<string>")
    return out.select(*rows.columns, F.coalesce("_found", none).alias("marcadores"), F.col("_found").isNotNull().alias("preseleccionada"))
