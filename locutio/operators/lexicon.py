"""The lexical gate: which claims hold a marker of a criterion.

A claim is first tested against one regular expression, the patterns folded into a tree of letters, so that most text is refused in a single pass. What
is left is cut into runs of one to five words, and those that are patterns are looked up in a literal map. Nothing is shuffled or exploded.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, normalise

# Endings of regular verbs in -ar.
AR_ENDINGS = "o aron ando ada ado adas ados a an aba aban".split()


@dataclass(frozen=True)
class Entry:
    pattern: str
    label: str
    lang: str


def plain(label: str) -> str:
    """The pattern of a label: lower case, no diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", label.lower()) if not 0x300 <= ord(c) <= 0x36F)


def ar_verb(stem: str) -> list[Entry]:
    """All spoken forms of a verb under its infinitive."""
    return [Entry(stem + ending, stem + "ar", "es") for ending in AR_ENDINGS]


def listed(lang: str, labels: str) -> list[Entry]:
    """One entry a line; ``pattern = label`` where the pattern isn't the label without diacritics."""
    out = []
    for line in labels.strip().split("\n"):
        for item in line.split(","):
            left, _, right = item.strip().partition(" = ")
            if left:
                out.append(Entry(left if right else plain(left), right or left, lang))
    return out


def _tree(patterns: list[str]) -> str:
    """Alternatives as a prefix tree, so that each place of a text is tested once."""
    root: dict = {}
    for p in patterns:
        node = root
        for c in p:
            node = node.setdefault(c, {})
        node[""] = {}

    def text(node: dict) -> str:
        parts = [("\\s+" if c == " " else c) + text(n) for c, n in sorted(node.items()) if c]
        if "" in node:
            parts.append("(?!\\p{L})")
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return text(root) if root else "(?!)"


class Gate:
    """A compiled list of entries."""

    def __init__(self, entries: list[Entry]) -> None:
        self.entries = entries
        self.total, self.labels = len(entries), len({e.label for e in entries})
        self.longest = max((e.pattern.count(" ") + 1 for e in entries), default=0)
        self.pattern = "(?<!\\p{L})" + _tree(sorted({e.pattern for e in entries}))

    def markers(self, text: Column) -> Column:
        """Labels of the patterns in text, each once, in the order of the list; empty for null."""
        none = F.array().cast("array<string>")
        if not self.entries:
            return none
        patterns = F.array(*(F.lit(p) for p in dict.fromkeys(e.pattern for e in self.entries)))
        first: dict[str, str] = {}
        for e in self.entries:
            first.setdefault(e.pattern, e.label)
        names = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))

        def runs(tokens: Column, n: int) -> Column:
            places = F.sequence(F.lit(1), F.size(tokens) - n + 1)
            return F.when(F.size(tokens) >= n, F.transform(places, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(none)

        def looked_up(norm: Column) -> Column:
            tokens = F.split(F.trim(F.regexp_replace(norm, "[^\\p{L}\\s]+", " | ")), "\\s+")
            found = let(tokens, lambda t: F.array_intersect(patterns, F.concat(*(runs(t, n) for n in range(1, self.longest + 1)))))
            labels = F.array_distinct(F.transform(found, lambda p: F.element_at(names, p)))
            return F.when(norm.rlike(self.pattern), labels).otherwise(none)

        return let(normalise(F.coalesce(text, F.lit(""))), looked_up)

    def markers_by_regex(self, text: Column) -> Column:
        """The same by one regular expression a pattern; slow, for cross-checks."""
        test = lambda norm, e: F.when(norm.rlike("(?<!\\p{L})" + e.pattern.replace(" ", "\\s+") + "(?!\\p{L})"), F.lit(e.label))
        return let(normalise(F.coalesce(text, F.lit(""))), lambda norm: F.array_distinct(F.array_compact(F.array(*(test(norm, e) for e in self.entries)))))

    def frame(self, spark: SparkSession, criterion: str) -> DataFrame:
        """The list as a table (criterio, ord, patron, etiqueta, idioma)."""
        rows = [(criterion, k, e.pattern, e.label, e.lang) for k, e in enumerate(self.entries)]
        return spark.createDataFrame(rows, "criterio string, ord int, patron string, etiqueta string, idioma string")


def gated(claims: DataFrame, gate: Gate | None, use: bool = True, limit: int | None = None) -> DataFrame:
    """claims plus marcadores and preseleccionada.

    Without use everything is selected and the markers stay. limit keeps the first so many selected claims of each document selected; it counts over
    the document in order of indice, and the other rows stay.
    """
    from pyspark.sql import Window

    marked = claims.withColumn("marcadores", gate.markers(F.col("texto")) if gate else F.array().cast("array<string>"))
    out = marked.withColumn("preseleccionada", F.size("marcadores") > 0 if use else F.lit(True))
    if limit is None:
        return out
    so_far = F.count_if("preseleccionada").over(Window.partitionBy("doc_id").orderBy("indice").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("preseleccionada", F.col("preseleccionada") & (so_far <= limit))
