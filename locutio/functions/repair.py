"""Repair of a small model's answers: the JSON object inside them, booleans, scores and enumerations in other spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, trimmed


def json_object(text: Column) -> Column:
    """The first balanced object of text, code fences removed; braces inside strings don't count. Null without one.

    A fold over quotes, braces, backslashes and the stretches between them, which keeps the depth, whether a string is open and whether a backslash came last; linear in the text."""
    clean = F.regexp_replace(text, "(?i)```(?:json)?", "")
    rest = F.substring(clean, F.instr(clean, "{"), F.length(clean))
    tokens = F.regexp_extract_all(rest, F.lit(r'[{}"\\]|[^{}"\\]+'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("said"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, t: Column) -> Column:
        outside = ~s.said
        depth = s.depth + F.when(outside & (t == "{"), 1).when(outside & (t == "}"), -1).otherwise(0)
        said = F.when(t == '"', outside | s.escaped).otherwise(s.said)
        at = s.at + F.length(t)
        new = F.struct(depth.alias("depth"), said.alias("said"), (s.said & ~s.escaped & (t == "\\")).alias("escaped"), at.alias("at"), F.when(depth == 0, at).otherwise(0).alias("end"))
        return F.when(s.end > 0, s).otherwise(new)

    found = lambda own: F.aggregate(tokens, start, step, lambda s: F.when(s.end > 0, F.substring(own, F.lit(1), s.end)))
    return F.when(F.instr(clean, "{") > 0, found(rest))


def kind(value: Column) -> Column:
    """BOOLEAN, STRING, VOID, a number's type, OBJECT<..> or ARRAY<..>; null if the key is missing."""
    return F.schema_of_variant(value)


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def is_number(value: Column) -> Column:
    return kind(value).rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL|SMALLINT|TINYINT)")


def to_boolean(value: Column) -> Column:
    """true, a number but 0, or a word for yes or no; else null."""
    word = F.lower(trimmed(as_text(value)))
    return (
        F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(is_number(value), F.try_variant_get(value, "$", "double") != 0)
        .when((kind(value) == "STRING") & word.isin("true", "si", "sí", "yes", "1", "verdadero"), True)
        .when((kind(value) == "STRING") & word.isin("false", "no", "0", "falso"), False)
    )


def to_number(value: Column) -> Column:
    """A number, or the number that a string starts with, a comma for the point; else null."""
    start = F.regexp_extract(F.regexp_replace(as_text(value), "^([^,]*),", "$1."), r"(?U)^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(is_number(value), F.try_variant_get(value, "$", "double")).when(kind(value) == "STRING", start.try_cast("double"))


def to_score(n: Column) -> tuple[Column, Column]:
    """(score from 0 to 1, notes): over 1 and up to 100 counts as percent, the rest is clipped."""
    percent = (n > 1) & (n <= 100)
    scaled = F.when(percent, n / 100).otherwise(n)
    outside = (scaled < 0) | (scaled > 1)
    notes = F.array_compact(F.array(F.when(percent, F.lit("score venia en escala 0-100, reescalado a 0-1")), F.when(outside, F.lit("score recortado al rango 0-1"))))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)), notes


def to_enum(value: Column) -> Column:
    """A string folded and trimmed; empty for a missing or null value; null for anything else."""
    return F.when(value.isNull() | (kind(value) == "VOID"), F.lit("")).when(kind(value) == "STRING", fold(trimmed(as_text(value))))


def to_reason(value: Column) -> Column:
    """A trimmed string of ten characters or more, else null."""
    text = F.when(kind(value) == "STRING", trimmed(as_text(value)))
    return F.when(F.length(text) >= 10, text)
