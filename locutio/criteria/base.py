"""What a criterion is: a prompt, a validator, a score and display markers as column expressions, and a lexical gate.

A criterion gives expressions and no Python functions on rows, so that Catalyst sees through it. Nothing outside a criterion's module names its fields.
"""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.repair import json_object
from ..functions.text import let
from ..operators.lexicon import Gate

MARKERS = "array<struct<etiqueta:string,tono:string>>"
VERDICT = f"struct<ok:boolean,problema:string,ajustes:array<string>,criterio:string,score:double,justificacion:string,marcadores:{MARKERS},campos:map<string,string>>"


def prompt_text(name: str) -> str:
    """The prompts are stored word for word, because stored answers are found by their hash."""
    return (Path(__file__).parent / f"{name}_prompt.txt").read_text(encoding="utf-8")


class Criterion(ABC):
    id: str
    name: str
    description: str
    scope: str
    system_prompt: str
    keys_reminder: str
    gate: Gate
    validator_version = 1

    @property
    def prompt_hash(self) -> str:
        return hashlib.sha1(self.system_prompt.encode()).hexdigest()[:8]

    # The wording of the prompts, which the recorded answers belong to.
    def prompt(self, text: Column, language: Column) -> Column:
        quoted = F.replace(text, F.lit('"'), F.lit("'"))
        return F.concat(F.lit("Idioma detectado: "), language, F.lit('\nAfirmacion: "'), quoted, F.lit('"\n\nJSON:'))

    def correction(self, text: Column, language: Column, problem: Column) -> Column:
        said = F.concat(F.lit("\n\nTu respuesta anterior fue invalida ("), problem, F.lit(f"). Devuelve solo el objeto JSON con las {self.keys_reminder} y nada mas."))
        return F.concat(self.prompt(text, language), said)

    @abstractmethod
    def verdict(self, answer: Column) -> Column:
        """VERDICT struct of a parsed answer (variant)."""

    def validated(self, raw: Column) -> Column:
        """VERDICT struct of a raw answer."""

        def parsed(found: Column) -> Column:
            missing = F.when(found.isNull(), self._bad("no se encontro ningun objeto JSON en la respuesta"))
            return let(F.try_parse_json(found), lambda answer: missing.when(answer.isNull(), self._bad("JSON malformado")).otherwise(self.verdict(answer)))

        return let(json_object(raw), parsed)

    @staticmethod
    def _bad(problem: str | Column) -> Column:
        text = F.lit(problem) if isinstance(problem, str) else problem
        return F.struct(
            F.lit(False).alias("ok"), text.alias("problema"), F.lit(None).cast("array<string>").alias("ajustes"), F.lit(None).cast("string").alias("criterio"), F.lit(None).cast("double").alias("score"),
            F.lit(None).cast("string").alias("justificacion"), F.lit(None).cast(MARKERS).alias("marcadores"), F.lit(None).cast("map<string,string>").alias("campos"),
        )

    def _good(self, notes: Column, score: Column, reason: Column, markers: Column, fields: dict[str, Column]) -> Column:
        flat = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]
        return F.struct(
            F.lit(True).alias("ok"), F.lit(None).cast("string").alias("problema"), notes.alias("ajustes"), F.lit(self.id).alias("criterio"), score.cast("double").alias("score"),
            reason.alias("justificacion"), markers.cast(MARKERS).alias("marcadores"), F.create_map(*flat).alias("campos"),
        )


def marker(label: Column, tone: Column) -> Column:
    return F.struct(label.alias("etiqueta"), tone.alias("tono"))


def either(condition: Column, yes: str, no: str) -> Column:
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))
