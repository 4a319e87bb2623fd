"""The criteria by id. A new criterion is a module and a line here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .authority import Authority
from .base import Criterion
from .causal import Causal

DEFAULT = Causal.id
_ALL: dict[str, Criterion] = {c.id: c for c in (Causal(), Authority())}


def criterion(name: str = DEFAULT) -> Criterion:
    if name not in _ALL:
        raise KeyError(f'No existe el criterio "{name}". Disponibles: {", ".join(_ALL)}')
    return _ALL[name]


def all_criteria() -> list[Criterion]:
    return list(_ALL.values())


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(c.id, c.name, c.description, c.scope, c.prompt_hash, c.gate.total, c.gate.labels) for c in _ALL.values()]
    return spark.createDataFrame(rows, "id string, nombre string, descripcion string, alcance string, hash_prompt string, patrones int, etiquetas int")
