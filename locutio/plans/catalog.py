"""All queries and their SQL."""

from __future__ import annotations

from . import audio_queries, gate_queries, language_queries, metric_queries, report_queries, segment_queries, source_queries, store_queries  # noqa: F401  they register queries
from .queries import Q

QUERIES = {name: f for name, (f, _) in Q.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in Q.items() if sql}
