"""The queries of this subpackage and the SQL that gives their rows where SQL can."""

from __future__ import annotations

from . import bpe, decontaminate, language, licenses, lines, neighbours, packing, resample, simhash, spelling, suffixes, toxicity, urls

_MODULES = (licenses, simhash, language, suffixes, toxicity, packing, lines, decontaminate, urls, neighbours, bpe, spelling, resample)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
