"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

import importlib

_MODULES = ("source_queries", "ehr_queries", "knowledge_queries", "retrieval_queries", "training_queries")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in _MODULES:
    _module = importlib.import_module(f"{__package__}.{_m}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
