"""Registry of the queries for the engine's own operators."""

from __future__ import annotations

from lauda import queries_assoc, queries_counts, queries_documents, queries_links, queries_records, queries_state

_MODULES = [queries_documents, queries_records, queries_counts, queries_links, queries_state, queries_assoc]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
