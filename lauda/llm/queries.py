"""Registry of the training-data queries."""

from __future__ import annotations

from lauda.llm import oracle, queries_copies, queries_near, queries_text

_MODULES = [queries_copies, queries_near, queries_text]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in [*_MODULES, oracle] for name, sql in m.ORACLE.items()}
