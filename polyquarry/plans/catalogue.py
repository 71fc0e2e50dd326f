"""All core queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from polyquarry.plans import documents, pairs, problems, repairs, scores, streams, texts

_MODULES = [scores, documents, problems, texts, pairs, repairs, streams]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
