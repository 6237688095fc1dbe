"""All queries outside the llm subpackage."""

from __future__ import annotations

from tidemark.plans import control_queries, decision_queries, feature_queries, ops_queries, problems, source_queries

FLAGSHIP = "p4_found"
_MODULES = [problems, feature_queries, decision_queries, ops_queries, control_queries, source_queries]
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
