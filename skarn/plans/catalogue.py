"""Every registered query of the library's own operators, with its DuckDB counterpart."""

from __future__ import annotations

from . import evaluation_queries, event_queries, evidence_queries, graph_queries, knowledge_queries, record_queries, relation_queries, retrieval_queries, scoring_queries, text_queries

_REGISTRIES = [m.REGISTRY for m in (retrieval_queries, evaluation_queries, event_queries, text_queries, relation_queries, scoring_queries, record_queries, knowledge_queries, evidence_queries, graph_queries)]
QUERIES = {k: q for r in _REGISTRIES for k, q in r.queries.items()}
ORACLE_SQL = {k: s for r in _REGISTRIES for k, s in r.sql.items()}
