"""All queries outside the subpackage ``llm``, with their SQL."""

from __future__ import annotations

from . import cleaning_queries, encoding_queries, graph_queries, label_queries, model_queries, sequence_queries, training_queries, value_queries

_MODULES = (cleaning_queries, encoding_queries, graph_queries, label_queries, model_queries, sequence_queries, training_queries, value_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
