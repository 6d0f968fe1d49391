"""All queries of the engine's own operators, and the SQL that checks them."""

from __future__ import annotations

from . import answer_queries, briefing_queries, explaining_queries, extra_queries, graph_queries, history_queries, matching_queries, mode_queries, pipeline_queries, report_queries, suggestion_queries, text_queries

_MODULES = [graph_queries, history_queries, text_queries, report_queries, extra_queries, matching_queries, answer_queries, suggestion_queries, briefing_queries, explaining_queries, mode_queries, pipeline_queries]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
