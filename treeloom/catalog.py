"""The registered queries of the comparison engine, and SQL to hold them against."""

from __future__ import annotations

from treeloom.plans import change_queries, ledger_queries, source_queries, text_queries, tree_queries

MODULES = (text_queries, tree_queries, change_queries, ledger_queries, source_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
FLAGSHIP = "doc_line_diff_stats"
