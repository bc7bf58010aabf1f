"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from broadsheet.plans import rule_queries, source_queries, stat_queries, text_queries

QUERIES = text_queries.QUERIES | stat_queries.QUERIES | rule_queries.QUERIES | source_queries.QUERIES
SQL = text_queries.SQL | stat_queries.SQL | rule_queries.SQL | source_queries.SQL
