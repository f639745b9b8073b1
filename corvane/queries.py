"""Registry of the library's own queries and of the SQL that gives the same rows."""

from __future__ import annotations

from corvane.operators import detail_queries, lexical_queries, people_queries, ranking_queries, table_queries, upkeep_queries

FLAGSHIP = "recommend_groups"
_MODULES = (ranking_queries, table_queries, lexical_queries, people_queries, detail_queries, upkeep_queries)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _MODULES for name, s in m.SQL.items()}
