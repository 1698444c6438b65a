"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from veritext.plans import graph, records, search

QUERIES = search.QUERIES | graph.QUERIES | records.QUERIES
ORACLE_SQL = search.ORACLE_SQL | graph.ORACLE_SQL | records.ORACLE_SQL
