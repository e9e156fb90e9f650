"""All queries of the operators outside the training-data subpackage, with their DuckDB SQL."""

from tracewell.plans import queries, report_queries

QUERIES = queries.QUERIES | report_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | report_queries.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
