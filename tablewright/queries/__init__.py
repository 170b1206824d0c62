"""The library's registered queries, each beside its DuckDB twin."""

from tablewright.queries import lineage, relational, testing, workloads
from tablewright.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "lineage", "relational", "testing", "workloads"]
