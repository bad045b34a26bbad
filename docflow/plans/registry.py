"""The queries of the library's own operators, with their DuckDB counterparts."""

from docflow.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
