"""Queries of the core, by name, and the SQL of those that SQL can express."""

from wareloom.queries import audit, catalogue, facts, retrieval, review, selection, signals, strict  # noqa: F401  (each registers its queries)
from wareloom.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
