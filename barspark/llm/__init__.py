"""Operators for large-scale training data; nothing else in the library imports this."""

from barspark.llm.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
