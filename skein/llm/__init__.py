"""Operators for language-model training data. Nothing outside this package imports it."""

from skein.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
