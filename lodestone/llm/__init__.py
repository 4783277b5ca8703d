"""Operators for training-data pipelines and the queries that apply them to the test tables."""

from lodestone.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
