"""The registered queries with their SQL counterparts."""

from passageworks.queries import chunks, lineage, tables, talks, texts, vectors  # noqa: F401
from passageworks.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
