"""Operators of a training-data pipeline over documents and embeddings."""

from repopulse.llm.oracles import ORACLE_SQL
from repopulse.llm.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
