"""The operators as named queries on the test tables, with their SQL twins."""

from repopulse.catalog.oracles import oracle_sql
from repopulse.catalog.queries import QUERIES

__all__ = ["QUERIES", "oracle_sql"]
