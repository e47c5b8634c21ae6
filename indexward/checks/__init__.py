"""Registered queries over the TPC-H-like tables, and the SQL that must give the same rows."""

from .oracles import oracle_sql
from .queries import queries

__all__ = ["oracle_sql", "queries"]
