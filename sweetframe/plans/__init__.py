"""Queries over the given tables, and the SQL that must give the same rows."""

from sweetframe.plans import composite, events, glucose, local, outcomes, sources  # noqa: F401
from sweetframe.plans._base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
