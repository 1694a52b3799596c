"""Registered queries and their oracle SQL, by name."""

from . import queries as _queries

QUERIES = _queries.QUERIES
ORACLE = _queries.ORACLE
