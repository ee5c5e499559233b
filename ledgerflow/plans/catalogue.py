"""Every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import decisions, extras, features, modelling, statistics

_PARTS = (features, statistics, decisions, modelling, extras)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
