"""All registered queries of the model and the SQL that checks them."""

from __future__ import annotations

from . import catalogue, ingest_catalogue, operator_catalogue, sessions_catalogue

_CATALOGUES = (catalogue, sessions_catalogue, operator_catalogue, ingest_catalogue)
QUERIES = {name: query for c in _CATALOGUES for name, query in c.QUERIES.items()}
ORACLE_SQL = {name: sql for c in _CATALOGUES for name, sql in c.ORACLE_SQL.items()}
