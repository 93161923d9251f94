"""Registered queries of the library and the SQL they are held against."""

from __future__ import annotations

from termweave import catalogs
from termweave.catalogs import flows, graph, ingest, lifecycle, reason, syntaxes, terms

flagship = graph.flagship
__all__ = ["flagship", "flows", "graph", "ingest", "lifecycle", "oracle_sql", "queries", "reason", "syntaxes", "terms"]


def queries() -> dict:
    return dict(catalogs.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalogs.SQL)
