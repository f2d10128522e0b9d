"""Queries over the driver's tables, one or more for each operator, with their SQL."""

from __future__ import annotations

from . import market, news, records

MODULES = (market, news, records)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
FLAGSHIP = "signals"
