"""Every registered query of the engine with its SQL counterpart."""

from __future__ import annotations

from docweave.plans import curation, records, retrieval

MODULES = (retrieval, curation, records)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()} | records.MORE_SQL
