"""All queries of the core with their SQL."""

from __future__ import annotations

from tidemark.plans import data_quality, files, models, relational

MODULES = [data_quality, relational, models, files]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
