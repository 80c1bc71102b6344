"""All queries of the core engine by name, and SQL that gives the same rows."""

from __future__ import annotations

from leafwork.plans import blocks, detect, geometry, layout, quality, script

MODULES = (geometry, script, layout, blocks, detect, quality)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
