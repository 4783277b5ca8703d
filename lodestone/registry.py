"""All named queries and their DuckDB equivalents."""

import importlib

QUERIES, ORACLES = {}, {}
for _name in ("text", "search", "behaviour", "page"):
    _module = importlib.import_module(f"lodestone.plans.{_name}_queries")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
