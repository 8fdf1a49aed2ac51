"""Plans: the operators put together into the registered queries."""

from __future__ import annotations

import importlib

GROUPS = ["q_rules", "q_snapshots", "q_graph", "q_areas", "q_invariants", "q_sessions", "q_text", "q_streams"]


def load_catalog():
    """Import every group of queries; the queries and their SQL."""
    for group in GROUPS:
        importlib.import_module(f"factloom.plans.{group}")
    from factloom.plans import catalog
    from factloom.plans.views import duckdb_sql

    return catalog.QUERIES, {name: duckdb_sql(sql) for name, sql in catalog.ORACLES.items()}
