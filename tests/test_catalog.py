"""Registered queries against their SQL on the small tables; all of them with FULL=1."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare
from factloom.plans import load_catalog

CORE = [
    "check_rules", "summarize_findings", "place_items", "resolve_site", "changed_files", "assemble_tree", "worktree_state_hash", "recompute_scope",
    "carry_forward", "tree_ids", "read_facts", "write_canonical_facts", "package_closure", "reachable_from", "spawned_workers", "topological_layers",
    "propose_areas", "first_claim", "classify_link", "row_fold", "area_cycle", "god_module", "unresolved_dyn", "check_all", "folded_link_counts",
    "stale_write_audit", "tool_state_replay", "fold_reviews", "read_transcripts", "read_git_log", "burst_window", "session_lifecycle", "sql_touches",
    "created_tables", "columns_of_texts", "context_pack", "burst_stream", "quiet_stream", "apply_batch",
]
# Queries of optional packages are held against their own tests.
QUERIES, ORACLES = load_catalog()
NAMES = list(QUERIES) if os.environ.get("FULL") else CORE


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf_dir, name):
    said, _, _ = compare(spark, QUERIES, ORACLES, name, sf_dir)
    assert said.startswith("ok"), said


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
