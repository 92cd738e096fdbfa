"""A part of the DuckDB comparison, at the smallest scale; ``tests.compare`` runs all of it."""

import pytest

from codelattice.plans import load
from tests.compare import ROOT, compare, connect

FOLDER = f"{ROOT}/sf0.001"
QUERIES, ORACLES = load()
NAMES = [
    "edge_rollup", "neighbourhood", "locate_enclosing_nearest", "file_delta_apply", "virtual_entity_create",
    "snapshot_restore_edges", "snapshot_reconcile_nodes", "compact_chains", "symbol_table", "apply_edits_desc", "save_debounce",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, QUERIES, ORACLES) == "ok"


def test_every_query_is_callable_and_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES) and all(callable(q) for q in QUERIES.values())
