"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest
from conftest import plan_of

from __spark_entry__ import entry, oracle_sql, queries
from strandline.plans import catalog
from tools.check import duck, duck_side, off_types, spark_side

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="shared tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    cols, kinds, left = spark_side(queries()[name](spark, FOLDER))
    if name not in oracle_sql():
        assert left
        return
    right_cols, types, right = duck_side(con, oracle_sql()[name])
    assert cols == right_cols
    assert off_types(cols, kinds, types) == []
    assert left == right


def test_entry(spark):
    assert entry(spark).count() > 0


def test_plans_have_no_hidden_products(spark):
    for name in ("interval_join_nearest", "substring_candidates", "pattern_join", "pair_difference", "similarity_network", "knn_search", "nearest", "zscore"):
        if name in catalog.queries():
            plan = plan_of(catalog.queries()[name](spark, FOLDER))
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_scans_are_pruned(spark):
    plan = plan_of(catalog.queries()["series_export"](spark, FOLDER))
    assert "l_comment" not in plan and "ReadSchema" in plan
    scan = [x for x in plan.splitlines() if "lineitem.parquet" in x][0]
    assert "l_linenumber" not in scan and "l_linestatus" not in scan
