"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import os

import oracle
import pytest

import __spark_entry__

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["split", "label", "slot", "rows", "total"]
    assert frame.count() > 0


def test_oracles_name_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_agrees(spark, duck, name):
    difference = oracle.difference(
        spark, duck, FOLDER, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name]
    )
    assert difference is None


@pytest.mark.parametrize("name", ["first_rows", "numeric_summary_approx", "distinct_counts_approx", "rf_scores", "tree_scores", "importances"])
def test_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, FOLDER).count() > 0
