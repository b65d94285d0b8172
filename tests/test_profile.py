import math
import random

import pytest
from pyspark.sql import functions as F

from retentia.functions.columns import columns_types
from retentia.functions.ordering import discrete_rank, exact_quantiles, median_ranks, running_total, smallest_rows
from retentia.operators import profile


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.sql(
        """SELECT * FROM VALUES (1, 'None', 1.5D, true, array(1), timestamp_ntz'2024-01-01', named_struct('a', 1), 1.0BD),
           (NULL, '', double('NaN'), NULL, NULL, NULL, NULL, NULL) AS t(i, s, d, b, a, ts, st, dec)"""
    )


def test_column_groups(mixed):
    groups = columns_types(mixed)
    assert groups == {
        "numeric_cols": ["i", "d"],
        "categorical_cols": ["s"],
        "boolean_cols": ["b"],
        "array_cols": ["a"],
        "struct_cols": ["st"],
        "unknown_cols": ["ts", "dec"],
    }
    assert columns_types(mixed, wide_numeric=True)["numeric_cols"] == ["i", "d", "dec"]


def test_schema_and_first_rows(mixed):
    schema, rows = profile.show_summary_general(mixed, 1)
    assert [tuple(row)[1:3] for row in schema.orderBy("position").take(2)] == [("i", "int"), ("s", "string")]
    assert rows.count() == 1


def test_value_counts_keep_null(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", None)], "p string, q string")
    counts = {tuple(row) for row in profile.show_summary_categoricals(df).collect()}
    assert counts == {("p", "a", 2), ("p", "b", 1), ("q", "x", 1), ("q", None, 2)}
    assert profile.show_summary_categoricals(spark.range(2)).count() == 0


def test_summary_edges(spark):
    df = spark.sql("SELECT CAST(NULL AS double) AS x, CAST(id AS int) AS n FROM range(5)")
    for how in ("exact", "approx"):
        rows = {row["column"]: row for row in profile.show_summary_numerical(df, quantiles=how).collect()}
        assert tuple(rows["x"])[1:] == (0, *[None] * 7)
        assert tuple(rows["n"])[1:] == (5, 2.0, pytest.approx(math.sqrt(2.5)), 0.0, 1.0, 2.0, 3.0, 4.0)
    assert profile.show_summary_numerical(df.select(F.lit("a").alias("t"))).count() == 0
    with pytest.raises(ValueError):
        profile.show_summary_numerical(df, quantiles="rough")


def test_class_distribution_of_nothing(spark):
    assert profile.show_summary_labels(spark.range(0), "id").count() == 0


def test_unknown_aggregate(spark):
    with pytest.raises(ValueError):
        profile.aggregate_by_name(spark.range(1), {"id": "mode"})


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantiles(spark, accuracy):
    draw = random.Random(accuracy)
    values = {
        "even": [draw.random() for _ in range(3000)],
        "hot": [7.0 if draw.random() < 0.4 else draw.gauss(7, 1) for _ in range(3000)],
        "steps": [float(draw.randint(0, 3)) for _ in range(3000)],
        "nan": [math.nan if draw.random() < 0.3 else draw.random() for _ in range(3000)],
    }
    df = spark.createDataFrame(list(zip(*values.values())), ", ".join(f"{name} double" for name in values))
    df = df.unionByName(spark.sql("SELECT " + ", ".join(f"CAST(NULL AS double) AS {name}" for name in values)))
    shares = [0.0, 0.01, 0.25, 0.4, 0.5, 0.75, 0.999, 1.0]
    found, extra = exact_quantiles(
        df, dict.fromkeys(values, shares), extra=[F.count(F.lit(1))], small=10, accuracy=accuracy
    )
    assert extra[0] == 3001
    for name, column in values.items():
        ordered = sorted(column, key=lambda v: (v != v, v))
        for share in shares:
            wanted, got = ordered[discrete_rank(share, 3000)[0]], found[name, share][0]
            assert got == wanted or (got != got and wanted != wanted), (name, share)


def test_medians(spark):
    df = spark.createDataFrame([(1, None), (2, None), (10, None), (11, None)], "x int, y int")
    found, _ = exact_quantiles(df, {"x": [0.5], "y": [0.5]}, median_ranks)
    assert found == {("x", 0.5): [2, 10], ("y", 0.5): []}


def test_running_total(spark):
    rows = [("ab"[n % 2], n, n % 5) for n in range(500)]
    df = spark.createDataFrame(rows, "g string, n int, v int")
    totals = running_total(df, ["g"], [F.col("n").desc()], F.col("v"), "before").collect()
    assert len(totals) == 500
    for row in totals:
        assert row.before == sum(v for g, n, v in rows if g == row.g and n > row.n)


@pytest.mark.parametrize("n", [1, 7, 60, 299, 300, 400])
def test_smallest_rows(spark, n):
    rows = [(float(at % 4), at) for at in range(300)]
    df = spark.createDataFrame(rows, "score double, id long")
    wanted = set(sorted(rows)[:n])
    for one_task_rows in (5, 1000):
        assert {tuple(row) for row in smallest_rows(df, ["score", "id"], n, one_task_rows).collect()} == wanted
