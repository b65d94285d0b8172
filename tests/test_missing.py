import math

import pytest
from pyspark.sql import functions as F

from retentia.operators import missing


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.sql(
        """SELECT * FROM VALUES (1, 'None', 1.5D, true, array(1), timestamp_ntz'2024-01-01'),
           (NULL, '', double('NaN'), NULL, NULL, NULL), (3, 'is NULL', NULL, false, array(), NULL),
           (4, 'NaN', 4D, true, array(2), NULL) AS t(i, s, d, b, a, ts)"""
    )


def test_report(mixed):
    report = {tuple(row) for row in missing.get_missing_values_count(mixed).collect()}
    assert report == {
        ("i", "Null", 1, 25.0),
        ("s", "None", 1, 25.0),
        ("s", "NULL_string", 1, 25.0),
        ("s", "Empty_string", 1, 25.0),
        ("s", "NaN", 1, 25.0),
        ("d", "Null", 1, 25.0),
        ("d", "NaN", 1, 25.0),
        ("b", "Null", 1, 25.0),
        ("a", "Null", 1, 25.0),
        ("ts", "Null", 3, 75.0),
    }
    any_kind = missing.missing_any(mixed).first().asDict()
    assert any_kind == {"i": 1, "s": 4, "d": 2, "b": 1, "a": 1, "ts": 3}


def test_non_null_denominator(spark):
    df = spark.sql("SELECT id AS k, CAST(NULL AS double) AS x, IF(id = 0, NULL, 1) AS y FROM range(3)")
    report = {row.Column: row.Percentage for row in missing.get_missing_values_count(df, "non_null").collect()}
    assert report == {"x": None, "y": 50.0}
    with pytest.raises(ValueError):
        missing.get_missing_values_count(df, "some")


def test_null_counts_of_nothing(spark):
    row = missing.get_null_counts(spark.range(0), with_percentages=True).first()
    assert row.asDict() == {"id_nulls": 0, "id_nulls%": None}


def test_column_threshold_is_strict(spark):
    df = spark.sql("SELECT id, IF(id < 2, NULL, id) AS half FROM range(4)")
    kept = missing.clean_nulls(df, 1.0, 0.5, {"half": 0})
    assert kept.columns == ["id", "half"] and kept.count() == 4
    assert missing.clean_nulls(df, 1.0, 0.49).columns == ["id"]


def test_all_null_column_survives_threshold_one(spark):
    df = spark.sql("SELECT id, CAST(NULL AS double) AS x FROM range(3)")
    assert missing.clean_nulls(df, 1.0, 1.0, {"x": "median"}).count() == 0
    assert missing.clean_nulls(df, 1.0, 1.0, {"x": "avg"}, "drop_cols").columns == ["id"]


def test_row_threshold_truncates(spark):
    columns = ", ".join(f"IF(id = 0, CAST(NULL AS double), 1D) AS c{n}" for n in range(10))
    df = spark.sql(f"SELECT {columns} FROM range(2)")
    fills = {f"c{n}": 5.0 for n in range(10)}
    assert missing.clean_nulls(df, 0.9, 1.0, fills).count() == 2  # int(10 * (1 - 0.9)) is 0
    assert missing.clean_nulls(df, 0.8, 1.0, fills).count() == 1


def test_nan_counts_as_missing_for_rows_but_not_columns(spark):
    df = spark.createDataFrame([(1, math.nan, None), (2, 1.0, 1.0)], "k int, x double, y double")
    cleaned = missing.clean_nulls(df, 1.0, 1.0)
    assert [row.k for row in cleaned.collect()] == [2]
    nan_only = df.select("k", "x")
    assert missing.clean_nulls(nan_only, 1.0, 1.0).count() == 2


def test_fill_truncates_to_the_column_type(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (4, None)], "k long, x int")
    assert {row.x for row in missing.clean_nulls(df, 1.0, 1.0, {"x": "avg"}).filter("k = 4").collect()} == {2}


@pytest.mark.parametrize("how, wanted", [("sum", 16.0), ("count", 3.0), ("avg", 16 / 3), ("min", 1.0), ("max", 10.0), ("median", 5.0)])
def test_fill_aggregates(spark, how, wanted):
    df = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 10.0), (4, None)], "k long, x double")
    filled = missing.clean_nulls(df, 1.0, 1.0, {"x": how}).filter("k = 4").first().x
    assert filled == pytest.approx(wanted)


def test_fill_of_other_types(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 2.5BD, date'2024-01-01', 'a'), (2, NULL, NULL, NULL) AS t(k, n, d, s)")
    cleaned = missing.clean_nulls(df, 1.0, 1.0, {"n": "max", "d": "min", "s": "x"}).filter("k = 2").first()
    assert (str(cleaned.n), str(cleaned.d), cleaned.s) == ("2.5", "2024-01-01", "x")


def test_clean_nothing(spark):
    assert missing.clean_nulls(spark.range(0), 0.5, 0.5).count() == 0
    with pytest.raises(AssertionError):
        missing.clean_nulls(spark.range(1), 0.5, 0.5, {}, "drop_all")


def test_aggregates_see_only_kept_rows(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (None, 100.0, None), (3, None, "b")], "k int, x double, s string")
    cleaned = missing.clean_nulls(df, 0.4, 1.0, {"x": "max"})  # int(3 * 0.6) = 1 keeps all
    assert {row.x for row in cleaned.collect()} == {1.0, 100.0}
    strict = missing.clean_nulls(df, 0.3, 1.0, {"x": "max"})  # two values needed
    assert {row.x for row in strict.collect()} == {1.0}


def test_jobs(spark):
    """Two aggregations decide a cleaning without medians."""
    df = spark.range(100).select("id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("x"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("cleaning", "cleaning")
    missing.clean_nulls(df, 0.5, 0.5, {"x": "avg"})
    jobs = tracker.getJobIdsForGroup("cleaning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 2 <= len(jobs) <= 4  # each aggregation is a map and a final stage under adaptive execution


def test_report_is_one_aggregation(mixed):
    plan = missing.get_missing_values_count(mixed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
