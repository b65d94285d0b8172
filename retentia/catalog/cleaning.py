from pyspark.sql import functions as F

from retentia.catalog import query, table
from retentia.catalog.profiling import rounded
from retentia.operators import missing

MARKED_EVENTS_SQL = """marked AS (
    SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN user_id END AS user_id,
           CASE event_id % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'is NULL' WHEN 2 THEN '' WHEN 3 THEN event_type END AS event_type,
           CASE event_id % 4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN NULL ELSE value END AS value,
           CASE event_id % 9 WHEN 0 THEN 'nan' ELSE props END AS props, ts
    FROM events)"""
TEXT_TESTS = [
    ("None", "contains({c}, 'None')"),
    ("NULL_string", "contains({c}, 'NULL')"),
    ("Empty_string", "{c} = ''"),
    ("Null", "{c} IS NULL"),
    ("NaN", "isnan(try_cast({c} AS DOUBLE))"),
]
NUMBER_TESTS = [("Null", "{c} IS NULL"), ("NaN", "isnan({c})")]
NULL_TEST = [("Null", "{c} IS NULL")]
MARKED_TESTS = {
    "event_id": NULL_TEST,
    "user_id": NULL_TEST,
    "event_type": TEXT_TESTS,
    "value": NUMBER_TESTS,
    "props": TEXT_TESTS,
    "ts": NULL_TEST,
}


def marked_events(spark, folder):
    """Events with every kind of missing value written in."""
    event = F.col("event_id")
    return table(spark, folder, "events").select(
        "event_id",
        F.when(event % 6 != 0, F.col("user_id")).alias("user_id"),
        F.when(event % 5 == 0, "None").when(event % 5 == 1, "is NULL").when(event % 5 == 2, "")
        .when(event % 5 == 3, F.col("event_type")).alias("event_type"),
        F.when(event % 4 == 0, float("nan")).when(event % 4 > 1, F.col("value")).alias("value"),
        F.when(event % 9 == 0, "nan").otherwise(F.col("props")).alias("props"),
        "ts",
    )


@query(
    "missing_report",
    f"WITH {MARKED_EVENTS_SQL}, counted AS ("
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS "Column", '{kind}' AS "Type", count(*) FILTER ({test.format(c=name)}) AS "Count",
            round(count(*) FILTER ({test.format(c=name)}) * 100.0 / count(*), 6)::DOUBLE AS "Percentage" FROM marked"""
        for name, tests in MARKED_TESTS.items()
        for kind, test in tests
    )
    + """) SELECT * FROM counted WHERE "Count" > 0""",
)
def missing_report(spark, folder):
    return rounded(missing.show_summary_nulls(marked_events(spark, folder)), "Percentage")


_JOINED_TESTS = {
    "doc_id": NULL_TEST,
    "text": TEXT_TESTS,
    "lang": TEXT_TESTS,
    "source": TEXT_TESTS,
    "n_chars": NULL_TEST,
    "quality": NULL_TEST,
    "toxic": NULL_TEST,
}


@query(
    "missing_report_non_null",
    "WITH joined AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)), counted AS ("
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS "Column", '{kind}' AS "Type", count(*) FILTER ({test.format(c=name)}) AS "Count",
            round(count(*) FILTER ({test.format(c=name)}) * 100.0 / count({name}), 6)::DOUBLE AS "Percentage" FROM joined"""
        for name, tests in _JOINED_TESTS.items()
        for kind, test in tests
    )
    + """) SELECT * FROM counted WHERE "Count" > 0""",
)
def missing_report_non_null(spark, folder):
    """All columns of documents and their labels, in percent of the values that are there."""
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return rounded(missing.get_missing_values_count(joined, denominator="non_null"), "Percentage")


@query(
    "missing_any",
    f"WITH {MARKED_EVENTS_SQL} SELECT "
    + ", ".join(
        f"""count(*) FILTER ({' OR '.join(f"coalesce({test.format(c=name)}, false)" for _, test in tests)}) AS {name}"""
        for name, tests in MARKED_TESTS.items()
    )
    + " FROM marked",
)
def missing_any(spark, folder):
    return missing.missing_any(marked_events(spark, folder))


@query(
    "null_counts",
    f"WITH {MARKED_EVENTS_SQL} SELECT "
    + ", ".join(
        f"""count(*) FILTER ({name} IS NULL) AS "{name}_nulls",
            round(count(*) FILTER ({name} IS NULL) / count(*), 6)::DOUBLE AS "{name}_nulls%" """
        for name in MARKED_TESTS
    )
    + " FROM marked",
)
def null_counts(spark, folder):
    out = missing.get_null_counts(marked_events(spark, folder), with_percentages=True)
    return rounded(out, *[name for name in out.columns if name.endswith("%")])


GAPPY_SQL = """gappy AS (
    SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN l_tax END AS sparse_tax,
           CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS quantity,
           CASE WHEN l_partkey % 11 <> 0 THEN l_discount END AS discount,
           CASE WHEN l_suppkey % 13 <> 0 THEN l_returnflag END AS returnflag,
           CASE WHEN l_partkey % 17 <> 0 THEN l_linestatus END AS linestatus
    FROM lineitem),
  kept AS (SELECT * EXCLUDE (sparse_tax) FROM gappy WHERE 2 + (quantity IS NOT NULL)::INT + (discount IS NOT NULL)::INT
           + (returnflag IS NOT NULL)::INT + (linestatus IS NOT NULL)::INT >= 4),
  filled AS (SELECT l_orderkey, l_linenumber, coalesce(quantity, (SELECT median(quantity) FROM kept)) AS quantity,
                    coalesce(discount, (SELECT avg(discount) FROM kept)) AS discount,
                    coalesce(returnflag, 'U') AS returnflag, linestatus FROM kept)"""
CLEANING = {
    "row_threshold": 0.2,
    "column_threshold": 0.2,
    "default_values": {"quantity": "median", "discount": "avg", "returnflag": "U"},
}


def gappy_lineitem(spark, folder):
    """Line items with one sparse column and nulls in four others."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_orderkey") % 3 == 0, F.col("l_tax")).alias("sparse_tax"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_discount")).alias("discount"),
        F.when(F.col("l_suppkey") % 13 != 0, F.col("l_returnflag")).alias("returnflag"),
        F.when(F.col("l_partkey") % 17 != 0, F.col("l_linestatus")).alias("linestatus"),
    )


@query(
    "clean_nulls_rows",
    f"WITH {GAPPY_SQL} SELECT * REPLACE (round(discount, 6) AS discount) FROM filled WHERE linestatus IS NOT NULL",
)
def clean_nulls_rows(spark, folder):
    return rounded(missing.clean_nulls(gappy_lineitem(spark, folder), **CLEANING), "discount")


@query(
    "clean_nulls_cols",
    f"WITH {GAPPY_SQL} SELECT * EXCLUDE (linestatus) REPLACE (round(discount, 6) AS discount) FROM filled",
)
def clean_nulls_cols(spark, folder):
    options = CLEANING | {"unaccounted_nulls_behavior": "drop_cols"}
    return rounded(missing.clean_nulls(gappy_lineitem(spark, folder), **options), "discount")


@query(
    "drop_null_rows",
    f"""WITH {MARKED_EVENTS_SQL} SELECT * FROM marked WHERE user_id IS NOT NULL AND event_type IS NOT NULL
        AND value IS NOT NULL AND NOT isnan(value)""",
)
def drop_null_rows(spark, folder):
    return missing.drop_null_values(marked_events(spark, folder))
