from pyspark.sql import functions as F

from retentia.catalog import query, table
from retentia.functions.ordering import exact_quantiles
from retentia.functions.scratch import local_table
from retentia.operators import correlate, profile
from retentia.plans.features import show_correlation_matrix

LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUANTILES = [("l_extendedprice", 0.1), ("l_extendedprice", 0.99), ("l_partkey", 0.5), ("l_tax", 0.5)]
CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df, *names, places=6):
    return df.withColumns({name: F.round(name, places) for name in names})


@query(
    "class_distribution",
    """SELECT quality, count(*) AS "count", round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share
       FROM labels GROUP BY quality""",
)
def class_distribution(spark, folder):
    return rounded(profile.show_summary_labels(table(spark, folder, "labels"), "quality"), "share")


@query(
    "value_counts",
    """SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS "count" FROM orders GROUP BY 2
       UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""",
)
def value_counts(spark, folder):
    return profile.show_summary_categoricals(table(spark, folder, "orders"))


def _summary_sql(names, source):
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", count({n}) AS "count", round(avg({n}), 6) AS mean,
            round(stddev_samp({n}), 6) AS stddev, min({n})::DOUBLE AS min,
            quantile_disc({n}, 0.25)::DOUBLE AS p25, quantile_disc({n}, 0.5)::DOUBLE AS p50,
            quantile_disc({n}, 0.75)::DOUBLE AS p75, max({n})::DOUBLE AS max FROM {source}"""
        for n in names
    )


@query("numeric_summary", _summary_sql(LINEITEM_NUMBERS, "lineitem"))
def numeric_summary(spark, folder):
    return rounded(profile.show_summary_numerical(table(spark, folder, "lineitem"), quantiles="exact"), "mean", "stddev")


_QUARTILES = (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))


@query(
    "numeric_summary_approx",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", count({n}) AS "count", round(avg({n}), 6) AS mean, round(stddev_samp({n}), 6) AS stddev,
            min({n})::DOUBLE AS min, max({n})::DOUBLE AS max, true AS within_error FROM lineitem"""
        for n in LINEITEM_NUMBERS
    ),
)
def numeric_summary_approx(spark, folder):
    """Approximate quartiles, with the check that their ranks are within a hundredth of the rows."""
    lineitem = table(spark, folder, "lineitem")
    summary = profile.show_summary_numerical(lineitem, quantiles="approx")
    found = {row["column"]: row for row in summary.collect()}
    ranks = lineitem.agg(
        *[
            measure.alias(f"{name}_{label}_{side}")
            for name in LINEITEM_NUMBERS
            for label, _ in _QUARTILES
            for side, measure in (
                ("below", F.count_if(F.col(name) < F.lit(found[name][label]))),
                ("upto", F.count_if(F.col(name) <= F.lit(found[name][label]))),
            )
        ]
    ).first()
    total = lineitem.count()
    right = [
        all(ranks[f"{n}_{p}_below"] / total - 0.01 <= share <= ranks[f"{n}_{p}_upto"] / total + 0.01 for p, share in _QUARTILES)
        for n in LINEITEM_NUMBERS
    ]
    checks = local_table(spark, list(zip(LINEITEM_NUMBERS, right)), "column string, within_error boolean")
    kept = rounded(summary, "mean", "stddev").drop("p25", "p50", "p75")
    return kept.join(F.broadcast(checks), "column")


@query(
    "exact_quantiles",
    " UNION ALL ".join(
        f"SELECT '{name}' AS col_name, {share}::DOUBLE AS share, quantile_disc({name}, {share})::DOUBLE AS value FROM lineitem"
        for name, share in QUANTILES
    ),
)
def quantiles(spark, folder):
    shares: dict[str, list[float]] = {}
    for name, share in QUANTILES:
        shares.setdefault(name, []).append(share)
    values, _ = exact_quantiles(table(spark, folder, "lineitem"), shares)
    rows = [(name, share, float(values[name, share][0])) for name, share in QUANTILES]
    return local_table(spark, rows, "col_name string, share double, value double")


@query(
    "column_profile",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", '{group}' AS column_group, count(*) AS rows, count({name}) AS non_null,
            count(DISTINCT {name}) AS distinct_values FROM events"""
        for name, group in [
            ("event_id", "numeric_cols"),
            ("ts", "unknown_cols"),
            ("user_id", "numeric_cols"),
            ("event_type", "categorical_cols"),
            ("value", "numeric_cols"),
            ("props", "categorical_cols"),
        ]
    ),
)
def column_profile(spark, folder):
    return profile.column_profile(table(spark, folder, "events"))


@query("first_rows", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def first_rows(spark, folder):
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return profile.show_summary_general(table(spark, folder, "orders"), 20, order_by=order)[1]


_EVENTS = [
    ("event_id", "bigint", "numeric_cols"),
    ("ts", "timestamp_ntz", "unknown_cols"),
    ("user_id", "bigint", "numeric_cols"),
    ("event_type", "string", "categorical_cols"),
    ("value", "double", "numeric_cols"),
    ("props", "string", "categorical_cols"),
]


@query(
    "schema_table",
    " UNION ALL ".join(
        f"""SELECT {at}::INT AS position, '{name}' AS "column", '{kind}' AS "type", true AS nullable, '{group}' AS column_group,
            count({name}) AS non_null FROM events"""
        for at, (name, kind, group) in enumerate(_EVENTS)
    ),
)
def schema_table(spark, folder):
    """The schema, beside how many values each column holds."""
    events = table(spark, folder, "events")
    return profile.schema_table(events).join(profile.column_profile(events).select("column", "non_null"), "column")


@query(
    "distinct_counts",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", count(DISTINCT {name}) AS distinct_values FROM customer"""
        for name in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    ),
)
def distinct_counts(spark, folder):
    return profile.distinct_counts(table(spark, folder, "customer"))


_LINEITEM = [*LINEITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]


@query(
    "distinct_counts_approx",
    " UNION ALL ".join(f"""SELECT '{n}' AS "column", count(DISTINCT {n}) AS exact_values, true AS within_error FROM lineitem""" for n in _LINEITEM),
)
def distinct_counts_approx(spark, folder):
    """Approximate counts beside exact ones, and whether they are within four of the sketch's deviations."""
    lineitem = table(spark, folder, "lineitem")
    near = profile.distinct_counts(lineitem, approximate=True)
    exact = profile.distinct_counts(lineitem).withColumnRenamed("distinct_values", "exact_values")
    error = F.abs(F.col("distinct_values") - F.col("exact_values"))
    return exact.join(near, "column").select("column", "exact_values", (error <= 0.2 * F.col("exact_values") + 1).alias("within_error"))


@query(
    "aggregates_by_name",
    """SELECT round(sum(l_quantity), 2) AS sum_l_quantity, count(l_orderkey) AS count_l_orderkey,
       round(avg(l_extendedprice), 6) AS avg_l_extendedprice, min(l_tax) AS min_l_tax,
       max(l_discount) AS max_l_discount, round(median(l_partkey), 6) AS median_l_partkey FROM lineitem""",
)
def aggregates_by_name(spark, folder):
    wanted = {
        "l_quantity": "sum",
        "l_orderkey": "count",
        "l_extendedprice": "avg",
        "l_tax": "min",
        "l_discount": "max",
        "l_partkey": "median",
    }
    out = profile.aggregate_by_name(table(spark, folder, "lineitem"), wanted)
    return rounded(rounded(out, "avg_l_extendedprice", "median_l_partkey"), "sum_l_quantity", places=2)


@query("dedupe", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def dedupe(spark, folder):
    return profile.drop_duplicate_rows(table(spark, folder, "orders").select("o_orderstatus", "o_orderpriority"))


def _correlation_sql(names, relation):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS row_name, '{b}' AS col_name, round(corr({a}, {b}), 6) AS correlation FROM {relation}"
        for a in names
        for b in names
    )


@query("correlation_pearson", _correlation_sql(CORRELATED, "lineitem"))
def correlation_pearson(spark, folder):
    return rounded(correlate.correlation_matrix(table(spark, folder, "lineitem"), CORRELATED), "correlation")


_RANKS = ", ".join(
    f"rank() OVER (ORDER BY {name}) + (count(*) OVER (PARTITION BY {name}) - 1) / 2 AS {name}" for name in CORRELATED
)


@query(
    "correlation_spearman",
    f"WITH r AS (SELECT {_RANKS} FROM lineitem) " + _correlation_sql(CORRELATED, "r"),
)
def correlation_spearman(spark, folder):
    return rounded(correlate.correlation_matrix(table(spark, folder, "lineitem"), CORRELATED, "spearman"), "correlation")


@query(
    "feature_correlation",
    """WITH idx AS (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS ix
                    FROM customer GROUP BY c_mktsegment),
       f AS (SELECT ix::DOUBLE AS "c_mktsegmentIndex", c_nationkey::DOUBLE AS c_nationkey, c_acctbal
             FROM customer JOIN idx ON c_mktsegment = s) """
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS row_name, '{b}' AS col_name, round(corr("{a}", "{b}"), 6) AS correlation FROM f"""
        for a in ["c_mktsegmentIndex", "c_nationkey", "c_acctbal"]
        for b in ["c_mktsegmentIndex", "c_nationkey", "c_acctbal"]
    ),
)
def feature_correlation(spark, folder):
    customer = table(spark, folder, "customer").select("c_mktsegment", "c_nationkey", "c_acctbal")
    return rounded(show_correlation_matrix(customer, "c_nationkey", "pearson"), "correlation")


_FEATURES = ["c_mktsegmentIndex", "c_nationkey", "c_acctbal"]
_FEATURE_RANKS = ", ".join(
    f"""rank() OVER (ORDER BY "{name}") + (count(*) OVER (PARTITION BY "{name}") - 1) / 2 AS "{name}" """ for name in _FEATURES
)


@query(
    "feature_correlation_spearman",
    f"""WITH idx AS (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS ix
                     FROM customer GROUP BY c_mktsegment),
        f AS (SELECT ix::DOUBLE AS "c_mktsegmentIndex", c_nationkey::DOUBLE AS c_nationkey, c_acctbal
              FROM customer JOIN idx ON c_mktsegment = s),
        r AS (SELECT {_FEATURE_RANKS} FROM f) """
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS row_name, '{b}' AS col_name, round(corr("{a}", "{b}"), 6) AS correlation FROM r"""
        for a in _FEATURES
        for b in _FEATURES
    ),
)
def feature_correlation_spearman(spark, folder):
    customer = table(spark, folder, "customer").select("c_mktsegment", "c_nationkey", "c_acctbal")
    return rounded(show_correlation_matrix(customer, "c_nationkey", "spearman"), "correlation")
