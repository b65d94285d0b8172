from pyspark.sql import functions as F

from retentia.catalog import query, table
from retentia.catalog.profiling import rounded
from retentia.operators import evaluate


@query(
    "confusion",
    """SELECT quality AS label, toxic AS prediction, count(*) AS "count" FROM labels GROUP BY quality, toxic""",
)
def confusion(spark, folder):
    return evaluate.confusion_matrix(table(spark, folder, "labels"), "quality", "toxic")


_CLASSES_SQL = """l AS (SELECT l_linenumber AS y, l_suppkey % 7 + 1 AS p FROM lineitem),
  s AS (SELECT y AS c, count(*) AS support, count(*) FILTER (y = p) AS hits FROM l GROUP BY y),
  q AS (SELECT p AS c, count(*) AS predicted FROM l GROUP BY p),
  m AS (SELECT c::DOUBLE AS "class", support, hits, coalesce(predicted, 0) AS predicted,
               CASE WHEN coalesce(predicted, 0) = 0 THEN 0 ELSE hits / predicted END AS "precision", hits / support AS recall
        FROM s LEFT JOIN q USING (c)),
  f AS (SELECT *, CASE WHEN "precision" + recall = 0 THEN 0 ELSE 2 * "precision" * recall / ("precision" + recall) END AS f1 FROM m)"""


def _scored(spark, folder):
    return table(spark, folder, "lineitem").selectExpr("l_linenumber AS y", "l_suppkey % 7 + 1 AS p")


@query(
    "class_metrics",
    f"""WITH {_CLASSES_SQL} SELECT "class", support, hits, predicted, round("precision", 6) AS "precision",
        round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f""",
)
def class_metrics(spark, folder):
    classes = evaluate.class_metrics(evaluate.confusion_matrix(_scored(spark, folder), "y", "p"))
    return rounded(classes, "precision", "recall", "f1")


@query(
    "weighted_metrics",
    f"""WITH {_CLASSES_SQL} SELECT round(sum(hits) / sum(support), 6) AS accuracy,
        round(sum("precision" * support) / sum(support), 6) AS weighted_precision,
        round(sum(recall * support) / sum(support), 6) AS weighted_recall,
        round(sum(f1 * support) / sum(support), 6) AS f1, round(1 - sum(hits) / sum(support), 6) AS test_error,
        (SELECT count(*) FROM lineitem) AS rows, (SELECT count(*) FROM lineitem WHERE l_orderkey % 10 = 0) AS unscored FROM f""".replace(
        "FROM lineitem)", "FROM lineitem WHERE l_orderkey % 10 <> 0)", 1
    ),
)
def weighted_metrics(spark, folder):
    """A tenth of the rows has no label or no prediction."""
    missing = F.col("l_orderkey") % 10 == 0
    scored = table(spark, folder, "lineitem").select(
        F.when(~(missing & (F.col("l_linenumber") < 4)), F.col("l_linenumber")).alias("y"),
        F.when(~(missing & (F.col("l_linenumber") >= 4)), F.col("l_suppkey") % 7 + 1).alias("p"),
    )
    metrics = evaluate.performance_evaluation(scored, "y", "p")
    return rounded(metrics, *metrics.columns[:5])


@query(
    "cast_predictions",
    "SELECT toxic::FLOAT AS toxic, quality::FLOAT AS quality FROM labels",
)
def cast_predictions(spark, folder):
    return evaluate.cast_predictions(table(spark, folder, "labels"), "quality", "toxic")
