"""Classification quality from one count of label and prediction pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import column, slot_names
from retentia.functions.scratch import local_table


def cast_predictions(df: DataFrame, label_col: str, prediction_col: str) -> DataFrame:
    """Label and prediction as floats."""
    return df.select(*[column(name).cast("float").alias(name) for name in (prediction_col, label_col)])


def confusion_matrix(df: DataFrame, label_col: str, prediction_col: str) -> DataFrame:
    """``(label, prediction, count)`` for every pair that occurs, null included."""
    pairs = df.select(column(label_col).alias("label"), column(prediction_col).alias("prediction"))
    return pairs.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count"))


def class_metrics(confusion: DataFrame) -> DataFrame:
    """Support, precision, recall and f1 of every class, from a confusion matrix.

    Pairs with a null on either side are left out; ``performance_evaluation`` counts them.
    """
    return _class_sums(confusion).filter(F.col("class").isNotNull()).drop("unscored")


def _class_sums(confusion: DataFrame) -> DataFrame:
    """``class_metrics``, and a row with class null that counts the unscored pairs."""
    known = F.col("label").isNotNull() & F.col("prediction").isNotNull()
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)
    none = F.lit(0).cast("long")

    def counted(name: str, support: Column, hits: Column, predicted: Column) -> Column:
        return F.struct(
            F.col(name).cast("double").alias("class"),
            support.alias("support"),
            hits.alias("hits"),
            predicted.alias("predicted"),
            none.alias("unscored"),
        )

    as_label = counted("label", F.col("count"), hit, none)
    as_prediction = counted("prediction", none, none, F.col("count"))
    no_class = F.lit(None).cast("double").alias("class")
    left_out = F.struct(no_class, *[none.alias(name) for name in ("support", "hits", "predicted")], F.col("count").alias("unscored"))
    sums = (
        confusion.select(F.inline(F.when(known, F.array(as_label, as_prediction)).otherwise(F.array(left_out))))
        .groupBy("class")
        .agg(*[F.sum(name).alias(name) for name in ("support", "hits", "predicted", "unscored")])
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("predicted")), zero)
    recall = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("support")), zero)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    return sums.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1)


def performance_evaluation(df: DataFrame, label_col: str, prediction_col: str = "prediction") -> DataFrame:
    """One row: accuracy, weighted precision, recall and f1, and the test error; one pass.

    They are of the rows with a label and a prediction; ``rows`` counts all rows and ``unscored`` the others.
    """
    classes = _class_sums(confusion_matrix(df, label_col, prediction_col))
    total = F.sum("support")

    def weighted(name: str) -> Column:
        return F.try_divide(F.sum(F.col("support") * F.col(name)), total)

    accuracy = F.try_divide(F.sum("hits").cast("double"), total)
    return classes.agg(
        accuracy.alias("accuracy"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("f1"),
        (1 - accuracy).alias("test_error"),
        F.coalesce(total + F.sum("unscored"), F.lit(0).cast("long")).alias("rows"),
        F.coalesce(F.sum("unscored"), F.lit(0).cast("long")).alias("unscored"),
    )


def feature_importances(model, df: DataFrame, features_col: str, groups: dict[str, int] | None = None) -> DataFrame:
    """``(feature, importance)`` of a fitted tree model, largest first.

    Slot names come from the vector's attributes. ``groups`` (feature name to number
    of slots, in vector order) sums the slots of one-hot encoded features.
    """
    values = model.featureImportances.toArray().tolist()
    if groups is None:
        names = slot_names(df, features_col) or [f"{features_col}_{at}" for at in range(len(values))]
    else:
        names = [name for name, width in groups.items() for _ in range(int(width))]
    if len(names) != len(values):
        raise ValueError(f"{len(names)} slot names for {len(values)} importances")
    slots = local_table(df.sparkSession, list(zip(names, values)), "feature string, importance double")
    return slots.groupBy("feature").agg(F.sum("importance").alias("importance")).orderBy(F.desc("importance"), "feature")


def importance_groups(df: DataFrame, features_col: str, feature_cols: list[str]) -> dict[str, int]:
    """Slots per assembled input column, by matching slot names to column names."""
    groups = dict.fromkeys(feature_cols, 0)
    for slot in slot_names(df, features_col):
        prefixes = [name for name in feature_cols if slot.startswith(f"{name}_")]
        owner = slot if slot in groups else max(prefixes, key=len, default=None)
        if owner is None:
            raise ValueError(f"slot {slot} belongs to none of the features")
        groups[owner] += 1
    return groups


def select_importances(importances: DataFrame, names: list[str]) -> DataFrame:
    """The importances of the named features, largest first."""
    return importances.filter(F.col("feature").isin(names)).orderBy(F.desc("importance"), "feature")


def importance_total(importances: DataFrame) -> DataFrame:
    return importances.agg(F.sum("importance").alias("total_importance"))
