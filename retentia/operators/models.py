"""Tree classifiers with grids, cross-validation and scoring."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorIndexer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.functions.columns import column
from retentia.functions.scratch import local_table, materialize
from retentia.functions.uniform import key_columns, keyed_uniform

# The model seed, the fold count and the parameter grids.
SEED = 42
FOLDS = 5
DEFAULT_BINS = 32
FOLD, VALIDATION = "__fold", "__validation"
DEPTH, DEFAULT_TREES = "maxDepth", 20
GRIDS = {
    "RandomForestClassifier": {
        "numTrees": [10, 20, 30],
        "maxDepth": [5, 10, 15],
        "maxBins": [32, 64, 128],
        "featureSubsetStrategy": ["auto", "sqrt", "log2"],
    },
    "GBTClassifier": {
        "maxDepth": [5, 10, 15],
        "maxBins": [32, 64, 128],
        "subsamplingRate": [0.8, 1.0],
    },
}
CLASSIFIERS = {"RandomForestClassifier": RandomForestClassifier, "GBTClassifier": GBTClassifier}


def build_classifier(model: str, label_col: str, features_col: str, weight_col: str | None = None, **params):
    """A random forest or gradient-boosted trees; the weight column counts for both."""
    if model not in CLASSIFIERS:
        raise ValueError(f"unknown model {model!r}; expected one of {', '.join(CLASSIFIERS)}")
    if weight_col:
        params["weightCol"] = weight_col
    return CLASSIFIERS[model](labelCol=label_col, featuresCol=features_col, seed=SEED, **params)


def parameter_grid(estimator, grid: dict[str, list] | None = None) -> list[dict]:
    """Every combination of the parameter values; by default the model's full grid."""
    builder = ParamGridBuilder()
    for name, values in (GRIDS[type(estimator).__name__] if grid is None else grid).items():
        builder = builder.addGrid(estimator.getParam(name), values)
    return builder.build()


def build_classification_model(
    label_col: str,
    features_col: str,
    weight_col: str | None,
    model: str,
    grid: dict[str, list] | None = None,
    folds: int = FOLDS,
    metric: str = "weightedRecall",
    parallelism: int = 4,
    fold_col: str = "",
    **params,
) -> CrossValidator:
    """Cross-validation over the grid; ``parallelism`` fits share the cluster at a time.

    ``fold_col`` names a column with each row's fold (0 to ``folds`` - 1); without it Spark draws the folds.
    """
    estimator = build_classifier(model, label_col, features_col, weight_col, **params)
    evaluator = MulticlassClassificationEvaluator(labelCol=label_col, predictionCol="prediction", metricName=metric)
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=parameter_grid(estimator, grid),
        evaluator=evaluator,
        numFolds=folds,
        parallelism=parallelism,
        seed=SEED,
        foldCol=fold_col,
    )


def category_counts(df: DataFrame, features_col: str) -> dict[str, int]:
    """Number of categories of the nominal slots of a feature vector, from its attributes."""
    attributes = df.schema[features_col].metadata.get("ml_attr", {}).get("attrs", {})
    return {
        slot.get("name", str(slot["idx"])): slot.get("num_vals") or len(slot.get("vals", []))
        for slot in attributes.get("nominal", [])
    }


def check_bins(df: DataFrame, features_col: str, model: str, options: dict) -> None:
    """Trees need at least as many bins as a feature has categories; every value to be tried must do."""
    counts = category_counts(df, features_col)
    if not counts or model not in GRIDS:
        return
    name, needed = max(counts.items(), key=lambda item: item[1])
    grid = GRIDS[model] if options.get("grid") is None else options["grid"]
    bins = grid.get("maxBins", [options.get("maxBins", DEFAULT_BINS)])
    if min(bins) < needed:
        raise ValueError(f"feature {name} has {needed} categories, more than maxBins {min(bins)}; see usable_grid")


def usable_grid(df: DataFrame, features_col: str, model: str, grid: dict[str, list] | None = None) -> tuple[dict[str, list], list[int]]:
    """A grid without the values of ``maxBins`` that are too small for the features, and those values."""
    grid = dict(GRIDS[model] if grid is None else grid)
    needed = max(category_counts(df, features_col).values(), default=0)
    bins = grid.get("maxBins", [])
    enough, left_out = [b for b in bins if b >= needed], [b for b in bins if b < needed]
    if left_out and not enough:
        raise ValueError(f"a feature has {needed} categories, more than maxBins {max(bins)}")
    return (grid | {"maxBins": enough} if bins else grid), left_out


def with_folds(df: DataFrame, folds: int = FOLDS, seed: int = SEED, key: str | Sequence[str] | None = None, out: str = FOLD) -> DataFrame:
    """Add each row's fold, 0 to ``folds`` - 1, drawn from seed and key; without a key, equal rows share a fold."""
    return df.withColumn(out, F.floor(keyed_uniform(seed, *key_columns(df, key)) * folds).cast("int"))


def train_classification_model(
    train: DataFrame,
    label_col: str,
    features_col: str,
    weight_col: str | None,
    model: str,
    key: str | Sequence[str] | None = None,
    **options,
):
    """The best model by cross-validation, refitted on all of ``train``.

    Every row's fold follows from its ``key``, or its content, so it does not depend on the order
    of the rows, and the training rows are written once for all fits. A value of
    ``maxBins`` too small for the categories in the features is an error before anything
    is fitted.
    """
    check_bins(train, features_col, model, options)
    needed = [label_col, features_col] + ([weight_col] if weight_col else [])
    folds = with_folds(train, options.get("folds", FOLDS), SEED, key)
    rows = materialize(folds.select(*[column(name) for name in [*needed, FOLD]]), "train")
    validator = build_classification_model(label_col, features_col, weight_col, model, fold_col=FOLD, **options)
    return validator.fit(rows).bestModel


@dataclass(frozen=True)
class GridSearch:
    """The scored grid, one row per point and fold, the best point, and the model fitted with it on all rows."""

    scores: DataFrame
    best: dict
    model: object


def search_grid(
    train: DataFrame,
    label_col: str,
    features_col: str,
    weight_col: str | None,
    model: str,
    key: str | Sequence[str] | None = None,
    grid: dict[str, list] | None = None,
    folds: int = FOLDS,
    metric: str = "weightedRecall",
    parallelism: int = 8,
    validation_share: float = 0.0,
    **params,
) -> GridSearch:
    """Cross-validation over a grid in which points that are part of one another share a fit.

    * The first trees of a forest, or of boosted trees, are a model of their own: of points that differ in their number of trees only, the
      largest is fitted and its prefixes are scored along with it, all in one pass over the fold.
    * Deep points come first. Where no tree of a fit reaches a smaller depth of the grid, limiting it would have changed nothing,
      and the points of that depth share the fit.
    * Subset strategies that let a node see equally many features are one: for several trees "auto" is "sqrt", and often "log2" is, too.

    So the 81 points of the forest's grid take 18 fits per fold at most, and 3 where trees stay shallow. A forest's prefix draws its
    trees' rows as part of the largest forest, so it need not equal a fit of its own; all other shared points do.

    The scores have a column for each parameter, ``fold``, ``rows`` (scored) and the metric under its name. The best point has the
    largest mean over the folds; of equals the first in the grid's order wins. ``validation_share`` of the training rows, drawn by
    seed and key, tell boosted trees when to stop; that changes the number of trees, so such grids do not hold ``maxIter``.
    """
    check_bins(train, features_col, model, {"grid": grid, **params})
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    grid = GRIDS[model] if grid is None else grid
    needed = [label_col, features_col] + ([weight_col] if weight_col else [])
    drawn = with_folds(train, folds, SEED, key)
    if validation_share:
        if model != "GBTClassifier" or STAGES[model] in grid:
            raise ValueError("only boosted trees without their number in the grid stop early")
        drawn = drawn.withColumn(VALIDATION, keyed_uniform(SEED + 1, *key_columns(train, key)) < validation_share)
        params["validationIndicatorCol"], needed = VALIDATION, [*needed, VALIDATION]
    rows = materialize(drawn.select(*[column(name) for name in [*needed, FOLD]]), "train")
    points = [dict(zip(grid, values)) for values in product(*grid.values())]
    stages, width = STAGES[model], _width(rows, features_col)
    shared: dict[tuple, list[int]] = {}
    for at, point in enumerate(points):
        shared.setdefault(_fit_key(model, point, width), []).append(at)

    def fit(some: DataFrame, point: dict):
        return build_classifier(model, label_col, features_col, weight_col, **params, **point).fit(some)

    def confusions(fitted, held: DataFrame, sizes: Sequence[int]) -> dict[int, dict]:
        """Rows by label and prediction, for each number of trees."""
        scored = held.select(column(label_col).cast("double").alias("label"), column(features_col))
        for size in sizes:
            part = _prefix(fitted, size).setPredictionCol(f"p{size}").setRawPredictionCol("__raw").setProbabilityCol("__probability")
            scored = part.transform(scored).drop("__raw", "__probability")
        pairs = F.array(*[F.struct(F.lit(size).alias("size"), F.col(f"p{size}").alias("prediction")) for size in sizes])
        found: dict[int, dict] = {size: {} for size in sizes}
        for row in scored.select("label", F.inline(pairs)).groupBy("size", "label", "prediction").agg(F.count(F.lit(1)).alias("count")).collect():
            found[row["size"]][row["label"], row["prediction"]] = row["count"]
        return found

    def score_fold(task: tuple[list[int], int]) -> list[tuple]:
        members, fold = task
        learned, held = rows.filter(F.col(FOLD) != fold), rows.filter(F.col(FOLD) == fold)
        found, fitted = [], None
        for depth in sorted({points[at].get(DEPTH) for at in members}, reverse=True):
            some = [at for at in members if points[at].get(DEPTH) == depth]
            if fitted is None or max(tree.depth() for tree in fitted._java_obj.trees()) >= depth:
                fitted = fit(learned, max((points[at] for at in some), key=lambda point: point.get(stages, 0)))
                counted = confusions(fitted, held, sorted({points[at].get(stages, 0) for at in some}))
            for at in some:
                counts = counted[points[at].get(stages, 0)]
                found.append((at, fold, sum(counts.values()), METRICS[metric](counts) if counts else None))
        return found

    with ThreadPool(min(parallelism, len(shared) * folds)) as pool:
        run = inheritable_thread_target(train.sparkSession)(score_fold)
        results = pool.map(run, [(members, fold) for members in shared.values() for fold in range(folds)], chunksize=1)
    scored = sorted(one for found in results for one in found)
    means = {at: [value for point, _, _, value in scored if point == at and value is not None] for at in range(len(points))}
    best = max(range(len(points)), key=lambda at: (sum(means[at]) / len(means[at]) if means[at] else -1.0, -at))
    kinds = {int: "int", float: "double", str: "string", bool: "boolean"}
    schema = ", ".join([*(f"{name} {kinds[type(values[0])]}" for name, values in grid.items()), "fold int", "rows bigint", f"{metric} double"])
    table = local_table(train.sparkSession, [(*points[at].values(), fold, n, value) for at, fold, n, value in scored], schema)
    return GridSearch(table, points[best], fit(rows, points[best]))


# The parameter that says how many trees a model has.
STAGES = {"RandomForestClassifier": "numTrees", "GBTClassifier": "maxIter"}


def _fit_key(model: str, point: dict, width: int) -> tuple:
    """What a fit depends on, but for the number and depth of its trees."""
    strategy = point.get("featureSubsetStrategy")
    if model == "RandomForestClassifier" and strategy is not None:
        point = point | {"featureSubsetStrategy": features_per_node(strategy, width, point.get("numTrees", DEFAULT_TREES))}
    return tuple(sorted((name, value) for name, value in point.items() if name not in (STAGES[model], DEPTH)))


def features_per_node(strategy: str, width: int, trees: int) -> int | str:
    """How many features a node of a classification forest chooses from; other strategies are returned as they are."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt"
    rules = {"all": lambda: width, "sqrt": lambda: math.ceil(math.sqrt(width)), "log2": lambda: max(1, math.ceil(math.log(width) / math.log(2))), "onethird": lambda: math.ceil(width / 3)}
    return rules[strategy]() if strategy in rules and width else strategy


def _width(df: DataFrame, features_col: str) -> int:
    """Size of the feature vectors, from their attributes or a row; 0 of none."""
    size = df.schema[features_col].metadata.get("ml_attr", {}).get("num_attrs")
    if size is None:
        first = df.filter(column(features_col).isNotNull()).select(column(features_col)).first()
        size = first[0].size if first else 0
    return size


def _prefix(fitted, size: int):
    """A model of the first ``size`` trees of a fitted one; 0 stands for all."""
    java = fitted._java_obj
    trees = java.trees()
    if not size or size >= len(trees):
        return fitted.copy()
    context = SparkContext._active_spark_context
    jvm, sizes = context._jvm, (java.numFeatures(), java.numClasses())

    def array(kind, values):
        made = context._gateway.new_array(kind, size)
        for at in range(size):
            made[at] = values[at]
        return made

    if isinstance(fitted, RandomForestClassificationModel):
        some = array(jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, trees)
        made, kind = jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(java.uid(), some, *sizes), RandomForestClassificationModel
    else:
        some, weights = array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, trees), array(jvm.double, java.treeWeights())
        made, kind = jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), some, weights, *sizes), GBTClassificationModel
    copied = java.copyValues(made, java.extractParamMap())
    return kind(copied.set(copied.getParam(STAGES[kind.__name__.replace("ClassificationModel", "Classifier")]), size))


def _recalls(confusion: dict) -> dict[float, tuple[float, float, float]]:
    """Share of all rows, recall and precision of each label."""
    total, actual, predicted = sum(confusion.values()), Counter(), Counter()
    for (label, prediction), n in confusion.items():
        actual[label] += n
        predicted[prediction] += n
    hits = {label: confusion.get((label, label), 0) for label in actual}
    return {label: (actual[label] / total, hits[label] / actual[label], hits[label] / predicted[label] if predicted[label] else 0.0) for label in actual}


# By the names of Spark's evaluator, from counts of (label, prediction).
METRICS = {
    "accuracy": lambda counts: sum(n for (label, prediction), n in counts.items() if label == prediction) / sum(counts.values()),
    "weightedRecall": lambda counts: sum(share * recall for share, recall, _ in _recalls(counts).values()),
    "weightedPrecision": lambda counts: sum(share * precision for share, _, precision in _recalls(counts).values()),
    "f1": lambda counts: sum(share * (2 * r * p / (r + p) if r + p else 0.0) for share, r, p in _recalls(counts).values()),
}


def best_point(scores: DataFrame, metric: str = "weightedRecall") -> DataFrame:
    """``(parameter, value, mean_score)`` of the best point of a scored grid: the largest mean, ties to the first in the grid's order."""
    names = [name for name in scores.columns if name not in ("fold", "rows", metric)]
    order = F.min("__at")
    numbered = scores.withColumn("__at", F.monotonically_increasing_id())
    means = numbered.groupBy(*names).agg(F.avg(metric).alias("mean_score"), order.alias("__at"))
    first = means.orderBy(F.col("mean_score").desc_nulls_last(), "__at").limit(1)
    pairs = [F.struct(F.lit(name).alias("parameter"), column(name).cast("string").alias("value")) for name in names]
    return first.select(F.inline(F.array(*pairs)), "mean_score")


def decision_tree(label_col: str, features_col: str, max_categories: int = 4) -> Pipeline:
    """Label index, vector index and a decision tree in one estimator."""
    label = StringIndexer(inputCol=label_col, outputCol="indexedLabel")
    features = VectorIndexer(inputCol=features_col, outputCol="indexedFeatures", maxCategories=max_categories)
    tree = DecisionTreeClassifier(labelCol="indexedLabel", featuresCol="indexedFeatures")
    return Pipeline(stages=[label, features, tree])


def score(model, df: DataFrame, label_col: str, keep: list[str] | None = None) -> DataFrame:
    """Label and prediction of every row, with the columns in ``keep``."""
    return model.transform(df).select(*[column(name) for name in [*(keep or []), label_col, "prediction"]])


def best_parameters(model, names: list[str], spark: SparkSession) -> DataFrame:
    """The values a fitted model ended up with, as ``(parameter, value)``."""
    rows = [(name, str(model.getOrDefault(name))) for name in names]
    return local_table(spark, rows, "parameter string, value string").orderBy(F.col("parameter"))
