from pyspark.sql import functions as F

from retentia.catalog import query, table
from retentia.catalog.encoding import labelled_documents
from retentia.catalog.sampling import draw_sql
from retentia.functions.scratch import scratch_path
from retentia.operators import evaluate, models
from retentia.operators.split import random_split
from retentia.plans.features import get_indexed_and_encode_vectors
from retentia.plans.preprocess import preprocess_data
from retentia.sources.tables import load_model, save_model

SEED = 7
# One feature decides the label, so a tree that may use it at once is right on every row.
SMALL_FOREST = {"numTrees": [5, 10], "maxDepth": [3], "featureSubsetStrategy": ["all"]}
# Boosting in a grid stops by these rows' error.
VALIDATION_SHARE = 0.2
_DECIDED = "SELECT doc_id, (lang = 'en')::INT AS english FROM documents JOIN labels USING (doc_id)"
_TEST = f"SELECT * FROM ({_DECIDED}) WHERE {draw_sql('doc_id')} >= "
_PERFECT = """SELECT 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS weighted_precision, 1.0::DOUBLE AS weighted_recall, 1.0::DOUBLE AS f1,
    0.0::DOUBLE AS test_error, count(*) AS rows, 0::BIGINT AS unscored"""


def _decided(spark, folder):
    english = (F.col("lang") == "en").cast("int").alias("english")
    return labelled_documents(spark, folder).select("doc_id", "lang", "source", "n_chars", english)


def _vectors(spark, folder):
    return get_indexed_and_encode_vectors(_decided(spark, folder), ["lang", "source", "n_chars"], "english")


def _parts(vectors):
    columns = ["doc_id", vectors.indexed_col, vectors.encoded_col, vectors.label_col, vectors.weight_col]
    return random_split(vectors.df.select(*columns), 0.8, SEED, "doc_id")


def _forest(vectors, train):
    return models.train_classification_model(
        train, vectors.label_col, vectors.encoded_col, vectors.weight_col, "RandomForestClassifier", key="doc_id", grid=SMALL_FOREST
    )


@query("rf_scores", f"SELECT doc_id, english, english::DOUBLE AS prediction FROM ({_TEST} 0.8)")
def rf_scores(spark, folder):
    """Cross-validated random forest, saved, loaded and applied to the test part."""
    vectors = _vectors(spark, folder)
    train, test = _parts(vectors)
    path = scratch_path(spark, "model")
    save_model(_forest(vectors, train), path)
    return models.score(load_model(path, spark), test, vectors.label_col, ["doc_id"])


def _searched(spark, folder, model="RandomForestClassifier", **options):
    """The model's full grid, searched on the training part, and the test part."""
    vectors = _vectors(spark, folder)
    train, test = _parts(vectors)
    found = models.search_grid(train, vectors.label_col, vectors.encoded_col, vectors.weight_col, model, key="doc_id", **options)
    return found, test, vectors.label_col


@query("rf_metrics", f"{_PERFECT} FROM ({_TEST} 0.8)")
def rf_metrics(spark, folder):
    """The best of the 81 points of the forest's grid, on the test part."""
    found, test, label = _searched(spark, folder)
    return evaluate.performance_evaluation(models.score(found.model, test, label), label)


_FOLD = f"floor({draw_sql('doc_id').replace(chr(39) + str(SEED) + chr(39), chr(39) + str(models.SEED) + chr(39))} * 5)::INT"
_FOLDS = f"folds AS (SELECT {_FOLD} AS fold, count(*) AS rows FROM ({_DECIDED}) WHERE {draw_sql('doc_id')} < 0.8 GROUP BY 1)"
_POINTS = """points AS (SELECT unnest([10, 20, 30]) AS "numTrees", d AS "maxDepth", b AS "maxBins", s AS "featureSubsetStrategy"
    FROM (SELECT unnest([5, 10, 15]) AS d), (SELECT unnest([32, 64, 128]) AS b), (SELECT unnest(['auto', 'sqrt', 'log2']) AS s))"""


@query("grid_scores", f"WITH {_FOLDS}, {_POINTS} SELECT points.*, fold, rows, 1.0::DOUBLE AS weighted_recall FROM points, folds")
def grid_scores(spark, folder):
    """Every point of the forest's grid on every fold."""
    return _searched(spark, folder)[0].scores.withColumnRenamed("weightedRecall", "weighted_recall")


@query(
    "best_parameters",
    f"""WITH {_FOLDS}, {_POINTS}, scores AS (SELECT points.*, 1.0::DOUBLE AS score FROM points, folds),
          best AS (SELECT "numTrees", "maxDepth", "maxBins", "featureSubsetStrategy", avg(score) AS mean_score FROM scores
            GROUP BY ALL ORDER BY mean_score DESC, "numTrees", "maxDepth", "maxBins", "featureSubsetStrategy" LIMIT 1)
        SELECT unnest(['numTrees', 'maxDepth', 'maxBins', 'featureSubsetStrategy']) AS parameter,
          unnest(["numTrees"::VARCHAR, "maxDepth"::VARCHAR, "maxBins"::VARCHAR, "featureSubsetStrategy"]) AS value, mean_score FROM best""",
)
def best_parameters(spark, folder):
    """The winner of the scored grid."""
    return models.best_point(_searched(spark, folder)[0].scores)


@query("cv_folds", f"SELECT doc_id, {_FOLD} AS fold FROM labels")
def cv_folds(spark, folder):
    """The fold of each row in cross-validation."""
    return models.with_folds(table(spark, folder, "labels").select("doc_id"), key="doc_id", out="fold")


@query("flow_metrics", f"{_PERFECT} FROM ({_DECIDED}) WHERE {draw_sql('english', 'doc_id')} >= 0.8")
def flow_metrics(spark, folder):
    """Clean, de-duplicate, index, scale, split, rebalance, train, score, evaluate."""
    train, test = preprocess_data(
        _decided(spark, folder),
        "english",
        {"row_threshold": 0.4, "column_threshold": 0.2, "default_values": {"n_chars": "median"}},
        transformation_categorical="index",
        transformation_numerical="normalize",
        stratified_split=True,
        rebalancing_technique="oversample_random",
        seed=SEED,
        key="doc_id",
    )
    model = models.train_classification_model(
        train, "english", "features", None, "RandomForestClassifier", grid={"featureSubsetStrategy": ["all"]}, numTrees=10
    )
    return evaluate.performance_evaluation(models.score(model, test, "english"), "english")


@query("gbt_scores", f"SELECT doc_id, english, english::DOUBLE AS prediction FROM ({_TEST} 0.8)")
def gbt_scores(spark, folder):
    """The best of the 18 points of boosting's grid; every fit stops once its validation rows gain no more."""
    found, test, label = _searched(spark, folder, "GBTClassifier", validation_share=VALIDATION_SHARE)
    return models.score(found.model, test, label, ["doc_id"])


_RANKED = f"c AS (SELECT english, row_number() OVER (ORDER BY count(*) DESC, english) - 1 AS place FROM t GROUP BY english)"


@query(
    "tree_scores",
    f"""WITH d AS ({_DECIDED}), t AS (SELECT * FROM d WHERE {draw_sql('doc_id')} < 0.7), {_RANKED}
        SELECT doc_id, place::DOUBLE AS "indexedLabel", place::DOUBLE AS prediction FROM d JOIN c USING (english) WHERE {draw_sql('doc_id')} >= 0.7""",
)
def tree_scores(spark, folder):
    """Label index, vector index and decision tree as one estimator, 70/30."""
    vectors = _vectors(spark, folder)
    train, test = random_split(vectors.df.select("doc_id", "IndexedFeatures", vectors.label_col), 0.7, SEED, "doc_id")
    fitted = models.decision_tree(vectors.label_col, "IndexedFeatures").fit(train)
    return fitted.transform(test).select("doc_id", "indexedLabel", "prediction")


@query(
    "importances",
    f"""SELECT feature, importance::DOUBLE AS importance, importance::DOUBLE AS share_of_total
        FROM (VALUES ('langIndexEncoded', 1), ('sourceIndexEncoded', 0), ('n_chars', 0)) t(feature, importance)
        WHERE (SELECT count(*) FROM ({_DECIDED})) > 0""",
)
def importances(spark, folder):
    vectors = _vectors(spark, folder)
    train, _ = _parts(vectors)
    inputs = ["langIndexEncoded", "sourceIndexEncoded", "n_chars"]
    groups = evaluate.importance_groups(vectors.df, vectors.encoded_col, inputs)
    table = evaluate.feature_importances(_forest(vectors, train), vectors.df, vectors.encoded_col, groups)
    named = evaluate.select_importances(table, inputs)
    return named.select(
        "feature",
        F.round("importance", 6).alias("importance"),
        F.round(F.col("importance") / evaluate.importance_total(table).first()[0], 6).alias("share_of_total"),
    )
