from pyspark.sql import functions as F

from retentia.catalog import query, table
from retentia.functions.scratch import materialize
from retentia.operators.nearmiss import Sizes, choice_recall, undersample_nearmiss_v2

K = 3
PROBES = 2
NEARMISS_SQL = f"""WITH smallest AS (SELECT label FROM embeddings GROUP BY label ORDER BY count(*), label LIMIT 1),
  e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, label = (SELECT label FROM smallest) AS rare FROM embeddings),
  pairs AS (SELECT a.vec_id, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON NOT a.rare AND b.rare),
  ranked AS (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC) AS r FROM pairs),
  scored AS (SELECT vec_id, avg(d) AS score FROM ranked WHERE r <= {K} GROUP BY vec_id),
  chosen AS (SELECT vec_id FROM scored ORDER BY score, vec_id LIMIT (SELECT count(*) FROM e WHERE rare))
  SELECT vec_id, label FROM e WHERE rare OR vec_id IN (SELECT vec_id FROM chosen)"""


def _embeddings(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query("nearmiss2", NEARMISS_SQL)
def nearmiss2(spark, folder):
    return undersample_nearmiss_v2(_embeddings(spark, folder), "v", "label", K, key="vec_id").drop("v")


@query("nearmiss2_tiled", NEARMISS_SQL)
def nearmiss2_tiled(spark, folder):
    """The form for a minority too large to broadcast, with the limits set low."""
    sizes = Sizes(broadcast_bytes=0, pivots=16, tile_rows=256, one_task_rows=16)
    return undersample_nearmiss_v2(_embeddings(spark, folder), "v", "label", K, key="vec_id", sizes=sizes).drop("v")


_HALVES_SQL = NEARMISS_SQL.replace("SELECT label FROM embeddings", "SELECT (label < 4)::INT AS label FROM embeddings").replace(
    "GROUP BY label ORDER BY count(*), label", "GROUP BY (label < 4)::INT ORDER BY count(*), (label < 4)::INT"
).replace("AS (SELECT vec_id, label, embedding", "AS (SELECT vec_id, (label < 4)::INT AS label, embedding").replace("label = (SELECT", "(label < 4)::INT = (SELECT")


@query("nearmiss2_wide", _HALVES_SQL)
def nearmiss2_wide(spark, folder):
    """A minority of about four tenths in 64 dimensions, tile by tile, with bounds from pivots."""
    sizes = Sizes(broadcast_bytes=0, pivots=16, tile_rows=64, one_task_rows=16)
    halves = _embeddings(spark, folder).withColumn("label", (F.col("label") < 4).cast("int"))
    return undersample_nearmiss_v2(halves, "v", "label", K, key="vec_id", sizes=sizes).drop("v")


_REPEATED_SQL = (
    NEARMISS_SQL.replace("embedding::DOUBLE[] AS v,", "embedding::DOUBLE[] AS v, CASE WHEN vec_id % 3 <> 0 THEN vec_id // 4 END AS k,")
    .replace("AS (SELECT a.vec_id, list", "AS (SELECT a.vec_id, a.k, list")
    .replace("AS (SELECT vec_id, d,", "AS (SELECT vec_id, k, d,")
    .replace("AS (SELECT vec_id, avg(d) AS score FROM ranked WHERE r <= 3 GROUP BY vec_id)", "AS (SELECT vec_id, any_value(k) AS k, avg(d) AS score FROM ranked WHERE r <= 3 GROUP BY vec_id)")
    .replace("ORDER BY score, vec_id", "ORDER BY score, k NULLS FIRST")
    .replace("SELECT vec_id, label FROM e WHERE", "SELECT vec_id, label, form FROM e, (VALUES ('one pass'), ('tiled')) f(form) WHERE")
)


@query("nearmiss2_repeated_keys", _REPEATED_SQL)
def nearmiss2_repeated_keys(spark, folder):
    """A key with repeats and nulls: both forms give the same, complete answer."""
    rows = _embeddings(spark, folder).withColumn("k", F.when(F.col("vec_id") % 3 != 0, F.expr("vec_id div 4")))
    tiled = Sizes(broadcast_bytes=0, pivots=16, tile_rows=256, one_task_rows=16)
    one = undersample_nearmiss_v2(rows, "v", "label", K, key="k").withColumn("form", F.lit("one pass"))
    two = undersample_nearmiss_v2(rows, "v", "label", K, key="k", sizes=tiled).withColumn("form", F.lit("tiled"))
    return one.unionByName(two).select("vec_id", "label", "form")


@query(
    "nearmiss2_approx",
    NEARMISS_SQL.replace("SELECT vec_id, label FROM e", "SELECT vec_id, label, true AS chosen, 1.0::DOUBLE AS recall FROM e"),
)
def nearmiss2_approx(spark, folder):
    """The rows of the exact choice, whether the approximate one has them, and the share that it has."""
    rows = _embeddings(spark, folder)
    near = materialize(undersample_nearmiss_v2(rows, "v", "label", K, key="vec_id", approx=True, probes=PROBES).drop("v"), "near")
    exact = undersample_nearmiss_v2(rows, "v", "label", K, key="vec_id").drop("v")
    found = materialize(choice_recall(near, exact, "vec_id"), "recall")
    share = found.agg(F.avg(F.col("chosen").cast("int")).alias("recall"))
    return found.join(F.broadcast(share), F.lit(True))
