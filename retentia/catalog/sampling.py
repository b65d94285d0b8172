from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from retentia.catalog import query, table
from retentia.catalog.encoding import labelled_documents
from retentia.catalog.profiling import rounded
from retentia.operators import balance, split
from retentia.plans.preprocess import preprocess_data

SEED = 7


def draw_sql(*parts: str) -> str:
    """The keyed uniform number, as DuckDB SQL."""
    text = " || '|' || ".join([f"'{SEED}'", *[f"({part})::VARCHAR" for part in parts]])
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query(
    "class_weights",
    """SELECT doc_id, quality, round((SELECT count(*) FROM labels) /
       ((SELECT count(DISTINCT quality) FROM labels) * count(*) OVER (PARTITION BY quality)), 6) AS class_weights FROM labels""",
)
def class_weights(spark, folder):
    weighted = balance.compute_class_weights_column(table(spark, folder, "labels"), "quality")
    return rounded(weighted.drop("toxic"), "class_weights")


@query(
    "class_weights_many_classes",
    """SELECT o_orderkey, round((SELECT count(*) FROM orders) /
       ((SELECT count(DISTINCT o_custkey) FROM orders) * count(*) OVER (PARTITION BY o_custkey)), 6) AS class_weights FROM orders""",
)
def class_weights_many_classes(spark, folder):
    weighted = balance.compute_class_weights_column(table(spark, folder, "orders"), "o_custkey")
    return rounded(weighted.select("o_orderkey", "class_weights"), "class_weights")


@query("split_random", f"SELECT o_orderkey, CASE WHEN {draw_sql('o_orderkey')} < 0.8 THEN 'train' ELSE 'test' END AS split FROM orders")
def split_random(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    train, test = split.random_split(orders, 0.8, SEED, "o_orderkey")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query(
    "split_stratified",
    f"""SELECT o_orderkey, o_orderstatus, CASE WHEN {draw_sql('o_orderstatus', 'o_orderkey')} < 0.7 THEN 'train' ELSE 'test' END AS split
        FROM orders""",
)
def split_stratified(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return split.with_split(orders, 0.7, SEED, "o_orderkey", "o_orderstatus")


_RATES = """r AS (SELECT quality, count(*) AS n, min(count(*)) OVER () AS smallest, max(count(*)) OVER () AS largest
            FROM labels GROUP BY quality), l AS (SELECT * FROM labels JOIN r USING (quality))"""


@query(
    "undersample",
    f"WITH {_RATES} SELECT doc_id, quality FROM l WHERE {draw_sql('quality', 'doc_id')} < smallest::DOUBLE / n",
)
def undersample(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return balance.undersample_random(labels, "quality", "doc_id", SEED)


@query("undersample_keyless", "SELECT DISTINCT quality, true AS within_bounds FROM labels")
def undersample_keyless(spark, folder):
    """Without a key, rows that are equal draw each for themselves: class sizes within five deviations."""
    labels = table(spark, folder, "labels").select("quality")
    sizes = labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    smallest = sizes.agg(F.min("n").alias("smallest"))
    kept = balance.undersample_random(labels, "quality", seed=SEED).groupBy("quality").agg(F.count(F.lit(1)).alias("kept"))
    joined = sizes.crossJoin(F.broadcast(smallest)).join(kept, "quality", "left")
    deviation = F.sqrt(F.col("smallest") * (1 - F.col("smallest") / F.col("n")))
    return joined.select("quality", (F.abs(F.coalesce("kept", F.lit(0)) - F.col("smallest")) <= 5 * deviation).alias("within_bounds"))


@query(
    "oversample_replicate",
    f"""WITH {_RATES}, c AS (SELECT doc_id, quality, CASE WHEN n = largest THEN 1 ELSE floor(largest / n)::BIGINT +
        ({draw_sql('quality', 'doc_id')} < largest / n - floor(largest / n))::BIGINT END AS copies FROM l)
        SELECT doc_id, quality FROM c, unnest(range(copies)) u(i)""",
)
def oversample_replicate(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return balance.oversample_random(labels, "quality", "doc_id", SEED, mode="replicate")


def _poisson_terms(mean: str) -> str:
    terms = [f"pow({mean}, {n}) / {_factorial(n)}" for n in range(balance.POISSON_TERMS)]
    return "[" + ", ".join(f"exp(-({mean})) * ({' + '.join(terms[:upto])})" for upto in range(1, len(terms) + 1)) + "]"


def _factorial(n: int) -> str:
    value = 1
    for factor in range(2, n + 1):
        value *= factor
    return f"{value}::DOUBLE"


@query(
    "oversample_poisson",
    f"""WITH {_RATES}, p AS (SELECT *, floor(largest / n)::BIGINT AS whole, largest / n - floor(largest / n) AS rest FROM l),
        u AS (SELECT doc_id, quality, whole, unit, {draw_sql('quality', 'doc_id', 'unit')} AS draw,
                     CASE WHEN unit < whole THEN {_poisson_terms('1.0::DOUBLE')} ELSE {_poisson_terms('rest')} END AS cdf
              FROM p, unnest(range(whole + 1)) x(unit) WHERE n < largest),
        c AS (SELECT doc_id, quality, sum(len(list_filter(cdf, lambda bound: draw >= bound)))::BIGINT AS copies FROM u GROUP BY ALL)
        SELECT doc_id, quality FROM c, unnest(range(copies)) u(i)
        UNION ALL SELECT doc_id, quality FROM l WHERE n = largest""",
)
def oversample_poisson(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return balance.oversample_random(labels, "quality", "doc_id", SEED)


_FLOW_SQL = f"""d AS (SELECT DISTINCT doc_id, lang, source, n_chars, quality FROM documents JOIN labels USING (doc_id)),
  langs AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS lx FROM d GROUP BY lang),
  sources AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS sx FROM d GROUP BY source),
  f AS (SELECT doc_id, quality, lx::DOUBLE AS lx, sx::DOUBLE AS sx,
               (n_chars - min(n_chars) OVER ())::DOUBLE / (max(n_chars) OVER () - min(n_chars) OVER ()) AS nx,
               CASE WHEN {draw_sql('quality', 'doc_id')} < 0.8 THEN 'train' ELSE 'test' END AS split
        FROM d JOIN langs USING (lang) JOIN sources USING (source)),
  r AS (SELECT quality, count(*) AS n, min(count(*)) OVER () AS smallest FROM f WHERE split = 'train' GROUP BY quality)"""


def flow_report(train, test, label):
    """Rows and feature sums of both parts by label: small, and sensitive to every step."""
    parts = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    slots = parts.select("split", F.col(label).alias("label"), F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return slots.groupBy("split", "label", "slot").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "preprocess_flow",
    f"""WITH {_FLOW_SQL}, kept AS (SELECT f.* FROM f JOIN r USING (quality)
          WHERE split = 'test' OR {draw_sql('quality', 'doc_id')} < smallest::DOUBLE / n)
        SELECT split, quality AS label, 0 AS slot, count(*) AS rows, round(sum(lx), 4) AS total FROM kept GROUP BY ALL
        UNION ALL SELECT split, quality, 1, count(*), round(sum(sx), 4) FROM kept GROUP BY ALL
        UNION ALL SELECT split, quality, 2, count(*), round(sum(nx), 4) FROM kept GROUP BY ALL""",
)
def preprocess_flow(spark, folder):
    rows = labelled_documents(spark, folder).drop("toxic")
    train, test = preprocess_data(
        rows,
        "quality",
        {"row_threshold": 0.4, "column_threshold": 0.2, "default_values": {"n_chars": "median"}},
        transformation_categorical="index",
        transformation_numerical="normalize",
        stratified_split=True,
        train_split_ratio=0.8,
        rebalancing_technique="undersample_random",
        seed=SEED,
        key="doc_id",
    )
    return flow_report(train, test, "quality")


@query(
    "preprocess_flow_wide_numeric",
    f"""WITH {_FLOW_SQL}, w AS (SELECT *, CASE WHEN {draw_sql('quality', 'doc_id')} < 0.8 THEN 'train' ELSE 'test' END AS part
          FROM d), t AS (SELECT part AS split, quality AS label, (n_chars / 100)::DECIMAL(12, 2)::DOUBLE AS dec, (doc_id % 100)::DOUBLE AS small,
          (doc_id % 7)::DOUBLE AS tiny, n_chars::DOUBLE AS v FROM w)
        SELECT split, label, slot, count(*) AS rows, round(sum(value), 4) AS total
        FROM (SELECT split, label, unnest([0, 1, 2, 3])::INT AS slot, unnest([dec, small, tiny, v]) AS value FROM t) GROUP BY ALL""",
)
def preprocess_flow_wide_numeric(spark, folder):
    """Decimal, short, byte and vector features."""
    rows = labelled_documents(spark, folder).select(
        "doc_id",
        "quality",
        (F.col("n_chars") / 100).cast("decimal(12, 2)").alias("dec"),
        (F.col("doc_id") % 100).cast("smallint").alias("small"),
        (F.col("doc_id") % 7).cast("tinyint").alias("tiny"),
        array_to_vector(F.array(F.col("n_chars").cast("double"))).alias("v"),
    )
    train, test = preprocess_data(
        rows, "quality", {"row_threshold": 0.4, "column_threshold": 0.2}, stratified_split=True, train_split_ratio=0.8, seed=SEED, key="doc_id"
    )
    return flow_report(train, test, "quality")


@query(
    "preprocess_flow_nearmiss",
    f"""WITH {_FLOW_SQL}, t AS (SELECT * FROM f WHERE split = 'train'),
          rare AS (SELECT quality, n FROM r ORDER BY n, quality LIMIT 1),
          pairs AS (SELECT a.doc_id, sqrt((a.lx - b.lx) * (a.lx - b.lx) + (a.sx - b.sx) * (a.sx - b.sx) + (a.nx - b.nx) * (a.nx - b.nx)) AS dist
                    FROM t a JOIN t b ON a.quality <> (SELECT quality FROM rare) AND b.quality = (SELECT quality FROM rare)),
          places AS (SELECT doc_id, dist, row_number() OVER (PARTITION BY doc_id ORDER BY dist DESC) AS place FROM pairs),
          scores AS (SELECT doc_id, avg(dist) AS score FROM places WHERE place <= 3 GROUP BY doc_id),
          near AS (SELECT doc_id FROM scores ORDER BY score, doc_id LIMIT (SELECT n FROM rare)),
          kept AS (SELECT * FROM f WHERE split = 'test' OR quality = (SELECT quality FROM rare) OR doc_id IN (SELECT doc_id FROM near))
        SELECT split, quality AS label, 0 AS slot, count(*) AS rows, round(sum(lx), 4) AS total FROM kept GROUP BY ALL
        UNION ALL SELECT split, quality, 1, count(*), round(sum(sx), 4) FROM kept GROUP BY ALL
        UNION ALL SELECT split, quality, 2, count(*), round(sum(nx), 4) FROM kept GROUP BY ALL""",
)
def preprocess_flow_nearmiss(spark, folder):
    """NearMiss-2 inside the flow: as many rows of the large class as the small one has."""
    train, test = preprocess_data(
        labelled_documents(spark, folder).drop("toxic"),
        "quality",
        {"row_threshold": 0.4, "column_threshold": 0.2},
        transformation_categorical="index",
        transformation_numerical="normalize",
        stratified_split=True,
        rebalancing_technique="nearmiss_v2",
        resampling_options={"k": 3},
        seed=SEED,
        key="doc_id",
    )
    return flow_report(train, test, "quality")


@query(
    "distinct_labels",
    "SELECT DISTINCT quality FROM documents LEFT JOIN labels USING (doc_id)",
)
def distinct_labels(spark, folder):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return joined.select("quality").distinct()


@query(
    "preprocess_flow_weights",
    f"""WITH {_FLOW_SQL}, w AS (SELECT quality, (SELECT sum(n) FROM r) / (2 * n) AS weight FROM r)
        SELECT split, quality AS label, count(*) AS rows, round(sum(weight), 4) AS weights
        FROM f JOIN w USING (quality) WHERE split = 'train' GROUP BY ALL""",
)
def preprocess_flow_weights(spark, folder):
    rows = labelled_documents(spark, folder).drop("toxic")
    train, _ = preprocess_data(
        rows,
        "quality",
        {"row_threshold": 0.4, "column_threshold": 0.2},
        transformation_categorical="encode",
        stratified_split=True,
        rebalancing_technique="class_weights",
        seed=SEED,
        key="doc_id",
        fit_on="train",
    )
    report = train.groupBy(F.col("quality").alias("label")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("class_weights"), 4).alias("weights")
    )
    return report.withColumn("split", F.lit("train"))
