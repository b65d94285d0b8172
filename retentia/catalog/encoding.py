from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentia.catalog import query, table
from retentia.catalog.profiling import rounded
from retentia.operators import encode
from retentia.plans.features import get_indexed_and_encode_vectors, process_data_to_model

SEGMENT_INDEX_SQL = """idx AS (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS ix,
    count(*) OVER () AS k FROM customer GROUP BY c_mktsegment)"""
SEGMENT = [("c_mktsegment", "segment_index")]


def slots(df, key, vector_col, out="value"):
    """A vector column as ``(key, slot, value)`` rows."""
    return df.select(key, F.posexplode(vector_to_array(vector_col)).alias("slot", out))


@query(
    "string_index",
    f"WITH {SEGMENT_INDEX_SQL} SELECT c_custkey, ix::DOUBLE AS segment_index FROM customer JOIN idx ON c_mktsegment = s",
)
def string_index(spark, folder):
    return encode.string_index_columns(table(spark, folder, "customer"), SEGMENT)[0].select("c_custkey", "segment_index")


@query(
    "string_index_numeric",
    """WITH idx AS (SELECT l_quantity::VARCHAR AS s, row_number() OVER (ORDER BY count(*) DESC, l_quantity::VARCHAR) - 1 AS ix
                    FROM lineitem GROUP BY l_quantity)
       SELECT s AS quantity, ix::DOUBLE AS quantity_index, count(*) AS rows FROM lineitem
       JOIN idx ON l_quantity::VARCHAR = s GROUP BY s, ix""",
)
def string_index_numeric(spark, folder):
    indexed, _ = encode.string_index_columns(table(spark, folder, "lineitem"), [("l_quantity", "quantity_index")])
    quantity = F.col("l_quantity").cast("string").alias("quantity")
    return indexed.groupBy(quantity, "quantity_index").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "string_index_large",
    """WITH idx AS (SELECT o_custkey::VARCHAR AS s, row_number() OVER (ORDER BY count(*) DESC, o_custkey::VARCHAR) - 1 AS ix
                    FROM orders GROUP BY o_custkey)
       SELECT o_orderkey, ix::DOUBLE AS customer_index, s AS customer FROM orders JOIN idx ON o_custkey::VARCHAR = s""",
)
def string_index_large(spark, folder):
    """The table form, for vocabularies kept off the driver, and its inverse."""
    pairs = [("o_custkey", "customer_index")]
    indexed, model = encode.string_index_columns(table(spark, folder, "orders"), pairs, driver_labels=0)
    reverted = encode.revert_string_index(indexed, [("customer_index", "customer")], model)
    return reverted.select("o_orderkey", "customer_index", "customer")


@query("revert_index", "SELECT c_custkey, c_mktsegment AS segment FROM customer")
def revert_index(spark, folder):
    indexed, model = encode.string_index_columns(table(spark, folder, "customer"), SEGMENT)
    reverted = encode.revert_string_index(indexed.drop("c_mktsegment"), [("segment_index", "segment")], model)
    return reverted.select("c_custkey", "segment")


@query(
    "one_hot",
    f"""WITH {SEGMENT_INDEX_SQL} SELECT c_custkey, slot::INT AS slot, (ix = slot)::INT::DOUBLE AS value
        FROM customer JOIN idx ON c_mktsegment = s, unnest(range(k - 1)) AS r(slot)""",
)
def one_hot(spark, folder):
    indexed, _ = encode.string_index_columns(table(spark, folder, "customer"), SEGMENT)
    encoded, _ = encode.encoded_index_columns(indexed, [("segment_index", "segment_encoded")])
    return slots(encoded, "c_custkey", "segment_encoded")


@query("boolean_index", "SELECT doc_id, (quality = 1)::INT AS good FROM documents LEFT JOIN labels USING (doc_id) WHERE quality = 1 UNION ALL SELECT doc_id, 0 FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality <> 1")
def boolean_index(spark, folder):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    flagged = joined.select("doc_id", (F.col("quality") == 1).alias("is_good"))
    return encode.boolean_index_columns(flagged, [("is_good", "good")]).drop("is_good")


@query(
    "label_prepare",
    """WITH q AS (SELECT quality AS v, row_number() OVER (ORDER BY count(*) DESC, quality::VARCHAR) - 1 AS ix FROM labels GROUP BY quality),
            t AS (SELECT toxic AS v, row_number() OVER (ORDER BY count(*) DESC, toxic::VARCHAR) - 1 AS ix FROM labels GROUP BY toxic)
       SELECT doc_id, q.ix::DOUBLE AS indexed_quality, t.ix::DOUBLE AS indexed_harm,
              toxic::INT AS flag_booleantointeger
       FROM labels JOIN q ON quality = q.v JOIN t ON toxic = t.v""",
)
def label_prepare(spark, folder):
    """A numeric, a text and a boolean label."""
    labels = table(spark, folder, "labels").select(
        "doc_id",
        "quality",
        F.when(F.col("toxic") == 1, "1-harmful").otherwise("0-harmless").alias("harm"),
        (F.col("toxic") == 1).alias("flag"),
    )
    for label in ("quality", "harm", "flag"):
        labels, _ = encode.churn(labels, label)
    return labels.drop("quality", "harm", "flag")


@query("label_invert", "SELECT doc_id, toxic, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS quality_inverted FROM labels")
def label_invert(spark, folder):
    return encode.churn_inverter(table(spark, folder, "labels"), "quality")


SCALED = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "min_max",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}_normalized" for c in SCALED)
    + " FROM lineitem",
)
def min_max(spark, folder):
    scaled = encode.normalize_min_max_values(SCALED, table(spark, folder, "lineitem"))
    names = [f"{name}_normalized" for name in SCALED]
    return rounded(scaled.select("l_orderkey", "l_linenumber", *names), *names)


PART_VECTOR_SQL = "SELECT p_partkey, 0 AS slot, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 1, p_retailprice FROM part"


@query("assemble", PART_VECTOR_SQL)
def assemble(spark, folder):
    part = encode.vector_feature_column(table(spark, folder, "part"), ["p_size", "p_retailprice"], "features")
    return slots(part, "p_partkey", "features")


@query(
    "vector_index",
    """SELECT p_partkey, 0 AS slot, (dense_rank() OVER (ORDER BY p_size) - 1)::DOUBLE AS value FROM part
       UNION ALL SELECT p_partkey, 1, p_retailprice FROM part""",
)
def vector_index(spark, folder):
    part = encode.vector_feature_column(table(spark, folder, "part"), ["p_size", "p_retailprice"], "features")
    return slots(encode.vector_index_column(part, "features", "indexed", 50)[0], "p_partkey", "indexed")


def labelled_documents(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, folder, "labels"), "doc_id")


_DOC_INDEX_SQL = """d AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)),
  langs AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS lx, count(*) OVER () AS lk FROM d GROUP BY lang),
  sources AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS sx, count(*) OVER () AS sk FROM d GROUP BY source),
  w AS (SELECT quality, (SELECT count(*) FROM d) / ((SELECT count(DISTINCT quality) FROM d) * count(*)) AS weight FROM d GROUP BY quality),
  f AS (SELECT * FROM d JOIN langs USING (lang) JOIN sources USING (source) JOIN w USING (quality))"""


@query(
    "feature_vectors",
    f"""WITH {_DOC_INDEX_SQL}
    SELECT doc_id, 'indexed' AS vector, 0 AS slot, lx::DOUBLE AS value, round(weight, 6) AS class_weights FROM f
    UNION ALL SELECT doc_id, 'indexed', 1, sx::DOUBLE, round(weight, 6) FROM f
    UNION ALL SELECT doc_id, 'indexed', 2, n_chars::DOUBLE, round(weight, 6) FROM f
    UNION ALL SELECT doc_id, 'encoded', slot::INT, (lx = slot)::INT::DOUBLE, round(weight, 6) FROM f, unnest(range(lk - 1)) r(slot)
    UNION ALL SELECT doc_id, 'encoded', (lk - 1 + slot)::INT, (sx = slot)::INT::DOUBLE, round(weight, 6) FROM f, unnest(range(sk - 1)) r(slot)
    UNION ALL SELECT doc_id, 'encoded', (lk + sk - 2)::INT, n_chars::DOUBLE, round(weight, 6) FROM f""",
)
def feature_vectors(spark, folder):
    vectors = get_indexed_and_encode_vectors(
        labelled_documents(spark, folder), ["lang", "source", "n_chars"], "quality"
    )
    parts = [
        vectors.df.select(
            "doc_id",
            F.lit(name).alias("vector"),
            F.round(vectors.weight_col, 6).alias("class_weights"),
            F.posexplode(vector_to_array(col)).alias("slot", "value"),
        )
        for name, col in (("indexed", vectors.indexed_col), ("encoded", vectors.encoded_col))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "model_table",
    f"""WITH {_DOC_INDEX_SQL}, q AS (SELECT quality, row_number() OVER (ORDER BY count(*) DESC, quality) - 1 AS qx FROM d GROUP BY quality)
    SELECT doc_id, qx::DOUBLE AS "Churn_Index", slot::INT AS slot,
           CASE WHEN slot < lk - 1 THEN (lx = slot)::INT::DOUBLE ELSE n_chars::DOUBLE END AS value
    FROM f JOIN q USING (quality), unnest(range(lk)) r(slot)""",
)
def model_table(spark, folder):
    """The notebook form: drop columns, index, encode, weigh, assemble."""
    prepared, _ = process_data_to_model(
        labelled_documents(spark, folder),
        [("lang", "langIndex")],
        [("langIndex", "langEncoded")],
        ["langEncoded", "n_chars"],
        "quality",
        drop=["source", "toxic"],
    )
    return prepared.select("doc_id", "Churn_Index", F.posexplode(vector_to_array("features")).alias("slot", "value"))


@query(
    "model_table_weights",
    """SELECT doc_id, round((SELECT count(*) FROM documents JOIN labels USING (doc_id)) /
       (count(*) OVER (PARTITION BY quality) * (SELECT count(DISTINCT quality) FROM documents JOIN labels USING (doc_id))), 6) AS class_weights
       FROM documents JOIN labels USING (doc_id)""",
)
def model_table_weights(spark, folder):
    rows = labelled_documents(spark, folder)
    prepared, _ = process_data_to_model(
        rows, [("lang", "langIndex")], [("langIndex", "langEncoded")], ["langEncoded", "n_chars"], "quality", drop=["source", "toxic"]
    )
    return rounded(prepared.select("doc_id", "class_weights"), "class_weights")


@query(
    "feature_vectors_mixed",
    """WITH d AS (SELECT doc_id, lang, n_chars, (n_chars > 1000)::INT AS long, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS y
                  FROM documents JOIN labels USING (doc_id)),
         l AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS lx FROM d GROUP BY lang),
         c AS (SELECT y, row_number() OVER (ORDER BY count(*) DESC, y) - 1 AS yx, count(*) AS n FROM d GROUP BY y)
       SELECT doc_id, yx::DOUBLE AS label, round((SELECT count(*) FROM d) / (2 * n), 6) AS class_weights,
              unnest([0, 1, 2])::INT AS slot, unnest([lx::DOUBLE, long::DOUBLE, n_chars::DOUBLE]) AS value
       FROM d JOIN l USING (lang) JOIN c USING (y)""",
)
def feature_vectors_mixed(spark, folder):
    """A text, a boolean and a number as features of a text label."""
    rows = labelled_documents(spark, folder).select(
        "doc_id", "lang", "n_chars", (F.col("n_chars") > 1000).alias("long"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("y")
    )
    vectors = get_indexed_and_encode_vectors(rows, ["lang", "long", "n_chars"], "y")
    return rounded(
        vectors.df.select(
            "doc_id",
            F.col(vectors.label_col).alias("label"),
            F.col(vectors.weight_col).alias("class_weights"),
            F.posexplode(vector_to_array(vectors.indexed_col)).alias("slot", "value"),
        ),
        "class_weights",
    )
