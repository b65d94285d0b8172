from pyspark.sql import functions as F

from retentia.catalog import query, table
from retentia.operators import recommend
from retentia.operators.encode import fit_string_index

TOP = 3
SCORES_SQL = """s AS (SELECT user_id, event_type, round(sum(value), 2) AS score FROM events GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS place FROM s)"""


def user_arrays(spark, folder, item="event_type"):
    """Per user, the total value of each event type: an array of at most one element per type."""
    totals = (
        table(spark, folder, "events").groupBy("user_id", item).agg(F.round(F.sum("value"), 2).alias("score"))
    )
    return totals.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.col(item).alias("item"), "score"))).alias("recommendations"))


def _joined(df):
    return df.select("user_id", F.array_join("top_recommendations", ",").alias("top_recommendations"))


TOP_SQL = f"""WITH {SCORES_SQL} SELECT user_id, string_agg(event_type, ',' ORDER BY place) AS top_recommendations
    FROM r WHERE place <= {TOP} GROUP BY user_id"""


@query("recommend_rows", TOP_SQL)
def recommend_rows(spark, folder):
    return _joined(recommend.get_top_recommendations(user_arrays(spark, folder), TOP))


@query("recommend_top_n", TOP_SQL)
def recommend_top_n(spark, folder):
    return _joined(recommend.top_recommendations_by_user(user_arrays(spark, folder), "user_id", TOP))


@query("recommend_one_user", TOP_SQL.replace("GROUP BY user_id", "AND user_id = 8 GROUP BY user_id"))
def recommend_one_user(spark, folder):
    return _joined(recommend.get_user_top_recommendations(user_arrays(spark, folder), 8, "user_id", TOP))


ITEMS_SQL = f"""WITH {SCORES_SQL} SELECT user_id, event_type AS asin, score::FLOAT AS score FROM s"""


@query("recommend_items", ITEMS_SQL)
def recommend_items(spark, folder):
    """Arrays of (index, score) back to item ids by the indexer's catalogue."""
    return _items(spark, folder)


@query("recommend_items_large", ITEMS_SQL)
def recommend_items_large(spark, folder):
    """The same with an index and a catalogue that never meet on the driver."""
    return _items(spark, folder, driver_labels=0, rows_at_once=0)


def _items(spark, folder, driver_labels=50_000, rows_at_once=50_000):
    events = table(spark, folder, "events")
    model = fit_string_index(events, [("event_type", "productIndex")], driver_labels=driver_labels)
    indexed = model.transform(events).groupBy("user_id", "productIndex").agg(F.round(F.sum("value"), 2).alias("score"))
    arrays = indexed.groupBy("user_id").agg(
        F.collect_list(F.struct(F.col("productIndex").cast("int").alias("index"), F.col("score").cast("float").alias("score"))).alias(
            "recommendations"
        )
    )
    catalogue = model.catalogue(spark, "productIndex")
    named = recommend.revert_item_index_in_recommendations(arrays, catalogue, rows_at_once=rows_at_once)
    return named.select("user_id", F.inline("recommendations"))
