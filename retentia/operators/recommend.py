"""Recommendation arrays: item ids for item indexes, and top-n tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.functions.columns import column
from retentia.functions.keytable import BROADCAST_BYTES, BROADCAST_ROWS, KeyTable
from retentia.functions.scratch import local_table, materialize

ROW, USER, ITEMS = "__row", "__user", "__items"
GROUP_LIMIT = 1_000
SLICES = 64


def element_fields(df: DataFrame, recommendations_col: str) -> tuple[str, str]:
    """Names of the item and score fields of the array's elements, by position."""
    fields = df.schema[recommendations_col].dataType.elementType.fieldNames()
    return fields[0], fields[1]


def get_top_recommendations(df: DataFrame, top_n: int, recommendations_col: str = "recommendations") -> DataFrame:
    """Add ``top_recommendations``: the items of the best scores of each row's array.

    Equal scores keep their order in the array; a null array gives an empty one.
    """
    item, score = element_fields(df, recommendations_col)
    return df.withColumn("top_recommendations", _best_items(column(recommendations_col), item, score, top_n))


def _best_items(recommendations: Column, item: str, score: str, top_n: int) -> Column:
    placed = F.transform(
        F.coalesce(recommendations, F.array()),
        lambda rec, at: F.struct(
            rec[score].isNull().alias("unscored"),
            (-rec[score].cast("double")).alias("down"),
            at.alias("at"),
            rec[item].cast("string").alias("item"),
        ),
    )
    return F.transform(F.slice(F.sort_array(placed), 1, top_n), lambda rec: rec["item"])


def top_recommendations_by_user(
    df: DataFrame, user_col: str, top_n: int, recommendations_col: str = "recommendations"
) -> DataFrame:
    """``(user, top_recommendations)`` for every user, over all of a user's rows.

    Ties go by place in the array, then item. The rank filter cuts every user to
    ``top_n`` rows before the shuffle, so a user with very many rows stays small.
    """
    item, score = element_fields(df, recommendations_col)
    exploded = df.select(column(user_col).alias(USER), F.posexplode_outer(column(recommendations_col)).alias("at", "rec"))
    scored = exploded.select(
        USER, "at", F.col("rec")[item].cast("string").alias("item"), (-F.col("rec")[score].cast("double")).alias("down")
    )
    if top_n > GROUP_LIMIT:
        # Spark does not cut groups this wide before the shuffle: cut slices of a user first.
        slice_ = F.pmod(F.xxhash64("at", "item", "down", F.spark_partition_id()), F.lit(SLICES))
        scored = _best(scored.withColumn("slice", slice_), [USER, "slice"], top_n).drop("slice")
    kept = F.when(F.col("at").isNotNull(), F.struct("place", "item"))
    return (
        _best(scored, [USER], top_n)
        .groupBy(F.col(USER).alias(user_col))
        .agg(F.sort_array(F.collect_list(kept)).alias("kept"))
        .select(column(user_col), F.transform("kept", lambda rec: rec["item"]).alias("top_recommendations"))
    )


def _best(scored: DataFrame, groups: list[str], top_n: int) -> DataFrame:
    """The ``top_n`` best rows of each group with their ``place``."""
    order = [F.asc_nulls_last("down"), F.asc_nulls_last("at"), F.col("item")]
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return scored.withColumn("place", place).filter(F.col("place") <= top_n)


def get_user_top_recommendations(
    df: DataFrame, user: object, user_col: str, top_n: int, recommendations_col: str = "recommendations"
) -> DataFrame:
    """The same for one user; the filter reaches the scan. No rows for an unknown user."""
    return top_recommendations_by_user(df.filter(column(user_col) == F.lit(user)), user_col, top_n, recommendations_col)


def catalogue_of(labels: list[str], df: DataFrame) -> DataFrame:
    """Catalogue ``(item_index, item)`` from an indexer's labels."""
    return local_table(df.sparkSession, list(enumerate(labels)), "item_index bigint, item string")


def _as_array(catalogue: DataFrame, most: int) -> DataFrame | None:
    """The items in one row as an array by index, if they are few, small and numbered without gaps from 0."""
    found = catalogue.agg(
        F.count(F.lit(1)), F.count_distinct("item_index"), F.min("item_index"), F.max("item_index"), F.sum(F.octet_length("item"))
    ).first()
    rows, distinct, low, high, size = found
    if not rows or rows > most or distinct != rows or low != 0 or high != rows - 1 or (size or 0) > BROADCAST_BYTES:
        return None
    pairs = F.sort_array(F.collect_list(F.struct("item_index", "item")))
    return catalogue.agg(F.transform(pairs, lambda pair: pair["item"]).alias(ITEMS))


def _by_array(df: DataFrame, items: DataFrame, recommendations_col: str, index: str, score: str) -> DataFrame:
    def named(rec: Column) -> Column:
        at = rec[index].cast("long")
        missing = F.raise_error(F.concat(F.lit("no item for index "), F.coalesce(at.cast("string"), F.lit("null")))).cast("string")
        item = F.when((at >= 0) & (at < F.size(ITEMS)), F.get(F.col(ITEMS), at.cast("int")))
        return F.struct(F.when(item.isNotNull(), item).otherwise(missing).alias("asin"), rec[score].cast("float").alias("score"))

    joined = df.crossJoin(F.broadcast(items)).withColumn(recommendations_col, F.transform(column(recommendations_col), named))
    return joined.select(*[column(name) for name in df.columns])


def revert_item_index_in_recommendations(
    df: DataFrame, catalogue: DataFrame, recommendations_col: str = "recommendations", rows_at_once: int = BROADCAST_ROWS
) -> DataFrame:
    """Replace ``(index, score)`` elements by ``(asin, score)`` from ``(item_index, item)``.

    A small catalogue whose indexes count from 0 is broadcast as one array, and rows stay as
    they are. With any other, elements are looked up one by one and each row's array is put
    together again in its order. An index that is not in the catalogue is an error either way.
    """
    index, score = element_fields(df, recommendations_col)
    if rows_at_once > 0 and (items := _as_array(catalogue, rows_at_once)) is not None:
        return _by_array(df, items, recommendations_col, index, score)
    numbered = materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "recommendations")
    elements = numbered.select(ROW, F.posexplode(column(recommendations_col)).alias("at", "rec")).select(
        ROW, "at", F.col("rec")[index].cast("long").alias("index"), F.col("rec")[score].cast("float").alias("score")
    )
    used = elements.groupBy("index").agg(F.count(F.lit(1)).alias("count"))
    items = KeyTable(
        used.join(catalogue, F.col("index") == F.col("item_index"), "left").select("index", "item", "count"), "index"
    )
    named = items.attach(elements, F.col("index"), ["item"])
    missing = F.raise_error(F.concat(F.lit("no item for index "), F.col("index").cast("string"))).cast("string")
    asin = F.when(F.col("item").isNull(), missing).otherwise(F.col("item"))
    arrays = (
        named.groupBy(ROW)
        .agg(F.sort_array(F.collect_list(F.struct("at", asin.alias("asin"), "score"))).alias("placed"))
        .select(
            ROW,
            F.transform(
                "placed", lambda rec: F.struct(rec["asin"].alias("asin"), rec["score"].alias("score"))
            ).alias("__named"),
        )
    )
    empty = F.when(column(recommendations_col).isNotNull(), F.array().cast("array<struct<asin:string,score:float>>"))
    return (
        numbered.join(arrays, ROW, "left")
        .withColumn(recommendations_col, F.coalesce("__named", empty))
        .select(*[column(name) for name in df.columns])
    )
