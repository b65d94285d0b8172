"""Looking rows up in a table of keys without trusting the keys to be few or even.

Labels, categories and item ids are usually few, and then a broadcast join is
right. Nothing guarantees it, so the table is measured first. A table that is too
large is joined by shuffle, with the keys that hold many rows handled separately:
they number at most ``HOT_KEYS`` because each holds at least that share of rows.
Keys that are too wide for that (more text than ``HOT_ROW_BYTES``), or that hold less, but still more rows than
a shuffle partition should, have their entry copied, and their rows dealt out over the copies. Which keys
these are, and how many copies each has, is a table of at most one row of two numbers per shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.functions.columns import column, hashable_columns
from retentia.functions.scratch import materialize

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20
HOT_KEYS = 10_000
HOT_ROW_BYTES = 1_024
SPREAD = 4_096
MOST_COPIED = 100_000
COPIES = 4

KEY = "__key"
SPREAD_COL = "__spread"
HOT_COL = "__hot"


def text_bytes(frame: DataFrame) -> Column:
    """Bytes of a row's strings; other types are small."""
    texts = [field.name for field in frame.schema.fields if isinstance(field.dataType, (T.StringType, T.BinaryType))]
    return sum((F.coalesce(F.octet_length(column(name)), F.lit(0)) for name in texts), F.lit(0).cast("long"))


class KeyTable:
    """One row per distinct key with its number of rows, measured when created.

    ``stored`` says the frame reads a written table already, and need not be kept.
    """

    def __init__(self, frame: DataFrame, key: str, count: str = "count", stored: bool = False):
        self.key, self.count_col = key, count
        cached = frame if stored else frame.persist()
        measured = cached.agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(text_bytes(frame)), F.lit(0)).alias("bytes"),
            F.coalesce(F.max(text_bytes(frame)), F.lit(0)).alias("widest"),
            F.coalesce(F.sum(count), F.lit(0)).alias("total"),
            F.min(count).alias("smallest"),
            F.max(count).alias("largest"),
        ).first()
        self.rows, self.total = measured["rows"], measured["total"]
        self.smallest, self.largest, self.widest = measured["smallest"], measured["largest"], measured["widest"]
        self.small = self.rows <= BROADCAST_ROWS and measured["bytes"] <= BROADCAST_BYTES
        if self.small:
            self.frame = frame.sparkSession.createDataFrame(cached.toArrow(), frame.schema)
        else:
            self.frame = frame if stored else materialize(cached, "keys")
        if not stored:
            cached.unpersist()

    @classmethod
    def of(cls, df: DataFrame, key: str) -> KeyTable:
        """Distinct values of a column and their row counts, combined before the shuffle."""
        count = "count" if key != "count" else "rows"
        return cls(df.groupBy(column(key)).agg(F.count(F.lit(1)).alias(count)), key, count)

    def with_values(self, **values: Column) -> KeyTable:
        """The same keys with further columns computed from the table's own."""
        extended = object.__new__(KeyTable)
        extended.__dict__.update(self.__dict__)
        extended.frame = self.frame.withColumns(values)
        return extended

    def attach(self, df: DataFrame, on: Column, values: list[str]) -> DataFrame:
        """Left join of ``values`` to the rows of ``df`` by null-safe equality of ``on``."""
        table = self.frame.select(column(self.key).alias(KEY), *[column(v) for v in values], self.count_col)
        if self.small:
            small = table.drop(self.count_col)
            return df.join(F.broadcast(small), on.eqNullSafe(small[KEY]), "left").drop(KEY)
        is_hot = (F.col(self.count_col) >= F.lit(self.total / HOT_KEYS)) & (text_bytes(table) <= HOT_ROW_BYTES)
        hot = table.filter(is_hot).select(
            F.col(KEY).alias(HOT_COL), F.struct(*[column(v) for v in values]).alias("__hot_values")
        )
        # Always 0, but read from the data: a literal would be folded out of the join's keys.
        zero = F.least(F.col(self.count_col).cast("long"), F.lit(0).cast("long"))
        entries = table.filter(~is_hot).withColumn(SPREAD_COL, zero)
        copies = self._copies(entries, df.sparkSession)
        if copies is not None:
            entries = entries.join(F.broadcast(copies), F.xxhash64(KEY) == copies["__hash"], "left").withColumn(
                SPREAD_COL, F.explode(F.sequence(zero, F.coalesce(F.col("__copies") - 1, zero)))
            )
        cold = entries.select(F.col(KEY), F.col(SPREAD_COL), F.struct(*[column(v) for v in values]).alias("__cold_values"))
        # Rows of hot keys found their values in the broadcast; the shuffle spreads them by content.
        spread = F.pmod(F.xxhash64(*hashable_columns(df), F.spark_partition_id()), F.lit(SPREAD)) + 1
        marked = (
            df.withColumn("__on", on)
            .join(F.broadcast(hot), F.col("__on").eqNullSafe(hot[HOT_COL]), "left")
            .withColumn("__side", F.when(F.col("__hot_values").isNull(), F.lit(0).cast("long")).otherwise(spread))
        )
        if copies is not None:
            dealt = F.coalesce(F.pmod(spread, F.col("__copies")), F.lit(0).cast("long"))
            marked = marked.join(F.broadcast(copies), F.xxhash64("__on") == copies["__hash"], "left").withColumn(
                "__side", F.when(F.col("__hot_values").isNull(), dealt).otherwise(F.col("__side"))
            )
        joined = marked.join(
            cold, F.col("__on").eqNullSafe(cold[KEY]) & (F.col("__side") == cold[SPREAD_COL]), "left"
        )
        found = F.coalesce("__hot_values", "__cold_values")
        return joined.select(*[column(name) for name in df.columns], *[found.getField(v).alias(v) for v in values])

    def _copies(self, entries: DataFrame, spark: SparkSession) -> DataFrame | None:
        """``__hash`` and ``__copies`` of the keys among ``entries`` with more rows than a shuffle partition should have; None if there cannot be any."""
        parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_COPIED)
        if (self.largest or 0) * parts < self.total or (parts <= HOT_KEYS and self.widest <= HOT_ROW_BYTES):
            return None
        heavy = entries.filter(F.col(self.count_col) * parts >= self.total)
        # Several for each partition that the rows would fill, as copies meet in partitions by chance.
        share = F.ceil(F.col(self.count_col) * parts * COPIES / F.lit(self.total)).cast("long")
        # By hash on both sides, so keys with one hash are copied alike.
        return heavy.groupBy(F.xxhash64(KEY).alias("__hash")).agg(F.max(share).alias("__copies"))
