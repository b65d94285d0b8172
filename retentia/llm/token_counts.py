"""Token counts of texts from the counts of their distinct pre-tokens.

The tokens of a text are those of its pre-tokens, so each distinct pre-token of the corpus
is tokenized once and its count joined to the frequencies of pre-tokens per document. Ids
are never kept. Frequencies follow a power law: the ``hot`` most frequent pre-tokens, a
bounded table that is broadcast, settle most of them where the text is read, and only the
rest is shuffled to the table of all pre-tokens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import column
from retentia.functions.scratch import materialize
from retentia.llm.pretokens import bound_batches, tokenizer_file

HOT_PIECES = 1 << 18
HOT_CHARS = 1_024
HOT_CHARS_TOGETHER = 8 << 20
COUNT_AT_ONCE = 1 << 14
HELD_PIECES = 1 << 19


def piece_frequencies(df: DataFrame, text: str, path: str) -> DataFrame:
    """``piece`` and ``n``, its occurrences in all texts; partial counts leave each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, counts = tokenizer_file(path), Counter()
        for batch in batches:
            for value in batch.column(0):
                for pieces, _ in file.parts(value.as_py() or ""):
                    counts.update(pieces)
                if len(counts) > HELD_PIECES:
                    yield from _rows(counts)
                    counts = Counter()
        yield from _rows(counts)

    found = bound_batches(df).select(column(text).alias("text")).mapInArrow(run, "piece string, n long")
    return found.groupBy("piece").agg(F.sum("n").alias("n"))


def _rows(counts: Counter) -> Iterator[pa.RecordBatch]:
    pieces = list(counts)
    for at in range(0, len(pieces), COUNT_AT_ONCE):
        some = pieces[at : at + COUNT_AT_ONCE]
        yield pa.record_batch([pa.array(some, pa.string()), pa.array([counts[x] for x in some], pa.int64())], ["piece", "n"])


def count_pieces(pieces: DataFrame, path: str) -> DataFrame:
    """``pieces`` with ``tokens``, the number of tokens of each ``piece``, from the tokenizers library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = tokenizer_file(path)
        for batch in batches:
            tokens = []
            for at in range(0, batch.num_rows, COUNT_AT_ONCE):
                some = batch.column("piece").slice(at, COUNT_AT_ONCE).to_pylist()
                _, bounds = file.encode(some)
                tokens += (bounds[:, 1] - bounds[:, 0]).tolist()
            yield pa.record_batch([*batch.columns, pa.array(tokens, pa.int64())], ["piece", "n", "tokens"])

    return pieces.select("piece", "n").mapInArrow(run, "piece string, n long, tokens long")


def hottest(pieces: DataFrame, most: int) -> DataFrame:
    """The pieces with the largest counts: all whose count has as many binary digits as keeps them within ``most``, and within a bound of characters."""
    short = pieces.filter(F.length("piece") <= HOT_CHARS).withColumn("digits", F.length(F.bin("n")))
    sizes = short.groupBy("digits").agg(F.count(F.lit(1)).alias("count"), F.sum(F.length("piece")).alias("chars")).collect()
    left, room, least = most, HOT_CHARS_TOGETHER, 99
    for digits, count, chars in sorted(map(tuple, sizes), reverse=True):
        if count > left or chars > room:
            break
        left, room, least = left - count, room - chars, digits
    return short.filter(F.col("digits") >= least)


def count_tokens(df: DataFrame, key: str, text: str, path: str, limit: int, hot: int = HOT_PIECES) -> DataFrame:
    """Tokens of each text: the key under its name, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``).

    One row per input row, repeated rows included. A null or empty text has 0 bytes and 0
    tokens. Added strings inside a text count as one token each, as the library has it.
    Other columns are not carried. ``path`` must be readable on the executors.
    """
    spark = df.sparkSession
    pieces = materialize(count_pieces(piece_frequencies(df, text, path), path), "pieces")
    known = spark.sparkContext.broadcast({row["piece"]: row["tokens"] for row in hottest(pieces, hot).select("piece", "tokens").collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, tokens_of = tokenizer_file(path), known.value.get
        for batch in batches:
            keys, texts = batch.columns
            tokens, sizes, cold = [], [], []
            for value in texts:
                content, total, rest = value.as_py() or "", 0, Counter()
                for found, special in file.parts(content):
                    total += special is not None
                    values = list(map(tokens_of, found))
                    if None in values:
                        rest.update(piece for piece, n in zip(found, values) if n is None)
                        total += sum(n for n in values if n is not None)
                    else:
                        total += sum(values)
                tokens.append(total)
                sizes.append(len(content.encode()))
                cold.append(list(rest.items()))
            columns = [keys, pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(cold, pa.map_(pa.string(), pa.int64()))]
            yield pa.record_batch(columns, names)

    names = [key, "n_bytes", "__known", "__cold"]
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, __known long, __cold map<string, bigint>"
    counted = df.select(column(key), column(text).alias("__text")).mapInArrow(run, schema)
    # The row number joins the parts of a row again, whatever its key; written, it cannot change.
    rows = materialize(counted.withColumn("__row", F.monotonically_increasing_id()), "counted")
    cold = rows.select("__row", F.explode("__cold").alias("piece", "times")).join(pieces.select("piece", "tokens"), "piece")
    parts = cold.select("__row", (F.col("times") * F.col("tokens")).alias("__part"))
    sums = parts.groupBy("__row").agg(F.sum("__part").alias("__part"))
    total = F.col("__known") + F.coalesce("__part", F.lit(0))
    joined = rows.select("__row", column(key), "n_bytes", "__known").join(sums, "__row", "left")
    return joined.select(column(key), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
