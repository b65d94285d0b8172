"""Passages that documents repeat, found by seed and extend.

**Seeds.** Of the hashes of k consecutive words that lie in one window of the threshold's length, the least is
the window's anchor (winnowing). What a window selects depends on its words alone, so two equal windows select
the same anchor at the same place, about one place in 18 is an anchor, and documents need only be joined on anchors.

**Extension.** Each window belongs to the one anchor it selects. The windows of an anchor's occurrence reach
from words before it to words after it; this reach is extended as far as any match through the anchor can matter.
Occurrences of one anchor are compared by their reach: where it is the same as in an earlier document, all its words
repeat. Of occurrences that are the first with their reach, while others have another one, the match
ends somewhere inside the reach; only these are compared window by window.

**Maximal repeats.** What is covered by a repeated window is merged into spans that cannot be made longer.

Nothing is compared in pairs: occurrences with one reach, and windows with the same words, meet in one minimum
that is taken in part before any shuffle, however many documents share them. Reaches and windows are told apart
by 128 bits of a BLAKE2b digest of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import column
from retentia.functions.keytable import KeyTable
from retentia.functions.scratch import materialize
from retentia.llm.pretokens import bound_batches, stretches

WORDS = 50
ANCHOR_WORDS = 16
REMEMBERED = 1 << 19
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, of which some are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = WordHashes()


def gram_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each ``length`` consecutive numbers, spread over 64 bits."""
    built, size, done = words, 1, np.zeros(0, np.uint64)
    weight, taken = int(SPREAD), 0
    grams = np.zeros(len(words), np.uint64)
    # By doubling: the hash of 2n words is that of n, moved up, plus that of the next n.
    while True:
        if length & size:
            rest = len(words) - (taken + size) + 1
            if rest <= 0:
                return done
            grams = grams[:rest] * np.uint64(weight) + built[taken : taken + rest]
            taken += size
        if taken == length:
            break
        if len(built) <= size:
            return done
        built = built[:-size] * np.uint64(weight) + built[size:]
        weight, size = weight * weight & (1 << 64) - 1, size * 2
    grams ^= grams >> np.uint64(32)
    grams *= SPREAD
    return grams ^ grams >> np.uint64(29)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` neighbouring values, the last of equals."""
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        best, span = np.where(values[right] <= values[left], right, left), span + step
    return best


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Words:
    """The words of some texts, one after the other, as one string with a blank after each word."""

    def __init__(self, texts: list[bytes | None]):
        split = [(text or b"").split() for text in texts]
        self.sizes = np.array([len(words) for words in split], np.int64)
        self.stops = np.cumsum(self.sizes)
        self.starts = self.stops - self.sizes
        self.words = [word for words in split for word in words]
        self.data = b" ".join(self.words)
        self.offsets = np.cumsum(np.fromiter((0, *(len(word) + 1 for word in self.words)), np.int64, len(self.words) + 1))

    def between(self, first: int, stop: int) -> bytes:
        """Words ``first`` to ``stop`` - 1, with single blanks."""
        return self.data[self.offsets[first] : max(self.offsets[first], self.offsets[stop] - 1)]

    def anchors(self, length: int, anchor_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each anchor: text, hash, and its first and last window."""
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        if len(text) < length:
            nothing = np.zeros(0, np.int64)
            return nothing, nothing.astype(np.uint64), nothing, nothing
        hashes = gram_hashes(np.fromiter(map(_HASHES.__getitem__, self.words), np.uint64, len(self.words)), anchor_words)
        best = least_places(hashes, length - anchor_words + 1)
        windows = np.flatnonzero(text[: len(text) - length + 1] == text[length - 1 :])
        chosen = best[windows]
        turns = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1])) if len(chosen) else np.zeros(0, np.int64)
        first = windows[turns]
        last = np.append(windows[turns[1:] - 1], windows[-1:]) if len(turns) else first
        return text[first], hashes[chosen[turns]], first, last


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _cut(df: DataFrame, length: int, anchor_words: int) -> DataFrame:
    """For each document its key, tie, number of words, and anchors with their reaches."""
    anchor = pa.struct([(name, pa.int64()) for name in ("anchor", "high", "low", "first", "last")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ties, texts = batch.columns
            for low, high in stretches(texts):
                words = Words(texts.slice(low, high - low).cast(pa.binary()).to_pylist())
                text, hashes, first, last = words.anchors(length, anchor_words)
                bounds = zip(first.tolist(), (last + length).tolist())
                reach = _pairs([digest(words.between(a, b)) for a, b in bounds])
                at = words.starts[text]
                parts = [hashes.view(np.int64), reach[:, 0], reach[:, 1], first - at, last - at]
                offsets = np.searchsorted(text, np.arange(len(words.sizes) + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(part) for part in parts], fields=list(anchor))
                columns = [keys.slice(low, high - low), ties.slice(low, high - low), pa.ListArray.from_arrays(offsets, values)]
                yield pa.record_batch(columns, ["key", "tie", "anchors"])

    kind = df.schema["key"].dataType.simpleString()
    struct = "anchor: bigint, high: bigint, low: bigint, first: bigint, last: bigint"
    return df.mapInArrow(run, f"key {kind}, tie bigint, anchors array<struct<{struct}>>")


def _windows(df: DataFrame, length: int) -> DataFrame:
    """The digests of the windows ``asked`` (first and last window of stretches) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ties, texts, asked = batch.columns
            for low, high in stretches(texts):
                words = Words(texts.slice(low, high - low).cast(pa.binary()).to_pylist())
                rows, at, found = [], [], []
                for row, ranges in enumerate(asked.slice(low, high - low).to_pylist()):
                    start = int(words.starts[row])
                    for one in ranges:
                        for place in range(one["first"], one["last"] + 1):
                            rows.append(low + row)
                            at.append(place)
                            found.append(digest(words.between(start + place, start + place + length)))
                reach, picked = _pairs(found), pa.array(rows, pa.int64())
                columns = [keys.take(picked), ties.take(picked), pa.array(reach[:, 0]), pa.array(reach[:, 1]), pa.array(at, pa.int64())]
                yield pa.record_batch(columns, ["key", "tie", "high", "low", "at"])

    kind = df.schema["key"].dataType.simpleString()
    return df.mapInArrow(run, f"key {kind}, tie bigint, high bigint, low bigint, at bigint")


def _with_first(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows that are like one of another document in ``names``, with the smallest key of all like it as ``least``."""
    like = df.groupBy(*names).agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count(F.lit(1)).alias("count"))
    shared = like.filter("least < most").select(F.struct(*names).alias("like"), "least", "count")
    table = KeyTable(materialize(shared, "shared"), "like", stored=True)
    return table.attach(df, F.struct(*names), ["least"]).filter(F.col("least").isNotNull())


def repeated_windows(df: DataFrame, length: int = WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """Stretches ``first`` to ``last`` of windows of ``length`` words that also occur in a document with a smaller key.

    ``df`` has columns key, tie (which tells rows of one key apart) and text.
    """
    cut = materialize(_cut(df, length, anchor_words), "anchors")
    seeds = cut.filter(F.col("key").isNotNull()).select("key", "tie", F.inline("anchors"))
    seeds = materialize(_with_first(seeds, ["anchor"]).drop("least"), "seeds")
    reaches = seeds.groupBy("anchor", "high", "low").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("count"))
    reaches = materialize(reaches, "reaches")
    several = reaches.groupBy("anchor").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1).withColumn("mixed", F.lit(True))
    mixed = KeyTable(materialize(several, "several"), "anchor", stored=True).attach(reaches, F.col("anchor"), ["mixed"])
    mixed = mixed.select(F.struct("anchor", "high", "low").alias("like"), "least", "count", F.coalesce("mixed", F.lit(False)).alias("mixed"))
    placed = KeyTable(materialize(mixed, "mixed"), "like", stored=True).attach(seeds, F.struct("anchor", "high", "low"), ["least", "mixed"])
    placed = materialize(placed.select("key", "tie", "first", "last", "least", "mixed"), "placed")
    whole = placed.filter(F.col("key") > F.col("least")).select("key", "tie", "first", "last")
    asked = placed.filter(F.col("mixed") & (F.col("key") == F.col("least"))).groupBy("key", "tie").agg(F.collect_list(F.struct("first", "last")).alias("asked"))
    wanted = df.join(asked, ["key", "tie"]).select("key", "tie", "text", "asked")
    windows = materialize(_windows(wanted, length), "windows")
    single = _with_first(windows, ["high", "low"]).filter(F.col("key") > F.col("least"))
    return whole.unionByName(single.select("key", "tie", F.col("at").alias("first"), F.col("at").alias("last")))


def drop_repeats(df: DataFrame, key: str, text: str, length: int = WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """Remove from each text what a document with a smaller key has, too, in passages of ``length`` words or more.

    A word goes if it lies in a window of ``length`` consecutive words that also occurs in a document with a smaller key;
    windows are judged on the texts as given. Returns one row per input row: the key under its
    name, ``n_words`` and ``n_removed`` long, ``spans`` (the removed words as an array of structs start and stop, counted from 0, stop not
    included, each as long as can be) and ``kept`` string (the other words with one space between).

    Words end at ASCII white space and are compared byte by byte. A null or empty text has no words. A row with a null key
    is neither earlier nor later than another: it keeps all words, and so do others that repeat only it. Rows with one key do not remove
    words from each other. Other columns are not carried. ``anchor_words`` decides cost, not results, and is at most ``length``.
    """
    if not 1 <= anchor_words <= length:
        raise ValueError("anchor_words must be from 1 to length")
    rows = df.select(column(key).alias("key"), F.xxhash64(column(text)).alias("tie"), column(text).alias("text"))
    found = repeated_windows(bound_batches(rows), length, anchor_words)
    spans = found.groupBy("key", "tie").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    joined = rows.join(materialize(spans, "spans"), ["key", "tie"], "left").select("key", "text", "found")
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, windows = batch.columns
            for low, high in stretches(texts):
                split = [(one or b"").split() for one in texts.slice(low, high - low).cast(pa.binary()).to_pylist()]
                starts, stops, kept, sizes = [], [], [], [0]
                for at, words in enumerate(split):
                    ranges = windows[low + at].values
                    if ranges is not None:
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, ranges.field("first").to_numpy(), 1)
                        np.add.at(change, ranges.field("last").to_numpy() + length, -1)
                        gone = np.cumsum(change[:-1]) > 0
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                        starts.append(edges[::2])
                        stops.append(edges[1::2])
                        words = [word for word, removed in zip(words, gone.tolist()) if not removed]
                    sizes.append(len(starts[-1]) if ranges is not None else 0)
                    kept.append(words)
                ends = [np.concatenate([np.zeros(0, np.int64), *some]) for some in (starts, stops)]
                columns = [
                    keys.slice(low, high - low),
                    pa.array([len(words) for words in split], pa.int64()),
                    pa.array([len(words) - len(left) for words, left in zip(split, kept)], pa.int64()),
                    pa.ListArray.from_arrays(np.cumsum(sizes).astype(np.int32), pa.StructArray.from_arrays([pa.array(end) for end in ends], fields=list(span))),
                    pa.array([b" ".join(words) for words in kept], pa.binary()).cast(pa.string()),
                ]
                yield pa.record_batch(columns, [key, "n_words", "n_removed", "spans", "kept"])

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words bigint, n_removed bigint, spans array<struct<start: bigint, stop: bigint>>, kept string"
    return joined.mapInArrow(run, schema)
