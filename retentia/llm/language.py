"""Language identification with bit-sliced Bloom filters over letter n-grams.

The n-grams of every training word are counted by language. An n-gram is in a language's
filter if the language has it often enough, in itself and beside the language that has it
most often. All languages' filters have the same size and hash functions and lie side
by side: position p holds a mask with one bit per language. So the AND of the masks at an
n-gram's positions names all the languages that contain it at once. A text's n-grams
give one popcount per language, from which the expected false positives are taken; the largest
decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.functions.columns import column
from retentia.functions.scratch import materialize
from retentia.llm.pretokens import bound_batches, light, no_collector, stretches

LEAST_SHARE = 1e-5
LEAST_RATIO = 0.1
BITS_PER_ENTRY = 12
HASHES = 5
HELD_WORDS = 1 << 19
PIECE_CHARS = 1 << 18
UNKNOWN = "und"
BLANK = ord(" ")
CODE_BITS = 21
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    found = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    # The pattern takes numbers such as fractions for letters.
    return "".join(char if char.isalpha() else " " for char in text.lower()).split()


def ngrams(word: str) -> Iterator[str]:
    """Pairs and triples of characters of a word with a blank before and after it; triples have a letter in the middle."""
    marked = f" {word} "
    yield from map("".join, zip(marked, marked[1:]))
    yield from map("".join, zip(marked, marked[1:], marked[2:]))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point, or a blank for those that are no letters."""
    codes = np.arange(0x110000, dtype=np.uint32)
    return np.where(np.fromiter(map(str.isalpha, map(chr, range(len(codes)))), bool, len(codes)), codes, np.uint32(BLANK))


def _codes(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.uint64)


def _hashed(packed: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = packed * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _pairs(codes: np.ndarray) -> np.ndarray:
    return codes[:-1] | codes[1:] << np.uint64(CODE_BITS)


def _triples(codes: np.ndarray) -> np.ndarray:
    return _pairs(codes)[:-1] | codes[2:] << np.uint64(2 * CODE_BITS)


@dataclass
class LanguageFilters:
    """Filters of all languages: ``masks`` has a row of words per position, bit i of word j for language 64 j + i.

    The number of positions is a power of two. With few languages a row is one narrow word.
    """

    languages: list[str]
    masks: np.ndarray

    @classmethod
    def build(cls, languages: list[str], entries: list[tuple[str, list[int]]]) -> LanguageFilters:
        """``entries`` has pairs and triples of characters and the numbers of the languages that contain them."""
        most = int(np.bincount([x for _, numbers in entries for x in numbers], minlength=1).max(initial=1))
        masks = np.zeros((1 << (most * BITS_PER_ENTRY).bit_length(), -(-max(1, len(languages)) // 64)), np.uint64)
        grams = [gram for gram, numbers in entries for _ in numbers]
        numbers = np.array([x for _, numbers in entries for x in numbers], np.int64)
        packed = np.array([sum(ord(char) << CODE_BITS * at for at, char in enumerate(gram)) for gram in grams], np.uint64)
        for places in cls._places(packed, len(masks)):
            np.bitwise_or.at(masks, (places, numbers // 64), np.uint64(1) << (numbers % 64).astype(np.uint64))
        return cls(languages, masks.astype(np.uint8) if len(languages) <= 8 else masks)

    @staticmethod
    def _places(packed: np.ndarray, size: int) -> Iterator[np.ndarray]:
        hashed = _hashed(packed)
        place, step = hashed >> np.uint64(32), hashed & np.uint64(0xFFFFFFFF) | np.uint64(1)
        for _ in range(HASHES):
            yield (place & np.uint64(size - 1)).astype(np.int64)
            place = place + step

    def containing(self, packed: np.ndarray) -> np.ndarray:
        """Per n-gram, the mask of all languages whose filters contain it."""
        places = self._places(packed, len(self.masks))
        masks = self.masks[next(places)]
        for more in places:
            masks &= self.masks[more]
        return masks

    def false_rates(self) -> np.ndarray:
        """Chance of each language to claim an n-gram that it does not contain."""
        return np.array([self._bit(self.masks, at).mean() for at in range(len(self.languages))]) ** HASHES

    def _bit(self, masks: np.ndarray, language: int) -> np.ndarray:
        word = masks[:, language // 64]
        return (word >> word.dtype.type(language % 64)) & word.dtype.type(1)

    def _count(self, codes: np.ndarray, starts: np.ndarray, skip: int = 0) -> np.ndarray:
        """Per stretch of windows from ``starts``, the n-grams and those that each language contains.

        ``codes`` begin and end with a blank or a neighbouring letter; the first ``skip`` pairs do not count.
        """
        letter = codes != BLANK
        pair, triple = letter[:-1] | letter[1:], letter[1:-1].copy()
        pair[:skip] = False
        total = np.zeros((len(starts), len(self.languages) + 1), np.int64)
        for packed, valid in ((_pairs(codes), pair), (_triples(codes), triple)):
            # A last stretch without a window of this length has nothing to add.
            inside = starts < len(valid)
            at = starts[inside]
            masks = self.containing(packed)
            total[inside, 0] += np.add.reduceat(valid, at, dtype=np.int64)
            for language in range(len(self.languages)):
                total[inside, language + 1] += np.add.reduceat(self._bit(masks, language) * valid, at, dtype=np.int64)
        return total

    def counts(self, texts: list[str]) -> np.ndarray:
        """Per text, its number of n-grams and those that each language's filter contains.

        Short texts are counted together, a long one in pieces: memory follows ``PIECE_CHARS``, not the text.
        """
        total = np.zeros((len(texts), len(self.languages) + 1), np.int64)
        lowered = [text.lower() for text in texts]
        held: list[int] = []
        size = 0
        for at, text in enumerate(lowered):
            if len(text) > PIECE_CHARS:
                marked = f" {text} "
                for start in range(0, len(text), PIECE_CHARS):
                    codes = _codes(marked[start : start + PIECE_CHARS + 2])
                    total[at] += self._count(codes, np.zeros(1, np.int64), skip=min(start, 1))[0]
                continue
            held.append(at)
            size += len(text)
            if size > PIECE_CHARS:
                total[held] = self._together([lowered[x] for x in held])
                held, size = [], 0
        if held:
            total[held] = self._together([lowered[x] for x in held])
        return total

    def _together(self, texts: list[str]) -> np.ndarray:
        """Two blanks keep neighbouring texts apart: no n-gram with a letter holds both."""
        starts = np.cumsum([0, *(len(text) + 2 for text in texts[:-1])])
        return self._count(_codes(" " + "  ".join(texts) + " "), starts)


def word_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang``, ``word`` and ``n``, its occurrences in the texts of that language; partial counts leave each task."""

    def rows(counts: Counter) -> pa.RecordBatch:
        found = list(counts)
        columns = [[lang for lang, _ in found], [word for _, word in found], [counts[x] for x in found]]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_language: dict[str, Counter] = {}
        for batch in batches:
            with no_collector():
                for value, name in zip(*(c.to_pylist() for c in batch.columns)):
                    by_language.setdefault(name, Counter()).update(words_of(value))
            if sum(map(len, by_language.values())) > HELD_WORDS:
                yield rows(Counter({(name, word): n for name, counts in by_language.items() for word, n in counts.items()}))
                by_language = {}
        yield rows(Counter({(name, word): n for name, counts in by_language.items() for word, n in counts.items()}))

    chosen = bound_batches(df).filter(column(lang).isNotNull() & column(text).isNotNull()).select(column(text).alias("text"), column(lang).alias("lang"))
    return chosen.mapInArrow(light(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``n`` from the counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for name, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for gram in ngrams(word):
                    counts[name, gram] += n
            found = list(counts)
            columns = [[name for name, _ in found], [gram for _, gram in found], [counts[x] for x in found]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])

    return words.select("lang", "word", "n").mapInArrow(light(run), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: str, lang: str) -> LanguageFilters:
    """Filters learned from all rows with a text and a language.

    An n-gram belongs to a language if it is at least ``LEAST_SHARE`` of the language's n-grams,
    which bounds a filter at 1 / ``LEAST_SHARE`` entries whatever the corpus, and at least ``LEAST_RATIO``
    times its largest share in any language. Only these entries reach the driver. No rows give no languages.
    """
    grams = materialize(gram_counts(word_counts(df, text, lang)), "grams")
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = grams.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    # One row per language: a share that is large enough leaves at most 1 / LEAST_SHARE of them each.
    frequent = shares.filter(F.col("share") >= LEAST_SHARE)
    sets = frequent.groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("found"))
    top = F.array_max(F.transform("found", lambda x: x["share"]))
    chosen = F.filter("found", lambda x: x["share"] >= top * LEAST_RATIO)
    rows = sets.select("gram", F.transform(chosen, lambda x: x["lang"]).alias("langs")).collect()
    languages = sorted(row["lang"] for row in totals.select("lang").collect())
    number = {name: at for at, name in enumerate(languages)}
    return LanguageFilters.build(languages, [(row["gram"], [number[name] for name in row["langs"]]) for row in rows])


def predict(df: DataFrame, text: str, filters: LanguageFilters, columns: Sequence[str]) -> DataFrame:
    """``columns`` of ``df``, ``lang_pred`` and ``score`` of each row; no shuffle.

    The score is the share of the text's n-grams that the language claims, less the expected false
    positives. Ties go to the first language. A null text, one without letters, or no learned
    language gives ``und`` and 0. A column with the name of a new one is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        false = model.false_rates()
        for batch in batches:
            texts = batch.column(len(carried))
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for start, stop in stretches(texts):
                if not model.languages:
                    break
                total = model.counts([text or "" for text in texts.slice(start, stop - start).to_pylist()])
                full = np.flatnonzero(total[:, 0])
                total = total[full]
                right = (total[:, 1:] - total[:, :1] * false) / (total[:, :1] * (1 - false))
                best = right.argmax(axis=1)
                for at, language in zip(full.tolist(), best.tolist()):
                    names[start + at] = model.languages[language]
                scores[start + full] = np.clip(right[np.arange(len(full)), best], 0, 1)
            added = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.record_batch([*batch.columns[: len(carried)], *added], [*carried, "lang_pred", "score"])

    carried = [name for name in columns if name not in ("lang_pred", "score")]
    fields = [df.schema[name] for name in carried]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return bound_batches(df).select(*map(column, carried), column(text).alias("__text")).mapInArrow(light(run), schema)


def held_out(key: str, folds: int = 5) -> Column:
    """Whether the CRC-32 of the key as text is divisible by ``folds``; a null key is held out."""
    return F.coalesce(F.crc32(column(key).cast("string")) % folds == 0, F.lit(True))


def identify(df: DataFrame, key: str, text: str, lang: str, columns: Sequence[str], folds: int = 5) -> DataFrame:
    """``columns`` of ``df``, with the language of each row predicted by filters that the rows not held out have taught."""
    return predict(df, text, fit(df.filter(~held_out(key, folds)), text, lang), columns)
