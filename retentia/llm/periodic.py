"""Periodic runs in texts by Kruskal's union of suffix classes in order of falling LCP.

A run is a longest stretch of words that are the same ``q`` words apart, q its smallest period. Suffixes of
a text are sorted, and the suffixes next to each other in that order are the edges of a path, as heavy as
their longest common prefix (LCP). Uniting classes along the heaviest edges first, a union at
weight L makes the class of suffixes that agree on L words. Each class keeps its positions
in order; positions i and i + d that a union has just made neighbours have LCP L exactly, and seed, where
L reaches d, a stretch of L + d words with period d. No smaller period is missed, as i and its shift by
that period would have been neighbours before; so the seed that cannot be moved to the left is the run,
once, with its smallest period.

Only edges that a long enough run can have are united, and only texts that repeat that many words at all
are sorted: equal stretches have equal hashes, so a text whose hashes differ repeats nothing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import column
from retentia.llm.pretokens import bound_batches, stretches

LEAST_LENGTH = 24
LEAST_EXPONENT = 3
BLOCK = 1_024
BASE = np.uint64(0x9E3779B97F4A7C15)
Run = tuple[int, int, int]


class Positions:
    """Positions in order, in blocks, so that one more costs little in a class of any size."""

    __slots__ = ("_blocks", "_firsts", "size")

    def __init__(self, position: int):
        self._blocks, self._firsts, self.size = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        for block in self._blocks:
            yield from block

    def add(self, position: int) -> None:
        at = max(0, bisect_right(self._firsts, position) - 1)
        block = self._blocks[at]
        insort(block, position)
        self._firsts[at], self.size = block[0], self.size + 1
        if len(block) > 2 * BLOCK:
            self._blocks[at : at + 1] = [block[:BLOCK], block[BLOCK:]]
            self._firsts.insert(at + 1, block[BLOCK])

    def around(self, position: int) -> tuple[int | None, int | None]:
        """The neighbours of a position that is in the class."""
        at = bisect_right(self._firsts, position) - 1
        block = self._blocks[at]
        place = bisect_left(block, position)
        before = block[place - 1] if place else self._blocks[at - 1][-1] if at else None
        after = block[place + 1] if place + 1 < len(block) else self._blocks[at + 1][0] if at + 1 < len(self._blocks) else None
        return before, after


def suffix_edges(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring suffixes with an LCP of ``least`` or more, heaviest first: both positions and the LCP.

    By prefix doubling; only suffixes that still tie are sorted again. ``words`` must end with a
    number that occurs nowhere else. Ranks of all rounds are kept, and an LCP is the sum of the rounds that agree.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    firsts = np.concatenate([[True], words[order][1:] != words[order][:-1]])
    slots, rounds, step = np.arange(n), [], 1
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(firsts, slots, 0))
    while True:
        rounds.append(rank)
        tied = np.flatnonzero(~(firsts & np.append(firsts[1:], True)))
        if not len(tied):
            break
        positions = order[tied]
        keys = rank[positions].astype(np.int64) * n + rank[positions + step]
        inner = np.argsort(keys, kind="stable")
        order[tied], keys = positions[inner], keys[inner]
        firsts[tied] = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank = rank.copy()
        rank[order[tied]] = np.maximum.accumulate(np.where(firsts[tied], tied, 0))
        step *= 2
    left, right = order[:-1], order[1:]
    # The round that has compared ``least`` words or fewer tells the few pairs worth measuring.
    enough = rounds[min(len(rounds), least.bit_length()) - 1]
    near = np.flatnonzero(enough[left] == enough[right])
    left, right = left[near].copy(), right[near].copy()
    first, second, common = left.copy(), right.copy(), np.zeros(len(near), np.int64)
    for at in range(len(rounds) - 1, -1, -1):
        same = (rounds[at][first] == rounds[at][second]).astype(np.int64) << at
        first, second, common = first + same, second + same, common + same
    kept = np.flatnonzero(common >= least)
    kept = kept[np.argsort(-common[kept], kind="stable")]
    return left[kept], right[kept], common[kept]


def runs_of(words: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[Run]:
    """``(start, length, period)`` of every run, by start, then period.

    ``words`` holds numbers of words; it starts and ends with a number that no other place has, and may hold more of
    these to part texts.
    """
    least = -(-least_length * (least_exponent - 1) // least_exponent)
    edges = suffix_edges(words, max(1, least))
    parent: dict[int, int] = {}
    classes: dict[int, Positions] = {}

    def root(position: int) -> int:
        if position not in parent:
            parent[position], classes[position] = position, Positions(position)
        while (above := parent[position]) != position:
            parent[position] = position = parent[above]
        return position

    found, values = [], words.tolist()
    for left, right, common in zip(*(edge.tolist() for edge in edges)):
        large, small = root(left), root(right)
        if classes[large].size < classes[small].size:
            large, small = small, large
        into, moved = classes[large], list(classes.pop(small))
        parent[small] = large
        for position in moved:
            into.add(position)
        own = set(moved)
        for position in moved:
            before, after = into.around(position)
            for low, high in ((before, position), (position, after)):
                if low is None or high is None or (low in own and high in own):
                    continue
                period = high - low
                if (least_exponent - 1) * period <= common and common + period >= least_length and values[low - 1] != values[high - 1]:
                    found.append((low, common + period, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _repeating(words: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Texts, among some put one after the other, that may hold ``least`` equal words in two places."""
    n = len(words) - least + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    powers = np.full(len(words), BASE)
    powers[0] = 1
    powers = np.cumprod(powers)
    inverse = np.full(len(words), np.uint64(pow(int(BASE), -1, 1 << 64)))
    inverse[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((words.astype(np.uint64) + np.uint64(1)) * powers)])
    hashes = (sums[least:] - sums[:-least]) * np.cumprod(inverse)[:n]
    text = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.flatnonzero(text[:n] == text[least - 1 :])
    hashes = hashes[whole] ^ (text[whole].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(hashes)
    again = np.flatnonzero(hashes[order][1:] == hashes[order][:-1]) + 1
    return np.unique(text[whole[order[again]]])


def text_runs(texts: list[list[bytes]], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[list[Run]]:
    """The runs of each text, which is given by its words."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(text) for text in texts], np.int64)
    words = np.fromiter((numbers[word] for text in texts for word in text), np.int64, int(sizes.sum()))
    found: list[list[Run]] = [[] for _ in texts]
    ends, border = np.cumsum(sizes), len(numbers)
    picked = _repeating(words, sizes, max(1, -(-least_length * (least_exponent - 1) // least_exponent)))
    if not len(picked):
        return found
    # Every text has numbers of its own, a border after it, and none of its suffixes meets another's.
    parts, starts, at = [np.array([-1])], [], 1
    for turn, text in enumerate(picked.tolist()):
        parts.append(words[ends[text] - sizes[text] : ends[text]] + turn * (border + 1))
        parts.append(np.array([turn * (border + 1) + border]))
        starts.append(at)
        at += int(sizes[text]) + 1
    for start, length, period in runs_of(np.concatenate(parts), least_length, least_exponent):
        turn = bisect_right(starts, start) - 1
        found[int(picked[turn])].append((start - starts[turn], length, period))
    return found


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    kept = np.cumsum(dropped[:-1]) == 0
    return [word for word, keep in zip(words, kept.tolist()) if keep]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period; of equals the first, then that with the smallest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(
    df: DataFrame, key: str, text: Column, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT
) -> DataFrame:
    """Runs of at least ``least_length`` words and ``least_exponent`` periods in every text.

    Returns one row per input row: the key under its name, ``n_words`` long, ``runs`` (an array of structs start, length
    and period, counted in words from 0, by start, then period), ``strongest`` (the run with the greatest
    length / period; ties to the smallest start, then period; null without a run) and
    ``collapsed`` string: the words that no run holds after its first period, with one space between.

    Words end at ASCII white space and are compared byte by byte. A null or empty text has no words, no runs and an empty
    ``collapsed``. Repeated rows give repeated results; a null key is carried; other columns of the input are not. No
    shuffle. Texts are read whole: one of n words takes memory in proportion to n times the logarithm of its longest repeat,
    and about n log² n steps, however often it repeats itself.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def structs(runs: list[Run]) -> pa.Array:
        columns = np.array(runs, np.int64).reshape(-1, 3).T
        return pa.StructArray.from_arrays([pa.array(values) for values in columns], fields=list(run_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.columns
            for low, high in stretches(texts):
                words = [(one or b"").split() for one in texts.slice(low, high - low).cast(pa.binary()).to_pylist()]
                found = text_runs(words, least_length, least_exponent)
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                best = [strongest(runs) for runs in found]
                places = np.cumsum([one is not None for one in best]) - 1
                columns = [
                    keys.slice(low, high - low),
                    pa.array([len(one) for one in words], pa.int64()),
                    pa.ListArray.from_arrays(offsets, structs([one for runs in found for one in runs])),
                    structs([one for one in best if one]).take(pa.array([p if one else None for p, one in zip(places.tolist(), best)], pa.int64())),
                    pa.array([b" ".join(collapse(*pair)) for pair in zip(words, found)], pa.binary()).cast(pa.string()),
                ]
                yield pa.record_batch(columns, [key, "n_words", "runs", "strongest", "collapsed"])

    struct = "struct<start: bigint, length: bigint, period: bigint>"
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_words bigint, runs array<{struct}>, strongest {struct}, collapsed string"
    return bound_batches(df).select(column(key), text.alias("__text")).mapInArrow(run, schema)


def with_planted_period(key: Column, text: Column) -> Column:
    """A text that, for about every tenth key, goes on as a repetition from one of its words on.

    With h the CRC-32 of the key in decimal, g = floor(h / 10) and n words: where h is divisible by 10 and n > 0, word i >= a
    becomes word a + (i - a) mod p, a = g mod n, p = 1 + floor((n - a) / (3 + g mod 8)). Other texts stay as they are.
    """
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # The array of one array gives the words a name, so that they are cut once.
    rebuilt = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit("")))[0]
    return F.when((h % 10 == 0) & text.isNotNull(), rebuilt).otherwise(text)
