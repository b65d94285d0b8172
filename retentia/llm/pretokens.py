"""Tokenizer files with byte-level BPE, and the pre-tokens they cut a text into.

Merges never cross a pre-token, so a text's tokens are those of its pre-tokens in
order, and a pre-token is worth encoding only once.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import lru_cache
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

# Spark runs as many tasks as there are cores; threads of the library's own would only take memory.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The pre-token pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BLOCK_CHARS = 1 << 16
STRETCH_BYTES = 1 << 18
BATCH_BYTES = 8 << 20
MEMO_PIECES = 5 << 15
LONG_PIECE = 64
_FULL = regex.compile(PATTERN)
# The same pattern for texts below U+0250, where the classes are short enough to spell out; ``re`` is faster.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_LATIN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_NOT_LATIN = re.compile("[ɐ-\U0010ffff]")
_BREAK = regex.compile(r"\S(?=\s)")
_HIGH = regex.compile("[Ԁ-\U0010ffff]")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(byte if byte in printable else next(spare)) for byte in range(256)]


class TokenizerFile:
    """A ``tokenizers`` JSON file with a byte-level BPE model and no normalizer.

    ``tokens`` holds the bytes of each id, ``merges`` the merge list as pairs of
    ids in order of rank, ``specials`` the added strings that are cut out of a text first.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, cutter = content["model"], content["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and cutter.get("type") == "ByteLevel" and not cutter["add_prefix_space"]
        odd = content["normalizer"] or model.get("dropout") or model.get("ignore_merges") or not cutter.get("use_regex", True)
        awkward = [t for t in content["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if not plain or odd or awkward:
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        self.path = path
        of_char = {char: byte for byte, char in enumerate(byte_alphabet())}
        self.specials = {token["content"]: token["id"] for token in content["added_tokens"]}
        vocabulary = model["vocab"] | self.specials
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for text, number in vocabulary.items():
            known = all(char in of_char for char in text)
            self.tokens[number] = bytes(of_char[char] for char in text) if known else text.encode()
        self.lengths = np.array([len(token) for token in self.tokens], np.int64)
        self.byte_ids = [model["vocab"][char] for char in byte_alphabet()]
        pairs = [merge.split(" ") if isinstance(merge, str) else merge for merge in model["merges"]]
        self.merges = [(model["vocab"][left], model["vocab"][right], model["vocab"][left + right]) for left, right in pairs]
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self._seen: set[str] = set()
        self._other: set[str] = set()
        self._exact = _FULL

    def parts(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Lists of pre-tokens, in order; each list may be followed by the id of an added string.

        Lists cover about ``BLOCK_CHARS`` characters, however long the text.
        """
        start = 0
        if self._special is not None:
            for found in self._special.finditer(text):
                yield from ((pieces, None) for pieces in self._blocks(text[start : found.start()]))
                yield [], self.specials[found.group()]
                start = found.end()
        yield from ((pieces, None) for pieces in self._blocks(text[start:] if start else text))

    def is_latin(self, text: str) -> bool:
        """Whether a text has only characters below U+0250 and none of the added strings."""
        return not _NOT_LATIN.search(text) and not any(special in text for special in self.specials)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens by the library, one after the other, and where those of each piece begin and end.

        A line break between them keeps pre-tokens apart that are not white space themselves, and
        is one id; so the library gets one text instead of very many.
        """
        order = sorted(range(len(pieces)), key=lambda at: pieces[at].isspace())
        plain = sum(not piece.isspace() for piece in pieces)
        texts = ["\n".join(pieces[at] for at in order[:plain]), *(pieces[at] for at in order[plain:])]
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.array([number for one in found for number in one.ids], np.uint32)
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        sizes = np.array([len(pieces[at].encode()) for at in order], np.int64)
        gaps = np.arange(len(order)) < plain - 1
        stops = np.cumsum(sizes + gaps) - gaps
        bounds = np.empty((len(order), 2), np.int64)
        bounds[order] = np.searchsorted(ends, np.stack([stops - sizes, stops], axis=1))
        return ids, bounds

    def _blocks(self, text: str) -> Iterator[list[str]]:
        pattern, at = self._pattern(text), 0
        # No pre-token holds a white space after another character, so blocks may end there.
        while len(text) - at > BLOCK_CHARS and (found := _BREAK.search(text, at + BLOCK_CHARS)):
            yield pattern.findall(text[at : found.end()])
            at = found.end()
        if at < len(text):
            yield pattern.findall(text[at:] if at else text)

    def _pattern(self, text: str) -> re.Pattern | regex.Pattern:
        """The pattern with the library's character classes, which follow another Unicode version than ``regex``."""
        if not _NOT_LATIN.search(text):
            return _LATIN
        new = set(_HIGH.findall(text)) - self._seen
        if new:
            self._seen |= new
            cut = self.library.pre_tokenizer.pre_tokenize_str
            odd = {char for char in new if [span for _, span in cut(f"a{char}1{char}")] != [m.span() for m in _FULL.finditer(f"a{char}1{char}")]}
            if odd:
                self._other |= odd
                others = "[" + "".join(map(regex.escape, sorted(self._other))) + "]"
                letters, numbers = rf"[\p{{L}}--{others}]", rf"[\p{{N}}--{others}]"
                exact = PATTERN.replace(r"[^\s\p{L}\p{N}]", "@").replace(r"\p{L}", letters).replace(r"\p{N}", numbers)
                self._exact = regex.compile(exact.replace("@", rf"(?:[^\s\p{{L}}\p{{N}}]|{others})"), regex.V1)
        return self._exact


class Memo:
    """Remembers what a function gives for a pre-token.

    Holds two generations of ``limit`` pre-tokens at most; what is met again moves to the
    younger one, and the older one is forgotten when the younger is full. Worker processes serve
    one stage after another: of memos with the full limit, only the one used last holds anything.
    """

    _holder: ClassVar[Memo | None] = None

    def __init__(self, fill: Callable[[list[str]], list], limit: int = MEMO_PIECES):
        self._fill, self._limit, self._young, self._old = fill, limit, {}, {}

    def __call__(self, pieces: list[str]) -> list:
        """Values of the pieces in order; those not known are computed in one call."""
        if Memo._holder is not self and self._limit >= MEMO_PIECES:
            if Memo._holder is not None:
                Memo._holder._young, Memo._holder._old = {}, {}
            Memo._holder = self
        values = list(map(self._young.get, pieces))
        if None in values:
            missing = {piece: self._old.get(piece) for piece, value in zip(pieces, values) if value is None}
            new = [piece for piece, value in missing.items() if value is None]
            if new:
                missing.update(zip(new, self._fill(new)))
            values = [missing[piece] if value is None else value for piece, value in zip(pieces, values)]
            if len(self._young) + len(missing) > self._limit:
                self._young, self._old = {}, self._young
            # Very long pieces do not come again, and would make the memo large.
            self._young.update((piece, value) for piece, value in missing.items() if len(piece) <= LONG_PIECE)
        return values


def stretches(texts: pa.Array, size: int = STRETCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes of text each."""
    sizes = np.nan_to_num(np.asarray(pc.binary_length(texts), float)).astype(np.int64)
    group, start = (np.cumsum(sizes) - sizes) // size, 0
    for stop in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]:
        if stop > start:
            yield start, stop
        start = stop


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, after telling its session to cut the batches it hands to Python by bytes: texts may be of any length."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


@contextmanager
def no_collector() -> Iterator[None]:
    """Pauses the cycle collector, which would walk through the memo again and again; nothing inside makes cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_KEPT: list = []


def kept(size: int) -> Callable[[Callable], Callable]:
    """``lru_cache`` for what a process holds of tokenizer files, until ``forget``."""

    def wrap(function: Callable) -> Callable:
        _KEPT.append(lru_cache(maxsize=size)(function))
        return _KEPT[-1]

    return wrap


def forget() -> None:
    """Drops the tokenizer files and memos of pre-tokens that earlier tasks left in this process."""
    if any(cached.cache_info().currsize for cached in _KEPT):
        for cached in _KEPT:
            cached.cache_clear()
        Memo._holder = None
        gc.collect()


def give_back() -> None:
    """Returns free memory to the system; Arrow and the C library would keep it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def light(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], tokenizer: bool = False) -> Callable:
    """A function of batches that leaves little in its process, nor finds much there.

    Worker processes serve one stage after another, and idle ones count, too. Unless ``run`` needs a ``tokenizer``, those of earlier
    stages are dropped first.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tokenizer:
            forget()
        give_back()
        yield from run(batches)
        give_back()

    return wrapped


def light_group(search: Callable[[tuple, pa.Table], pa.Table]) -> Callable:
    """The same for a function of a group."""

    def wrapped(key: tuple, table: pa.Table) -> pa.Table:
        forget()
        found = search(key, table)
        give_back()
        return found

    return wrapped


@kept(4)
def tokenizer_file(path: str) -> TokenizerFile:
    """The file, read once per process."""
    return TokenizerFile(path)
