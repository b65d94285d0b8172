"""Ids of many texts at once, with pre-tokens found, hashed and looked up as arrays.

For texts below U+0250, where a pre-token starts follows from the classes of neighbouring
characters, so a stretch of texts is cut by a few array operations instead of a
pattern. A pre-token's key is a pair of polynomial hashes, read off running
sums; a table with open addressing holds the keys of those met before, and where their characters and ids
lie in one array each. Keys only propose an entry: every character is compared before its ids are
taken. Strings are made only of pre-tokens that are new or whose characters differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from retentia.llm.pretokens import LONG_PIECE, Memo, TokenizerFile, no_collector

LIMIT = 1 << 19
SLOTS = 1 << 20
SEPARATOR = 0xFFFF
LATIN = 0x250
LONG_TEXT = 1 << 18
# Odd multipliers, so that they have inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_SPACE, _LETTER, _NUMBER, _OTHER, _SEPARATOR = range(5)
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    """Class of each character below U+0250, and of the separator."""
    found = np.full(LATIN, _OTHER, np.uint8)
    for code in range(LATIN):
        char = chr(code)
        if char.isalpha():
            found[code] = _LETTER
        elif char.isnumeric():
            found[code] = _NUMBER
        elif char in "\t\n\x0b\x0c\r \x85\xa0":
            found[code] = _SPACE
    return found


CLASSES = _classes()


def piece_starts(codes: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in texts with a separator after each; a separator is a piece of its own."""
    kinds = np.full(len(codes), _SEPARATOR, np.uint8)
    plain = codes < LATIN
    kinds[plain] = CLASSES[codes[plain]]
    first = np.empty(len(codes), bool)
    first[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
    first |= kinds == _SEPARATOR
    space = kinds == _SPACE
    after_blank = np.zeros(len(codes), bool)
    after_blank[1:] = codes[:-1] == ord(" ")
    # A blank before anything else belongs to it; of a run of white space the last one is left for what follows.
    starts = np.where(space, first, first & (~after_blank | (kinds == _SEPARATOR)))
    last = space[:-1] & ~space[1:] & (kinds[1:] != _SEPARATOR)
    starts[:-1] |= last
    for at in np.flatnonzero((codes == ord("'")) & starts).tolist():
        # An apostrophe alone, with certain letters after it, takes these along.
        tail = "".join(map(chr, codes[at + 1 : at + 3].tolist()))
        taken = next((letters for letters in _CONTRACTIONS if tail.startswith(letters)), None)
        if taken:
            starts[at + 1] = False
            stop = at + 1 + len(taken)
            if len(taken) == 2:
                starts[at + 2] = False
            starts[stop] = True
    return np.flatnonzero(starts)


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    """``array`` with room for ``more`` values after the first ``used``."""
    if used + more <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(len(array), more), array.dtype)])


class PieceTable:
    """Remembers the ids of up to ``limit`` pre-tokens; ``encode`` gives those of new ones, and where each begins and ends."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], id_type: np.dtype, limit: int = LIMIT, slots: int = SLOTS):
        self._encode, self._id_type, self._limit, self._slots = encode, id_type, limit, slots
        self._powers: list[tuple[np.ndarray, np.ndarray]] = []
        self._forget()

    def _forget(self) -> None:
        self._keys = np.zeros((2, self._slots), np.uint64)
        self._entry = np.full(self._slots, -1, np.int32)
        self._offset, self._length = np.zeros(self._limit, np.int64), np.zeros(self._limit, np.int32)
        self._pool, self._used, self._count = np.zeros(1 << 20, self._id_type), 0, 0
        # Where the characters of an entry lie, and how many; entries that the table does not hold have none.
        self._at, self._chars = np.zeros(self._limit, np.int32), np.zeros(self._limit, np.int32)
        self._codes, self._held = np.zeros(1 << 20, np.uint16), 0

    def _power(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Powers of the bases and of their inverses."""
        if not self._powers or len(self._powers[0][0]) < n:
            size = 1 << max(18, n.bit_length())
            self._powers = []
            for base in BASES:
                pair = []
                for factor in (base, pow(base, -1, 1 << 64)):
                    factors = np.full(size, factor, np.uint64)
                    factors[0] = 1
                    pair.append(np.cumprod(factors))
                self._powers.append(tuple(pair))
        return self._powers

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, one after the other; all characters must be below U+0250."""
        joined = "￿".join(texts) + "￿"
        codes = np.frombuffer(joined.encode("utf-16-le"), "<u2")
        starts = piece_starts(codes)
        stops = np.append(starts[1:], len(codes))
        ends = codes[starts] == SEPARATOR
        keys = []
        values = codes.astype(np.uint64) + np.uint64(1)
        for power, inverse in self._power(len(codes)):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[: len(codes)])])
            keys.append((sums[stops] - sums[starts]) * inverse[starts])
        entries = np.zeros(len(starts), np.int32)
        real = np.flatnonzero(~ends)
        found, overflow = self._look_up([key[real] for key in keys], joined, codes, starts[real], stops[real])
        entries[real] = found
        lengths = np.where(ends, 0, self._length[entries])
        offsets = self._offset[entries]
        before = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        ids = self._pool[np.repeat(offsets - before, lengths) + np.arange(total)]
        data, width = ids.tobytes(), self._id_type.itemsize
        cuts = np.concatenate([[0], before[ends]]) * width
        blobs = [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        if overflow:
            self._forget()
        return blobs

    def _look_up(self, keys: list[np.ndarray], text: str, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, bool]:
        """Entries of pieces; new ones are added. The second value says that the table is full now."""
        entries = self._probe(keys)
        absent = entries < 0
        entries[self._differ(entries, codes, starts, stops)] = -1
        new = np.flatnonzero(entries < 0)
        if not len(new):
            return entries, False
        numbers: dict[str, int] = {}
        which = [numbers.setdefault(text[a:b], len(numbers)) for a, b in zip(starts[new].tolist(), stops[new].tolist())]
        ids, bounds = self._encode(list(numbers))
        _, firsts = np.unique(which, return_index=True)
        firsts = new[firsts]
        self._pool = _room(self._pool, self._used, len(ids))
        self._pool[self._used : self._used + len(ids)] = ids
        for name in ("_offset", "_length", "_at", "_chars"):
            setattr(self, name, _room(getattr(self, name), self._count, len(firsts)))
        added = np.arange(self._count, self._count + len(firsts), dtype=np.int32)
        self._offset[added], self._length[added] = bounds[:, 0] + self._used, bounds[:, 1] - bounds[:, 0]
        self._used, self._count = self._used + len(ids), self._count + len(firsts)
        entries[new] = added[which]
        full = self._count > self._limit
        if not full:
            # Very long pieces do not come again. Of pieces with one key the table holds the first; the others stay new.
            held = np.flatnonzero(absent[firsts] & (stops[firsts] - starts[firsts] <= LONG_PIECE))
            _, one = np.unique(np.stack([key[firsts[held]] for key in keys]), axis=1, return_index=True)
            held = held[np.sort(one)]
            self._keep(added[held], codes, starts[firsts[held]], stops[firsts[held]])
            self._insert([key[firsts[held]] for key in keys], added[held])
        return entries, full

    def _keep(self, numbers: np.ndarray, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        """Store the characters of entries."""
        sizes = stops - starts
        before, total = np.cumsum(sizes) - sizes, int(sizes.sum())
        self._codes = _room(self._codes, self._held, total)
        self._codes[self._held : self._held + total] = codes[np.repeat(starts - before, sizes) + np.arange(total)]
        self._at[numbers], self._chars[numbers] = self._held + before, sizes
        self._held += total

    def _differ(self, entries: np.ndarray, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Which pieces have an entry of other characters."""
        sizes = (stops - starts).astype(np.int32)
        wrong = (entries >= 0) & (self._chars[entries] != sizes)
        same = np.flatnonzero((entries >= 0) & ~wrong)
        sizes = sizes[same]
        before = np.cumsum(sizes, dtype=np.int32) - sizes
        steps = np.arange(int(sizes.sum()), dtype=np.int32)
        here = codes[np.repeat(starts[same].astype(np.int32) - before, sizes) + steps]
        there = self._codes[np.repeat(self._at[entries[same]] - before, sizes) + steps]
        unlike = np.flatnonzero(here != there)
        wrong[same[np.searchsorted(before, unlike, side="right") - 1]] = True
        return np.flatnonzero(wrong)

    def _probe(self, keys: list[np.ndarray]) -> np.ndarray:
        place = (keys[0] >> np.uint64(20)).astype(np.int64) & (self._slots - 1)
        entries = self._entry[place]
        open_ = np.flatnonzero((entries >= 0) & ((self._keys[0][place] != keys[0]) | (self._keys[1][place] != keys[1])))
        while len(open_):
            place[open_] = (place[open_] + 1) & (self._slots - 1)
            at = place[open_]
            entries[open_] = self._entry[at]
            wrong = (self._entry[at] >= 0) & ((self._keys[0][at] != keys[0][open_]) | (self._keys[1][at] != keys[1][open_]))
            open_ = open_[wrong]
        return entries

    def _insert(self, keys: list[np.ndarray], numbers: np.ndarray) -> None:
        """Put distinct new keys into the first free slot from their own on."""
        place = (keys[0] >> np.uint64(20)).astype(np.int64) & (self._slots - 1)
        left = np.arange(len(numbers))
        while len(left):
            free = left[self._entry[place[left]] < 0]
            slots, which = np.unique(place[free], return_index=True)
            put = free[which]
            self._entry[slots] = numbers[put]
            self._keys[0][slots], self._keys[1][slots] = keys[0][put], keys[1][put]
            waiting = np.ones(len(numbers), bool)
            waiting[put] = False
            left = left[waiting[left]]
            # A slot that another key has just taken is not free any more; go on to the next.
            place[left] = np.where(self._entry[place[left]] >= 0, (place[left] + 1) & (self._slots - 1), place[left])


class TextEncoder:
    """Ids of whole texts: Latin ones through a ``PieceTable``, others, and very long ones, pre-token by pre-token in blocks."""

    def __init__(self, file: TokenizerFile, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], id_type: np.dtype):
        self._file, self._encode, self._id_type = file, encode, id_type
        self._table, self._memo = PieceTable(encode, id_type), Memo(self._fill)

    def _fill(self, pieces: list[str]) -> list[bytes]:
        ids, bounds = self._encode(pieces)
        data = ids.astype(self._id_type).tobytes()
        return [data[start:stop] for start, stop in (bounds * self._id_type.itemsize).tolist()]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, one after the other."""
        latin = [len(text) <= LONG_TEXT and self._file.is_latin(text) for text in texts]
        found = iter(self._table([text for text, plain in zip(texts, latin) if plain]) if any(latin) else ())
        with no_collector():
            return [next(found) if plain else b"".join(self._blocks(text)) for text, plain in zip(texts, latin)]

    def _blocks(self, text: str) -> Iterator[bytes]:
        for pieces, special in self._file.parts(text):
            if pieces:
                yield b"".join(self._memo(pieces))
            if special is not None:
                yield np.array([special], self._id_type).tobytes()
