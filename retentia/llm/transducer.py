"""BPE encoding with bounded lookahead, and decoding byte by byte.

Two texts that agree on their first n bytes agree on all token boundaries up to
n - L, where L depends on the merge list alone. So an encoder that holds a few
times L bytes can emit the tokens before n - L for good, whatever follows, and
needs no more memory for a pre-token of a megabyte than for a word.

**The sufficient lookahead.** Apply the merges in order of rank to both texts and
call d the last boundary up to which they agree; at first d = n. A merge inside
the common part happens in both. Only a merge (u, v) across d, in one text but not
in the other, moves d, and by the length of u. The next merge (u', v') that moves
it must then have a v' that starts with u, i.e. u is reached from v' by taking left
halves, and a higher rank. L is the heaviest such chain, its weight being the
lengths of the u. One pass over the merge list in order of rank finds it.

**Decoding** joins the bytes of the ids and turns them into text as they come; the
state between two calls is at most three bytes of an unfinished character. Bytes
that are not UTF-8 become U+FFFD, one for each maximal invalid part.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import column
from retentia.llm.piece_table import TextEncoder
from retentia.llm.pretokens import TokenizerFile, bound_batches, kept, light, stretches, tokenizer_file

ID_TYPE = np.dtype("<u4")
BATCH_BYTES = 4 << 20
DECODE_IDS = 1 << 16
SHORT = 48
WINDOWS = 8
NO_RULE = 1 << 60


def sufficient_lookahead(merges: Iterable[tuple[int, int, int]], lengths: dict[int, int] | list[int]) -> int:
    """Bytes after a position that settle the token boundaries up to it.

    ``merges`` are (left, right, result) in order of rank, each token the result of one merge at most.
    """
    left_half: dict[int, int] = {}
    heaviest: dict[int, int] = {}
    for left, right, result in merges:
        if result in left_half:
            raise ValueError("two merges give the same token")
        before, token = heaviest.get(right, 0), right
        while (token := left_half.get(token, -1)) >= 0:
            before = max(before, heaviest.get(token, 0))
        heaviest[left] = max(heaviest.get(left, 0), before + lengths[left])
        left_half[result] = left
    return max(heaviest.values(), default=0)


class Transducer:
    """Encodes pre-tokens with a merge list in constant memory.

    ``byte_ids`` gives the id of each byte, ``lengths`` the bytes of each id.
    """

    def __init__(self, merges: list[tuple[int, int, int]], byte_ids: list[int], lengths: list[int]):
        self.lookahead = sufficient_lookahead(merges, lengths)
        self._byte_ids, self._lengths = byte_ids, lengths
        self._ranks = {(left, right): rank for rank, (left, right, _) in enumerate(merges)}
        self._results = [result for _, _, result in merges]

    @classmethod
    def of(cls, file: TokenizerFile) -> Transducer:
        return cls(file.merges, file.byte_ids, list(map(len, file.tokens)))

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one whole pre-token."""
        if len(piece) <= SHORT:
            return self._merge_few([self._byte_ids[byte] for byte in piece])
        return list(self.stream([piece]))

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token that arrives in chunks, each given out once nothing can change it."""
        window, held = self.lookahead * WINDOWS + SHORT, b""
        for chunk in chunks:
            for at in range(0, len(chunk), window):
                held += chunk[at : at + window]
                if len(held) >= window:
                    stable, end = len(held) - self.lookahead, 0
                    for token in self._merge_many(held):
                        if end + self._lengths[token] > stable:
                            break
                        end += self._lengths[token]
                        yield token
                    held = held[end:]
        yield from self._merge_many(held)

    def _merge_few(self, ids: list[int]) -> list[int]:
        """Merges the pair of lowest rank, the leftmost of equals, until none is left."""
        rank_of, results = self._ranks.get, self._results
        ranks = [rank_of(pair, NO_RULE) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < NO_RULE:
            at = ranks.index(best)
            ids[at : at + 2] = [results[best]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of((ids[at], ids[at + 1]), NO_RULE)
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], ids[at]), NO_RULE)
        return ids

    def _merge_many(self, data: bytes) -> list[int]:
        """The same for longer input: pairs wait in a heap by rank and place, tokens in a linked list."""
        ranks = self._ranks
        ids: list[int | None] = [self._byte_ids[byte] for byte in data]
        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))
        heap = [(rank, at) for at, pair in enumerate(zip(ids, ids[1:])) if (rank := ranks.get(pair)) is not None]
        heapify(heap)
        while heap:
            rank, at = heappop(heap)
            follower = after[at]
            # The pair may be gone, or another one by now.
            if ids[at] is None or follower >= len(ids) or ranks.get((ids[at], ids[follower])) != rank:
                continue
            ids[at], ids[follower] = self._results[rank], None
            after[at] = beyond = after[follower]
            if beyond < len(ids):
                before[beyond] = at
                if (rank := ranks.get((ids[at], ids[beyond]))) is not None:
                    heappush(heap, (rank, at))
            if (previous := before[at]) >= 0 and (rank := ranks.get((ids[previous], ids[at]))) is not None:
                heappush(heap, (rank, previous))
        return [token for token in ids if token is not None]


class Detokenizer:
    """Text of a stream of ids; ``feed`` returns what is certain so far, ``close`` the rest."""

    def __init__(self, tokens: list[bytes]):
        self._tokens = tokens
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self._state.decode(b"".join(map(self._tokens.__getitem__, ids)))

    def close(self) -> str:
        return self._state.decode(b"", final=True)


class Codec:
    """A tokenizer file's transducer with a memory of the pre-tokens met before."""

    def __init__(self, path: str):
        self.file = tokenizer_file(path)
        self.transducer = Transducer.of(self.file)
        self.encode = TextEncoder(self.file, self._pieces, ID_TYPE)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.transducer.encode(piece.encode()) for piece in pieces]
        ends = np.cumsum([0, *map(len, found)])
        return np.array([number for ids in found for number in ids], ID_TYPE), np.column_stack([ends[:-1], ends[1:]])

    def decode(self, blob: bytes) -> str:
        """Text of ids, taken some at a time."""
        state, step = Detokenizer(self.file.tokens), DECODE_IDS * ID_TYPE.itemsize
        parts = [state.feed(np.frombuffer(blob[at : at + step], ID_TYPE).tolist()) for at in range(0, len(blob), step)]
        return "".join([*parts, state.close()])


@kept(4)
def _codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(df: DataFrame, key: str, text: str, path: str, as_arrays: bool = False) -> DataFrame:
    """Encode each text and decode its ids again.

    Returns one row per input row: the key under its name, ``n_tokens`` long,
    ``token_ids`` binary (little-endian unsigned 32-bit integers), or arrays of int if wanted, and ``decoded`` string.

    A null or empty text has no tokens, empty ids and an empty text. Repeated rows
    give repeated results; other columns of the input are not carried. No shuffle.
    ``path`` must be readable on the executors.
    """

    def ids_array(blobs: list[bytes]) -> pa.Array:
        if not as_arrays:
            return pa.array(blobs, pa.binary())
        offsets = np.concatenate([[0], np.cumsum([len(blob) // ID_TYPE.itemsize for blob in blobs])]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(blobs), "<i4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            keys, texts = batch.columns
            for start, stop in stretches(texts, BATCH_BYTES):
                ids, decoded = [], []
                for low, high in stretches(texts.slice(start, stop - start)):
                    blobs = codec.encode([text or "" for text in texts.slice(start + low, high - low).to_pylist()])
                    ids += blobs
                    decoded += map(codec.decode, blobs)
                counts = pa.array([len(blob) // ID_TYPE.itemsize for blob in ids], pa.int64())
                columns = [keys.slice(start, len(ids)), counts, ids_array(ids), pa.array(decoded, pa.string())]
                yield pa.record_batch(columns, [key, "n_tokens", "token_ids", "decoded"])

    kind, held = df.schema[key].dataType.simpleString(), "array<int>" if as_arrays else "binary"
    schema = f"`{key}` {kind}, n_tokens long, token_ids {held}, decoded string"
    return bound_batches(df).select(column(key), column(text).alias("__text")).mapInArrow(light(run, tokenizer=True), schema)


def digests(encoded: DataFrame) -> DataFrame:
    """The columns of ``encode_decode`` with SHA-256 digests instead of ids and text."""
    return encoded.withColumns(
        {"ids_sha256": F.sha2("token_ids", 256), "decoded_sha256": F.sha2(F.encode("decoded", "UTF-8"), 256)}
    ).drop("token_ids", "decoded")
