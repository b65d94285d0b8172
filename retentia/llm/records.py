"""Token ids as framed binary records with an offset index beside each file.

A record is an 8-byte length, the masked CRC-32C of these eight bytes, the ids (little-endian
unsigned integers of 2 bytes where the vocabulary allows, else 4), and the masked CRC-32C of
the ids. The index is a file of its own (Arrow) with key, offset and number of ids of each
record, so that records can be read in any order without reading what lies between.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentia.functions.columns import column
from retentia.functions.scratch import materialize
from retentia.llm.files import new_name, open_to_read, open_to_write, spread
from retentia.llm.piece_table import TextEncoder
from retentia.llm.pretokens import TokenizerFile, bound_batches, kept, stretches, tokenizer_file

# Fixed values of the record format: CRC-32C's reflected polynomial and the mask's rotation and addend.
POLYNOMIAL = 0x82F63B78
MASK_TURN, MASK_DELTA = 15, 0xA282EAD8

FRAME = 16
LANE = 256
FLUSH_BYTES = 8 << 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, int]:
    """Effect of four zero bytes on the low and the high half of a register, and the word that sets a zero register to all ones."""
    register = np.arange(1 << 16, dtype=np.uint32)
    low, high = register.copy(), register << np.uint32(16)
    for _ in range(32):
        low, high = ((x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0)) for x in (low, high))
    word = 0xFFFFFFFF
    for _ in range(32):
        word = ((word ^ POLYNOMIAL) << 1 | 1) if word >> 31 else word << 1
    return low, high, word


@lru_cache(maxsize=1)
def _lane_shift() -> tuple[np.ndarray, np.ndarray]:
    """Effect of ``LANE`` zero bytes on either half of a register."""
    low, high, _ = _tables()
    halves = np.arange(1 << 16, dtype=np.uint32), np.arange(1 << 16, dtype=np.uint32) << np.uint32(16)
    for _ in range(LANE // 4):
        halves = tuple(low[x & np.uint32(0xFFFF)] ^ high[x >> np.uint32(16)] for x in halves)
    return halves


def crc32c(blobs: Sequence[bytes]) -> np.ndarray:
    """CRC-32C of each blob.

    Blobs are cut into lanes of equal length, filled up in front with zeros, which leave an
    empty register alone; all lanes advance together, four bytes at a step, and are then
    put together blob by blob.
    """
    low, high, word = _tables()
    start = np.uint32(word).tobytes()
    lanes = np.array([-(-(len(blob) + 4) // LANE) for blob in blobs], np.int64)
    ends = np.cumsum(lanes)
    data = b"".join(part for blob, n in zip(blobs, lanes) for part in (bytes(n * LANE - len(blob) - 4), start, blob))
    words = np.ascontiguousarray(np.frombuffer(data, "<u4").reshape(-1, LANE // 4).T)
    register = np.zeros(words.shape[1], np.uint32)
    for row in words:
        register ^= row
        register = low[register & np.uint32(0xFFFF)] ^ high[register >> np.uint32(16)]
    far_low, far_high = _lane_shift()
    order = np.argsort(-lanes, kind="stable")
    first, count = (ends - lanes)[order], lanes[order]
    total = np.zeros(len(blobs), np.uint32)
    for at in range(int(lanes.max(initial=0))):
        n = int(np.searchsorted(-count, -at))
        x = total[:n]
        total[:n] = far_low[x & np.uint32(0xFFFF)] ^ far_high[x >> np.uint32(16)] ^ register[first[:n] + at]
    out = np.empty(len(blobs), np.uint32)
    out[order] = total ^ np.uint32(0xFFFFFFFF)
    return out


def masked_crc32c(blobs: Sequence[bytes]) -> np.ndarray:
    crc = crc32c(blobs)
    return ((crc >> np.uint32(MASK_TURN)) | (crc << np.uint32(32 - MASK_TURN))) + np.uint32(MASK_DELTA)


def frame(payloads: Sequence[bytes]) -> bytes:
    lengths = [len(payload).to_bytes(8, "little") for payload in payloads]
    sums = zip(masked_crc32c(lengths), masked_crc32c(payloads))
    return b"".join(
        part
        for length, payload, (head, body) in zip(lengths, payloads, sums)
        for part in (length, head.tobytes(), payload, body.tobytes())
    )


def unframe(frames: Sequence[bytes]) -> list[bytes]:
    """Payloads of whole frames; raises where a length or a checksum is not right."""
    heads, payloads = [frame[:8] for frame in frames], [frame[12:-4] for frame in frames]
    stored = np.frombuffer(b"".join(frame[8:12] + frame[-4:] for frame in frames), "<u4").reshape(-1, 2)
    right = (stored[:, 0] == masked_crc32c(heads)) & (stored[:, 1] == masked_crc32c(payloads))
    if not right.all() or any(int.from_bytes(head, "little") != len(payload) for head, payload in zip(heads, payloads)):
        raise ValueError("a record is damaged")
    return payloads


def id_type(file: TokenizerFile) -> np.dtype:
    return np.dtype("<u2" if len(file.tokens) <= 1 << 16 else "<u4")


@kept(4)
def _encoder(path: str) -> TextEncoder:
    file = tokenizer_file(path)
    return TextEncoder(file, file.encode, id_type(file))


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts from the tokenizers library, each distinct pre-token encoded once as long as it is remembered."""
    return _encoder(path)(texts)


def write_records(df: DataFrame, key: str, text: str, path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encode texts and write them as records, in ascending order of the key over all files.

    ``folder`` must be one that executors share. Returns one row per file: ``part``,
    ``file``, ``records``, ``ids`` and ``start`` (ids in all files before it).

    A null text is an empty one; every record ends with ``end_id``. Null keys come
    first. Equal keys are ordered by a hash of their text, then by the text. An empty
    table gives no file. Other columns are not written. One shuffle, by range of the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        width, end = id_type(tokenizer_file(path)), np.array([end_id], id_type(tokenizer_file(path))).tobytes()
        name = new_name(folder, f"records-{part:06d}", ".bin")
        data = index = None
        offset = records = ids = 0
        for batch in batches:
            keys, texts = batch.columns[:2]
            for start, stop in stretches(texts):
                some = [text.as_py() or "" for text in texts.slice(start, stop - start)]
                payloads = [blob + end for blob in token_bytes(some, path)]
                if data is None:
                    data, sink = open_to_write(name), open_to_write(f"{name}.index")
                    layout = pa.schema([("key", keys.type), ("offset", pa.int64()), ("bytes", pa.int64()), ("ids", pa.int64())])
                    index = pa.ipc.new_file(sink, layout)
                data.write(frame(payloads))
                sizes = np.array([len(payload) for payload in payloads], np.int64)
                offsets = offset + np.concatenate([[0], np.cumsum(sizes + FRAME)])
                columns = [keys.slice(start, len(payloads)), offsets[:-1], sizes + FRAME, sizes // width.itemsize]
                index.write_batch(pa.record_batch(columns, schema=layout))
                offset, records, ids = int(offsets[-1]), records + len(payloads), ids + int(sizes.sum()) // width.itemsize
        if data is not None:
            index.close()
            sink.close()
            data.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "records": [records], "ids": [ids]})

    placed = bound_batches(df).select(column(key), column(text).alias("__text")).withColumn("__tie", F.xxhash64("__text"))
    order = [column(key).asc(), F.col("__tie").asc()]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order, F.col("__text"))
    files = materialize(ranged.mapInArrow(run, "part long, file string, records long, ids long"), "record-files")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))


def read_index(files: DataFrame, key_type: str) -> DataFrame:
    """One row per record: ``key``, ``file``, ``offset``, ``bytes``, ``n_ids`` and ``start`` (ids of all records before it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["start"]
                with open_to_read(row["file"] + ".index") as source, pa.ipc.open_file(source) as index:
                    for at in range(index.num_record_batches):
                        found = index.get_batch(at)
                        ids = found.column("ids").to_numpy()
                        starts = start + np.cumsum(ids) - ids
                        start += int(ids.sum())
                        names = pa.array([row["file"]] * len(ids), pa.string())
                        columns = [found.column("key"), names, found.column("offset"), found.column("bytes"), ids, starts]
                        yield pa.record_batch([*map(pa.array, columns)], ["key", "file", "offset", "bytes", "n_ids", "start"])

    rows = spread(files.select("file", "start")).mapInArrow(run, f"key {key_type}, file string, offset long, bytes long, n_ids long, start long")
    # Written, so that reading records is a stage of its own: a task that ran both would hold two Python workers.
    return materialize(rows, "record-index")


def read_records(index: DataFrame, path: str, key_type: str) -> DataFrame:
    """The records that rows of ``read_index`` point to, in whatever order these come.

    Returns ``key``, ``start``, ``n_ids`` and ``ids`` (binary, little-endian unsigned 32-bit
    integers). Lengths and checksums are verified. For a shuffled read, shuffle the index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, name, source = id_type(tokenizer_file(path)), None, None
        for batch in batches:
            rows = batch.to_pylist()
            begin, held = 0, 0
            frames: list[bytes] = []
            for at, row in enumerate(rows):
                if row["file"] != name:
                    if source is not None:
                        source.close()
                    name, source = row["file"], open_to_read(row["file"])
                frames.append(source.read_at(row["bytes"], row["offset"]))
                held += row["bytes"]
                if held >= FLUSH_BYTES or at + 1 == len(rows):
                    blobs = [np.frombuffer(payload, width).astype("<u4").tobytes() for payload in unframe(frames)]
                    part = batch.slice(begin, len(frames))
                    columns = [part.column("key"), part.column("start"), part.column("n_ids"), pa.array(blobs, pa.binary())]
                    yield pa.record_batch(columns, ["key", "start", "n_ids", "ids"])
                    begin, held, frames = at + 1, 0, []
        if source is not None:
            source.close()

    wanted = index.select("key", "file", "offset", "bytes", "n_ids", "start")
    return wanted.mapInArrow(run, f"key {key_type}, start long, n_ids long, ids binary")
