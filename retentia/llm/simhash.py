"""SimHash near-duplicates, with linked fingerprints found by vantage-point trees.

A vantage-point tree cuts a set of fingerprints by their Hamming distance to a pivot. A
pair within distance r that a cut separates has its inner member within r of the cut, so
it is enough to send those inner members across, as visitors, and visitors to every
side that their ball of radius r reaches. The top of the tree is built from a bounded
sample and deals the fingerprints out to shards; inside a shard the same cuts go on until a
block of comparisons is small. The sample decides only how even the shards are: every pair
is found with any tree.

Equal fingerprints are merged first, so that a group of copies, however large, is one
point; a ball of radius 4 holds at most 679,121 points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import column
from retentia.functions.keytable import KeyTable
from retentia.functions.scratch import materialize
from retentia.llm.components import Links, components
from retentia.llm.pretokens import bound_batches, light, light_group

SEED = 42
SAMPLE = 1 << 14
SHARD_POINTS = 1 << 14
VISITORS = 1 << 19
BLOCK_PAIRS = 1 << 18
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, words: int) -> int:
    """SimHash over shingles of ``words`` words, as a signed 64-bit number.

    A-Z are lower-cased, words end at ASCII white space, repeated shingles count again. A
    text with fewer words is one shingle, one without words has fingerprint 0.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())]
    octets = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BIT_OF_BYTE
    return int(np.packbits(counts.ravel() * 2 > len(hashes)).view(">i8")[0])


def fingerprints(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """The key under its name and ``fingerprint`` of each row, one per input row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.columns
            values = [fingerprint(value.as_py(), words) for value in texts]
            yield pa.record_batch([keys, pa.array(values, pa.int64())], [key, "fingerprint"])

    kind = df.schema[key].dataType.simpleString()
    return bound_batches(df).select(column(key), column(text).alias("__text")).mapInArrow(light(run), f"`{key}` {kind}, fingerprint long")


def _distance(points: np.ndarray, pivot: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ pivot).astype(np.int16)


def _cut(points: np.ndarray) -> tuple[np.uint64, int]:
    """Of a few points, the pivot whose distances to the others vary most, and their median."""
    best = max(points[:: max(1, len(points) // 8)][:8], key=lambda pivot: float(np.var(_distance(points, pivot))))
    return best, int(np.median(_distance(points, best)))


def top_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivots and radii of a full binary tree in heap order; children of node i are 2i + 1 (inner) and 2i + 2."""
    pivots, radii = np.zeros((1 << depth) - 1, np.uint64), np.zeros((1 << depth) - 1, np.int16)
    members = {0: sample}
    for node in range(len(pivots)):
        mine = members.pop(node)
        if len(mine):
            pivots[node], radii[node] = _cut(mine)
        inner = _distance(mine, pivots[node]) <= radii[node]
        members[2 * node + 1], members[2 * node + 2] = mine[inner], mine[~inner]
    return pivots, radii


def deal(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards of the points: (shard, index of the point, whether it is at home there)."""
    pivots, radii = tree
    at, node, home = np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
    for _ in range(depth):
        d, radius = _distance(points[at], pivots[node]), radii[node]
        to_inner = (home & (d <= radius)) | (~home & (d - reach <= radius))
        outer_home = home & (d > radius)
        to_outer = outer_home | ((d + reach > radius) & ~outer_home)
        at, node, home = (
            np.concatenate([at[to_inner], at[to_outer]]),
            np.concatenate([2 * node[to_inner] + 1, 2 * node[to_outer] + 2]),
            np.concatenate([home[to_inner], outer_home[to_outer]]),
        )
    return node - ((1 << depth) - 1), at, home


def _compare(points: np.ndarray, left: np.ndarray, right: np.ndarray, reach: int, links: Links) -> None:
    """Link all pairs of ``left`` and ``right`` (indexes) within reach, block by block."""
    step = max(1, BLOCK_PAIRS // max(1, len(right)))
    others = points[right]
    for at in range(0, len(left), step):
        near = np.bitwise_count(points[left[at : at + step], None] ^ others) <= reach
        if near.any():
            i, j = np.nonzero(near)
            links.add(left[at + i], right[j])


def _across(points: np.ndarray, visitors: np.ndarray, members: np.ndarray, reach: int, links: Links) -> None:
    """Link visitors with members through a vantage-point tree over the members."""
    pending = [(visitors, members)]
    while pending:
        visitors, members = pending.pop()
        if not len(visitors) or not len(members):
            continue
        if len(members) <= 512 or len(visitors) * len(members) <= BLOCK_PAIRS:
            _compare(points, visitors, members, reach, links)
            continue
        pivot, radius = _cut(points[members])
        d, e = _distance(points[members], pivot), _distance(points[visitors], pivot)
        if (d <= radius).all():
            _compare(points, visitors, members, reach, links)
            continue
        pending.append((visitors[e - reach <= radius], members[d <= radius]))
        pending.append((visitors[e + reach > radius], members[d > radius]))


def _within(points: np.ndarray, members: np.ndarray, reach: int, links: Links) -> None:
    """Link all pairs of members."""
    pending = [members]
    while pending:
        members = pending.pop()
        if len(members) > 512:
            pivot, radius = _cut(points[members])
            d = _distance(points[members], pivot)
            if not (d <= radius).all():
                inner, outer = members[d <= radius], members[d > radius]
                _across(points, members[(d <= radius) & (d + reach > radius)], outer, reach, links)
                pending += [inner, outer]
                continue
        _compare(points, members, members, reach, links)


def links(points: DataFrame, reach: int, shard_points: int = SHARD_POINTS, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) that connect whatever fingerprints within ``reach`` bits connect.

    ``points`` has one column, distinct ``fingerprint`` values. Of the pairs found in a shard,
    those that connect nothing new there are left out, so no group comes out as all
    its pairs.
    """
    n = points.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / shard_points)))
    rows = points.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(sample).collect() if depth else []
    tree = top_tree(np.array([row[0] for row in rows], np.int64).view(np.uint64), depth)
    # A visitor reaches about 1.7 sides of a cut on average.
    chunks = max(1, math.ceil(0.5 * 1.7**depth * shard_points / VISITORS))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 1 << 12):
                some = values[at : at + (1 << 12)]
                shard, index, home = deal(some.view(np.uint64), tree, depth, reach)
                chunk = np.where(home, 0, some[index] % chunks)
                if chunks > 1:
                    mine = np.flatnonzero(home)
                    more = np.repeat(mine, chunks - 1)
                    shard, index, home = (np.concatenate([x, x[more]]) for x in (shard, index, home))
                    chunk = np.concatenate([chunk, np.tile(np.arange(1, chunks), len(mine))])
                yield pa.record_batch([pa.array(shard), pa.array(chunk), pa.array(some[index]), pa.array(home)], ["shard", "chunk", "fingerprint", "home"])

    def search(key: tuple, table: pa.Table) -> pa.Table:
        values, home = table.column("fingerprint").to_numpy(), table.column("home").to_numpy()
        bits, found = values.view(np.uint64), Links(len(values))
        members = np.flatnonzero(home)
        if key[1].as_py() == 0:
            _within(bits, members, reach, found)
        _across(bits, np.flatnonzero(~home), members, reach, found)
        label = found.settle()
        joined = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": values[joined], "b": values[label[joined]]})

    dealt = points.select("fingerprint").mapInArrow(spread, "shard long, chunk long, fingerprint long, home boolean")
    return dealt.groupBy("shard", "chunk").applyInArrow(light_group(search), "a long, b long")


def near_duplicates(df: DataFrame, key: str, text: str, words: int = 4, reach: int = 4) -> DataFrame:
    """Fingerprint and group of each text: the key under its name, ``fingerprint`` (16 hex digits), ``component_id``.

    Rows are linked if their fingerprints differ in at most ``reach`` bits; ``component_id``
    is the smallest key that links reach, a row's own included. One row per input row;
    repeated rows and rows with equal keys stay apart and in one group if their texts are
    alike. A null key is smaller than no other and names a group only if all its keys
    are null. Null, empty and blank texts have fingerprint 0 and form a group. Other
    columns are not carried.
    """
    rows = materialize(fingerprints(df, key, text, words), "fingerprints")
    groups = rows.groupBy("fingerprint").agg(F.min(column(key)).alias("first"), F.count(F.lit(1)).alias("count"))
    groups = materialize(groups, "groups")
    linked = materialize(components(materialize(links(groups.select("fingerprint"), reach), "links")), "components")
    names = linked.join(groups, linked["node"] == groups["fingerprint"]).groupBy("component").agg(F.min("first").alias("name"))
    named = linked.join(names, "component").select("node", "name")
    # Only groups of several rows or linked ones need a look-up; any other row is its own component.
    wanted = groups.join(named, groups["fingerprint"] == named["node"], "left").filter("count > 1 or node is not null")
    wanted = materialize(wanted.select("fingerprint", "count", F.coalesce("name", "first").alias("component_id")), "named")
    found = KeyTable(wanted, "fingerprint", stored=True).attach(rows, F.col("fingerprint"), ["component_id"])
    hexadecimal = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select(column(key), hexadecimal.alias("fingerprint"), F.coalesce("component_id", column(key)).alias("component_id"))
