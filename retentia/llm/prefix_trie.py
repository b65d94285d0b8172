"""The trie of the prefixes that conversations share, by ROLLUP over positional turn-id columns.

Turns are ids, and ``BLOCK`` turns of a conversation are one row of id columns t1 to t8. ``GROUP BY node, ROLLUP (t1, ..., t8)``
aggregates every prefix of the block at once; ``grouping_id`` tells how long it is. Longer
conversations go on in further rows, keyed by the node at which the block before ended. That node is named by a
digest of the turns before it, which all blocks get in a number of joins that is the logarithm of the longest conversation.

All sums over a subtree are sums over the conversations that pass through its top, so a second ROLLUP
gives them without walking the tree: the smallest member of a node owns it, a conversation
owns the nodes of its own path from some depth on, and what it owns is below each node that it passes but
does not own. For the owner itself, what it owns above the node is taken off again.

A conversation of any length is cut into rows, and aggregates are taken in part before every shuffle, so neither a
long conversation nor a prefix that most conversations share is one task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.functions.columns import column
from retentia.functions.keytable import KeyTable
from retentia.functions.scratch import materialize

BLOCK = 8
HEAD_TURNS = 5
CHUNK_IDS = 4_096
TURNS = [f"t{at + 1}" for at in range(BLOCK)]
PART = "__part"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _nothing() -> Column:
    return F.unhex(F.lit(""))


def running_in_groups(df: DataFrame, group: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of a group up to this one, for groups of any number and size.

    Rows are range-partitioned by group and order. A group may go on over several partitions; each partition has at
    most one that began before it, so the sums carried on are one row per partition.
    """
    ranged = df.withColumn("__value", value).repartitionByRange(F.col(group), *map(F.col, order)).withColumn(PART, F.spark_partition_id())
    placed = materialize(ranged, "ranged")
    earlier = Window.partitionBy(group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(group, PART).agg(F.sum("__value").alias("__sum"))
    carried = sums.withColumn("__carried", F.sum("__sum").over(earlier)).filter(F.col("__carried").isNotNull()).drop("__sum")
    inside = Window.partitionBy(PART, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.withColumn("__inside", F.sum("__value").over(inside)).join(F.broadcast(carried), [PART, group], "left")
    return joined.withColumn(out, F.col("__inside") + F.coalesce("__carried", F.lit(0))).select(*map(column, df.columns), out)


def number_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Columns conv, place (from 1, by turn, null first, then role and text) and turn: a struct of id and chars.

    A null role or text is empty; rows with a null conversation are left out. The id is half of a SHA-256 of role and text,
    chars the text's number of code points. Repeated rows are turns of their own.
    """
    kept = df.filter(column(conv).isNotNull()).select(
        column(conv).cast("long").alias("conv"), column(turn).alias("turn"), *[F.coalesce(column(c), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    )
    numbered = running_in_groups(kept, "conv", ["turn", "role", "text"], F.lit(1), "place")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    return numbered.select("conv", "place", F.struct(F.substring(F.unhex(digest), 1, 16).alias("id"), F.length("text").cast("long").alias("chars")).alias("turn"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the one with the last hundred multiple, as ``prefix_trie`` takes them.

    Conversation c becomes the first h turns of conversation c - c % 100 (all if it has fewer, none if it is absent), then its own
    turns after its first h; h is the CRC-32 of c in decimal modulo 6. ``turns`` is what ``number_turns`` returns.
    """
    taken = (F.crc32(F.col("conv").cast("string")) % 6).cast("int")
    heads = turns.filter(F.col("place") <= HEAD_TURNS).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "turn"))).alias("head"))
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).withColumn("base", F.col("conv") - F.col("conv") % 100)
    none = F.array().cast("array<struct<id: binary, chars: bigint>>")
    head = F.slice(F.coalesce(F.col("head")["turn"], none), F.lit(1), taken)
    convs = convs.join(heads, "base", "left").select("conv", "own", head.alias("head"))
    length = F.size("head") + F.greatest(F.col("own") - taken, F.lit(0))
    convs = materialize(convs.select("conv", "own", "head", length.cast("long").alias("length"), F.size("head").alias("moved")), "conversations")
    table = KeyTable(convs.select("conv", "moved", "own"), "conv", "own", stored=True)
    own = table.attach(turns.filter(F.col("place") > taken), F.col("conv"), ["moved"])
    own = own.select("conv", (F.col("place") - taken + F.col("moved")).cast("long").alias("depth"), "turn")
    copied = convs.select("conv", F.posexplode("head").alias("at", "turn")).select("conv", (F.col("at") + 1).cast("long").alias("depth"), "turn")
    return copied.unionByName(own), convs.select("conv", "length")


def _blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and block: its ids, and the names of the prefix before it and of the node this ends at."""
    place = (F.col("depth") - 1) % BLOCK
    block = F.floor((F.col("depth") - 1) / BLOCK).alias("block")
    picked = [F.max(F.when(place == at, F.col("turn"))).alias(name) for at, name in enumerate(TURNS)]
    blocks = turns.groupBy("conv", block).agg(*picked)
    longest = convs.agg(F.max("length")).first()[0] or 0
    if longest <= BLOCK:
        return materialize(blocks.withColumns({"prior": _nothing(), "above": _nothing()}), "blocks")
    blocks = materialize(blocks, "blocks")
    full = blocks.filter(F.col(TURNS[-1]).isNotNull())
    chain = full.select("conv", "block", _sha(*[F.col(f"{name}.id") for name in TURNS]).alias("link"))
    # After each round a link covers twice as many blocks back, until it covers all.
    reach = 1
    while reach * BLOCK < longest:
        earlier = chain.select("conv", (F.col("block") + reach).alias("block"), F.col("link").alias("earlier"))
        joined = chain.join(earlier, ["conv", "block"], "left")
        chain = materialize(joined.select("conv", "block", F.when(F.col("earlier").isNull(), F.col("link")).otherwise(_sha(F.col("earlier"), F.col("link"))).alias("link")), "chain")
        reach *= 2
    before = chain.select("conv", (F.col("block") + 1).alias("block"), F.col("link").alias("before"))
    named = materialize(blocks.join(before, ["conv", "block"], "left").withColumn("prior", F.coalesce("before", _nothing())).drop("before"), "named")
    ended = named.filter(F.col(TURNS[-1]).isNotNull()).select("conv", (F.col("block") + 1).alias("block"), _name(BLOCK).alias("ended"))
    return materialize(named.join(ended, ["conv", "block"], "left").withColumn("above", F.coalesce("ended", _nothing())).drop("ended"), "blocks")


def _name(turns: int | Column) -> Column:
    """Name of the node that the first ``turns`` turns of a block lead to."""
    ids = [F.coalesce(F.when(F.lit(at) < turns, F.col(f"{name}.id")), _nothing()) for at, name in enumerate(TURNS)]
    return _sha(F.encode(F.concat(F.col("block").cast("string"), F.lit(":")), "UTF-8"), F.col("prior"), *ids)


def _rollup(rows: DataFrame, measures: str) -> DataFrame:
    """Aggregates of every prefix, with its number of turns in the block as ``level``."""
    turns = ", ".join(TURNS)
    query = f"""SELECT block, prior, above, {turns}, {BLOCK} - bit_count(grouping_id()) AS level, min(conv) AS conv_id, {measures}
        FROM {{rows}} GROUP BY block, prior, above, ROLLUP ({turns})"""
    found = rows.sparkSession.sql(query, rows=rows)
    # A conversation that ended earlier has nulls where the ROLLUP has ids.
    present = sum(F.col(name).isNotNull().cast("int") for name in TURNS)
    return found.filter((F.col("level") > 0) & (present == F.col("level"))).withColumn("depth", F.col("block") * BLOCK + F.col("level"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, one for each distinct sequence of first turns, from the empty one on; and the node at which each conversation ends.

    ``turns`` has conv, depth (from 1, without gaps) and turn (a struct of id and chars); ``convs`` has each conversation
    once, with its length, turnless ones too. Nodes have ``name`` (binary, empty for the root), ``conv_id`` (smallest member),
    ``depth``, ``parent_conv_id`` (null for the root), ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes of the
    subtree) and ``saved_tokens`` (the sum over the subtree of (members - 1) times the chars of a node's last turn), all long; ends have ``name`` and ``conv``.

    Without conversations there is no node, not even a root. Node (conv_id, depth) is unique. Turns are equal if their ids are.
    """
    rows = _blocks(turns, convs)
    lengths = KeyTable(convs.withColumn("count", F.greatest("length", F.lit(1))), "conv", stored=True)
    rows = materialize(lengths.attach(rows, F.col("conv"), ["length"]), "rows")
    last = F.coalesce(*[F.col(f"{name}.chars") for name in reversed(TURNS)])
    level = F.col("level")
    found = _rollup(rows, "count(*) AS n_convs, max(length) AS longest").select(
        _name(level).alias("name"),
        F.when(level > 1, _name(level - 1)).otherwise(F.col("above")).alias("parent"),
        "conv_id", "depth", "n_convs", "longest", ((F.col("n_convs") - 1) * last).alias("saved"),
    )
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("length").alias("longest")).filter("n_convs > 0")
    root = root.select(_nothing().alias("name"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", "longest", F.lit(0).cast("long").alias("saved"))
    nodes = materialize(running_in_groups(found.unionByName(root), "conv_id", ["depth"], F.col("saved"), "down_to"), "nodes")

    owned = nodes.groupBy("conv_id").agg(
        F.sum("saved").alias("owned"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"), F.count(F.lit(1)).alias("count")
    )
    owners = KeyTable(materialize(owned, "owners"), "conv_id", stored=True)
    weighted = owners.attach(rows, F.col("conv"), ["owned", "leaf"]).withColumns({name: F.coalesce(name, F.lit(0).cast("long")) for name in ("owned", "leaf")})
    sums = _rollup(weighted, "sum(owned) AS owned, sum(leaf) AS n_leaves").select("conv_id", "depth", "owned", "n_leaves")
    # All conversations pass through the root, which the smallest of them owns.
    top = owners.frame.agg(F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.sum("owned").alias("owned"), F.sum("leaf").alias("n_leaves"))
    children = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    with_children = materialize(nodes.join(children, "name", "left").fillna(0, ["n_children"]), "with_children")
    parents = with_children.filter("n_children > 0").select("name", F.col("conv_id").alias("parent_conv_id"), "n_children")
    placed = KeyTable(parents, "name", "n_children", stored=True).attach(with_children, F.col("parent"), ["parent_conv_id"])
    joined = placed.join(sums.unionByName(top), ["conv_id", "depth"])
    saved = F.col("owned") - (F.col("down_to") - F.col("saved"))
    return joined.select("name", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens")), _ends(rows, convs)


def _ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The node at which each conversation ends: ``name`` and ``conv``."""
    present = sum(F.col(name).isNotNull().cast("int") for name in TURNS)
    last = rows.filter(F.col("block") * BLOCK + present == F.col("length"))
    return last.select(_name(BLOCK).alias("name"), "conv").unionByName(convs.filter("length = 0").select(_nothing().alias("name"), "conv"))


def id_list_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the conversations that end at each node, ascending, with commas between.

    Ids are sorted in ranges and put together in pieces of ``CHUNK_IDS``; a node's pieces are then hashed one after the other as
    they stream by, so a node at which very many conversations end needs no more memory than another.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, firsts, lists = [], [], []
        for batch in batches:
            for name, conv in zip(*(part.to_pylist() for part in batch.columns)):
                if not names or names[-1] != name or len(lists[-1]) >= CHUNK_IDS:
                    if len(names) >= CHUNK_IDS:
                        yield pa.record_batch([pa.array(names, pa.binary()), pa.array(firsts, pa.int64()), pa.array([",".join(ids) for ids in lists])], ["name", "first", "ids"])
                        names, firsts, lists = [], [], []
                    names.append(name)
                    firsts.append(conv)
                    lists.append([])
                lists[-1].append(str(conv))
        if names:
            yield pa.record_batch([pa.array(names, pa.binary()), pa.array(firsts, pa.int64()), pa.array([",".join(ids) for ids in lists])], ["name", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            names, digests = [], []
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if state is not None and at == name:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    names.append(name)
                    digests.append(state.hexdigest())
                name, state = at, hashlib.sha256(ids.encode())
            yield pa.record_batch([pa.array(names, pa.binary()), pa.array(digests, pa.string())], ["name", "ends_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], ["name", "ends_sha256"])

    ranged = ends.repartitionByRange("name", "conv").sortWithinPartitions("name", "conv")
    found = ranged.mapInArrow(pieces, "name binary, first bigint, ids string")
    return found.repartition("name").sortWithinPartitions("name", "first").mapInArrow(hashed, "name binary, ends_sha256 string")
