"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by the set of sources they belong to. Each set is a node that offers its
words once at no cost, a second time at a higher one, and so on: convex costs, so repetition is spread
before it is deepened. Each source is a node that wants its quota. A flow of least cost routes words
to quotas; it needs the sums per set only. Then each set takes as many whole passes over
its documents as its flow holds, and the rest from its documents in a seeded order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from itertools import cycle

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import column
from retentia.functions.keytable import KeyTable
from retentia.functions.ordering import running_total
from retentia.functions.scratch import local_table, materialize

WEIGHTS = (3, 1, 2)
VOLUME = 1.5
MOST_PASSES = 2
MOST_PATTERNS = 1_000_000
SEED = 10
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Words of a text, which end at ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(column(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_order(name: str | None) -> tuple[bool, str]:
    """Sort key of sources: by code point, null last."""
    return name is None, name or ""


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, volume: float = VOLUME, most: float = MOST_PASSES) -> dict[str | None, float]:
    """Words wanted of each source: shares of ``volume`` times all words, by weights dealt out in turn in the order of sources.

    No target exceeds ``most`` times its source's size; the excess is shared again by weight.
    """
    weight = dict(zip(sorted(sizes, key=source_order), cycle(weights)))
    open_sources, left, found = set(sizes), volume * sum(sizes.values()), {}
    while open_sources:
        total = sum(weight[name] for name in open_sources)
        share = {name: left * weight[name] / total for name in open_sources}
        above = {name for name in open_sources if share[name] > most * sizes[name]}
        if not above:
            return found | share
        for name in above:
            found[name] = float(most * sizes[name])
            left -= found[name]
        open_sources -= above
    return found


def min_cost_flow(offers: Sequence[int], wants: Sequence[int], members: Sequence[Sequence[int]], costs: Sequence[int]) -> list[dict[int, int]]:
    """Largest flow of least cost from sets to sources, as words per source for each set.

    Set i offers ``offers[i]`` words once for each of ``costs`` (increasing), and may send them to the sources ``members[i]``;
    source j takes at most ``wants[j]``. Augments along cheapest paths.
    """
    n = len(offers)
    start, end = n + len(wants), n + len(wants) + 1
    heads, room, price, out = [], [], [], [[] for _ in range(end + 1)]

    def arc(a: int, b: int, capacity: int, cost: int) -> None:
        for tail, head, r, c in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[tail].append(len(heads))
            heads.append(head)
            room.append(r)
            price.append(c)

    routes = {}
    for at, offer in enumerate(offers):
        for cost in costs:
            arc(start, at, offer, cost)
        for source in members[at]:
            routes[at, source] = len(heads)
            arc(at, n + source, sum(wants), 0)
    for source, want in enumerate(wants):
        arc(n + source, end, want, 0)
    while True:
        distance, came, queue = {start: 0}, {}, deque([start])
        while queue:
            node = queue.popleft()
            for a in out[node]:
                if room[a] > 0 and distance[node] + price[a] < distance.get(heads[a], float("inf")):
                    distance[heads[a]], came[heads[a]] = distance[node] + price[a], a
                    queue.append(heads[a])
        if end not in came:
            break
        path, node = [], end
        while node != start:
            path.append(came[node])
            node = heads[came[node] ^ 1]
        pushed = min(room[a] for a in path)
        for a in path:
            room[a] -= pushed
            room[a ^ 1] += pushed
    return [{source: room[routes[at, source] ^ 1] for source in members[at]} for at in range(n)]


def route(sums: Sequence[tuple[Sequence[str | None], int]], wanted: dict[str | None, float], most: int) -> list[dict[str | None, int]]:
    """Words that each set of sources sends to each of its sources, for ``(sources, words)`` of the sets.

    A source that is in no set but its own takes what it wants, up to ``most`` passes; only sets that overlap need a flow.
    """
    uses: dict[str | None, int] = {}
    for names, _ in sums:
        for name in names:
            uses[name] = uses.get(name, 0) + 1
    found: list[dict[str | None, int]] = [{} for _ in sums]
    overlapping = []
    for at, (names, size) in enumerate(sums):
        if len(names) == 1 and uses[names[0]] == 1:
            found[at] = {names[0]: min(round(wanted[names[0]]), most * size)}
        else:
            overlapping.append(at)
    order = sorted({name for at in overlapping for name in sums[at][0]}, key=source_order)
    number = {name: at for at, name in enumerate(order)}
    members = [[number[name] for name in sums[at][0]] for at in overlapping]
    flows = min_cost_flow([sums[at][1] for at in overlapping], [round(wanted[name]) for name in order], members, [2 * p + 1 for p in range(most)])
    for at, flow in zip(overlapping, flows):
        found[at] = {order[source]: words for source, words in flow.items()}
    return found


def identified(df: DataFrame) -> DataFrame:
    """``df`` with a column ``__place`` that tells its rows apart and is the same whenever it is read: file and row of a Parquet table.

    Other tables are written first.
    """
    try:
        return df.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("__place"))
    except AnalysisException:
        return identified(materialize(df, "rows"))


def mix(
    df: DataFrame,
    key: str,
    size: Column,
    sources: Column,
    weights: Sequence[float] = WEIGHTS,
    volume: float = VOLUME,
    most: int = MOST_PASSES,
    seed: int = SEED,
) -> DataFrame:
    """All columns of ``df`` as a struct ``row`` beside what the mix takes of each row.

    ``sources`` is an array of the sources a row belongs to, null being a source of its own. Returns
    ``row``, ``size``, ``source`` (the source whose quota the row serves), ``source_size`` (words of
    all rows that belong to it), ``target`` (its quota), ``repeats`` (0 to ``most``) and ``taken`` (repeats times size).

    One row per input row; repeated rows are taken one by one. A row without words costs nothing
    and is repeated like its neighbours in the order. Whole documents are taken, so a source
    misses its quota by half a document per set at most. A document that belongs to no source (empty or null array) is
    not taken. Rows are ordered by a hash of seed and key, then key, size, a hash of the row and its place in the table: the
    same rows give the same mix. Raises where there are more than ``MOST_PATTERNS`` sets of sources.

    Only the keys of the order are sorted. A set takes a first part of its order, so what it takes follows for every row from the
    key at which that part ends; rows are neither shuffled nor written.
    """
    spark = df.sparkSession
    names = F.array_sort(F.array_distinct(sources))
    marked = identified(df).select(
        F.struct(*[column(name) for name in df.columns]).alias("row"), size.alias("size"), names.alias("names"), F.col("__place").alias("place")
    )
    tie = F.xxhash64(*[F.col("row").getField(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    own = F.col("row").getField(key)
    order = F.struct(F.xxhash64(F.lit(seed), own).alias("mark"), own.alias("id"), F.col("size"), tie.alias("tie"), F.col("place"))
    rows = marked.withColumn("order", order)
    narrow = materialize(rows.select("names", "size", "order"), "order")
    sums = narrow.groupBy("names").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("count")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources")
    sums = sorted(sums, key=lambda r: [source_order(x) for x in r["names"] or ()])
    sizes: dict[str | None, int] = {}
    for row in sums:
        for name in row["names"] or ():
            sizes[name] = sizes.get(name, 0) + row["size"]
    wanted = targets(sizes, weights, volume * sum(r["size"] for r in sums if r["names"]) / max(1, sum(sizes.values())), most)
    flows = route([(row["names"] or (), row["size"]) for row in sums], wanted, most)

    plans = []
    for at, (row, flow) in enumerate(zip(sums, flows)):
        total = sum(flow.values())
        passes, rest = divmod(total, row["size"]) if row["size"] else (0, 0)
        # A stretch of the set's order serves each of its sources, as long as the source's part of the flow.
        reached, lanes = 0, []
        for name in row["names"] or ():
            reached += flow[name]
            lanes.append((row["size"] * reached // total if total else 0, name, sizes[name], float(wanted[name])))
        plans.append((row["names"], at, row["count"], passes, rest if passes < most else 0, lanes))
    lane = "array<struct<stop: bigint, source: string, source_size: bigint, target: double>>"
    plan = local_table(spark, plans, f"names array<string>, pattern bigint, count bigint, passes bigint, rest bigint, lanes {lane}")
    patterns = KeyTable(plan, "names", stored=True)

    # Where the parts end: the last key of each set that is taken once more, and the last that serves each source but the set's last.
    ends = patterns.attach(narrow, F.col("names"), ["pattern", "rest", "lanes"])
    numbered = running_total(ends, ["pattern"], [F.col("order").asc()], F.col("size"), "before")
    more = (F.col("before") + F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0)
    inner = F.transform(F.slice("lanes", F.lit(1), F.greatest(F.size("lanes") - 1, F.lit(0))), lambda one, at: F.struct(at.alias("lane"), (F.col("before") < one["stop"]).alias("holds")))
    parts = F.concat(F.array(F.struct(F.lit(-1).alias("lane"), more.alias("holds"))), inner)
    last = numbered.select("pattern", "order", F.inline(parts)).filter("holds").groupBy("pattern", "lane").agg(F.max("order").alias("last"))
    cuts = last.groupBy("pattern").agg(
        F.max(F.when(F.col("lane") < 0, F.col("last"))).alias("more"), F.map_from_entries(F.collect_list(F.struct("lane", "last"))).alias("ends")
    )
    settled = plan.join(materialize(cuts, "cuts"), "pattern", "left")
    found = KeyTable(materialize(settled, "plan"), "names", stored=True).attach(rows, F.col("names"), ["passes", "more", "ends", "lanes"])
    repeats = (F.col("passes") + F.when(F.col("order") <= F.col("more"), 1).otherwise(0)).cast("int")
    whole = F.size("lanes") - 1
    serving = F.filter("lanes", lambda one, at: (at == whole) | (F.col("order") <= F.try_element_at(F.col("ends"), at)))[0]
    picked = [F.when(F.size("lanes") > 0, serving[name]).alias(name) for name in ("source", "source_size", "target")]
    chosen = found.select("row", "size", *picked, repeats.alias("repeats"))
    return chosen.withColumn("taken", F.col("repeats") * F.col("size"))
