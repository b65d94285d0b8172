"""Operators on sequences: periodic runs, conversation prefixes, repeated passages."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retentia.llm import periodic, prefix_trie, repeats
from retentia.llm.queries import QUERIES


def slow_runs(words, least_length, least_exponent):
    found = {}
    for period in range(1, len(words) // least_exponent + 1):
        at = 0
        while at + period < len(words):
            start = at
            while at + period < len(words) and words[at] == words[at + period]:
                at += 1
            length = at - start + period
            if at > start and length >= max(least_length, least_exponent * period):
                found.setdefault((start, length), period)
            at += at == start
    return sorted((start, length, period) for (start, length), period in found.items())


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), st.integers(1, 9), st.integers(0, 12)), max_size=4),
    st.sampled_from([(4, 2), (6, 3), (24, 3), (1, 2), (5, 4)]),
)
def test_runs_are_those_of_brute_force(parts, bounds):
    texts = [words + words[:period] * times for words, period, times in parts]
    assert periodic.text_runs(texts, *bounds) == [slow_runs(words, *bounds) for words in texts]


def test_runs_of_long_repetitions():
    assert periodic.text_runs([[b"x"] * 30_000, [b"a", b"b", b"a"] * 5_000]) == [[(0, 30_000, 1)], [(0, 15_000, 3)]]
    fibonacci = [b"a", b"ab"]
    for _ in range(15):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    words = [bytes([x]) for x in fibonacci[-1]]
    assert periodic.text_runs([words[:900]], 6, 2) == [slow_runs(words[:900], 6, 2)]


def test_positions_stay_in_order(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 4)
    values = random.Random(3).sample(range(1_000), 300)
    places = periodic.Positions(values[0])
    for value in values[1:]:
        places.add(value)
    ordered = sorted(values)
    assert list(places) == ordered and places.size == 300
    for at, value in enumerate(ordered):
        assert places.around(value) == (ordered[at - 1] if at else None, ordered[at + 1] if at < 299 else None)


RUN_TEXTS = [
    (1, "a b c " * 12 + "end"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "x " * 24),
    (5, "x " * 24),
    (6, "x " * 23),
    (None, "q\x1cr é " * 10),
    (7, "word\x85word " + " ".join(f"w{n}" for n in range(40)) + "\x0bone\x0ctwo " * 9 + "tail"),
    (8, "l " * 30 + "m n " * 15),
    (9, "very long " * 40_000),
]


def test_periodic_runs(spark):
    frame = spark.createDataFrame(RUN_TEXTS, "doc_id long, text string").withColumns({"runs": F.lit("clash"), "__text": F.lit(1)})
    found = periodic.periodic_runs(frame, "doc_id", F.col("text")).collect()
    want = []
    for key, text in RUN_TEXTS:
        words = (text or "").encode().split()
        runs = [(0, 80_000, 2)] if key == 9 else slow_runs(words, 24, 3)
        gone = {at for start, length, period in runs for at in range(start + period, start + length)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        want.append((key, len(words), runs, best, b" ".join(w for at, w in enumerate(words) if at not in gone).decode()))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["strongest"] and tuple(r["strongest"]), r["collapsed"]) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [run for key, _, runs, *_ in want for run in runs if key == 8] == [(0, 30, 1), (30, 30, 2)]
    assert periodic.periodic_runs(frame.limit(0), "doc_id", F.col("text")).count() == 0


def test_planted_periods(spark):
    rows = [(n, " ".join(f"w{x}" for x in range(n % 60))) for n in range(300)] + [(11, None), (None, "a b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = frame.select("doc_id", periodic.with_planted_period(F.col("doc_id"), F.col("text")).alias("text")).collect()
    want = []
    for key, text in rows:
        h = None if key is None else zlib.crc32(str(key).encode())
        if h is not None and h % 10 == 0 and text is not None:
            words, g = text.split(), h // 10
            if words:
                a = g % len(words)
                p = 1 + (len(words) - a) // (3 + g % 8)
                text = " ".join(words[a + (at - a) % p] if at >= a else word for at, word in enumerate(words))
        want.append((key, text))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def slow_trie(rows):
    """Nodes from (conv, turn, role, text) rows; the remainder of a negative conversation is negative, as in SQL."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [turn[2:] for turn in sorted(turns)] for conv, turns in own.items()}
    built = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        built[conv] = (*own.get(conv - int(math.fmod(conv, 100)), [])[:h], *turns[h:])
    members = defaultdict(list)
    for conv, turns in sorted(built.items()):
        for depth in range(len(turns) + 1):
            members[turns[:depth]].append(conv)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += node not in children
            saved[node[:depth]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
    digest = lambda node: hashlib.sha256(",".join(str(c) for c in members[node] if built[c] == node).encode()).hexdigest()
    return sorted(
        (c[0], len(node), members[node[:-1]][0] if node else -1, len(c), children.get(node, 0), leaves[node], saved[node], digest(node)) for node, c in members.items()
    )


def trie_rows(spark, tmp_path, rows):
    folder = str(tmp_path / f"t{random.getrandbits(40)}")
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("clash"), "conv": F.lit(0)})
    frame.write.parquet(f"{folder}/conversations.parquet")
    found = QUERIES["op12_prefix_trie"](spark, folder).collect()
    return sorted(tuple(-1 if x is None else x for x in row) for row in found)


def test_trie_equals_brute_force(spark, tmp_path):
    generator = random.Random(4)
    rows = []
    for conv in [*range(40), *range(100, 150), *range(230, 260), -7]:
        for turn in range(generator.randrange(1, 10)):
            rows.append((conv, turn if turn else None, generator.choice(["user", "tool", None]), generator.choice(["a", "bé", None, "dd"])))
    rows += [(500, n, "u", f"t{n}") for n in range(70)] + [(c, n, "u", f"t{n}" if n < 45 else f"{c}") for c in (507, 508, 509) for n in range(70)]
    rows += [(c, n, "u", "same") for c in range(600, 640) for n in range(9)]
    rows += [(700, 1, "u", "x"), (700, 1, "u", "x"), (None, 1, "u", "y"), (701, 1, None, None), (702, 1, "u", "long " * 20_000)]
    assert trie_rows(spark, tmp_path, rows) == slow_trie(rows)


def test_trie_of_nothing(spark, tmp_path):
    assert trie_rows(spark, tmp_path, []) == []
    # Conversations that lose all turns are members of the root only.
    gone = next(c for c in range(300, 400) if zlib.crc32(str(c).encode()) % 6 >= 2 and c % 100)
    assert trie_rows(spark, tmp_path, [(gone, 1, "u", "x")]) == slow_trie([(gone, 1, "u", "x")])


def slow_repeats(rows, length):
    first = {}
    split = [(key, (text or "").encode().split()) for key, text in rows]
    for key, words in split:
        for at in range(len(words) - length + 1):
            window = tuple(words[at : at + length])
            if key is not None:
                first[window] = min(first.get(window, key), key)
    found = []
    for key, words in split:
        gone = set()
        for at in range(len(words) - length + 1):
            if key is not None and first[tuple(words[at : at + length])] < key:
                gone.update(range(at, at + length))
        found.append((key, len(words), len(gone), b" ".join(w for at, w in enumerate(words) if at not in gone).decode()))
    return sorted(found, key=repr)


@pytest.mark.parametrize(("length", "anchor_words"), [(50, 16), (6, 3), (5, 5), (4, 1)])
def test_repeats_equal_brute_force(spark, length, anchor_words):
    generator = random.Random(length)
    passages = [[f"p{n}w{at}" for at in range(length + generator.randrange(-2, 40))] for n in range(8)]
    rows = []
    for key in range(120):
        words = []
        for _ in range(generator.randrange(0, 5)):
            words += [f"u{generator.randrange(10**6)}" for _ in range(generator.randrange(0, 30))]
            passage = generator.choice(passages)
            cut = generator.randrange(0, 6)
            words += passage[cut : len(passage) - generator.randrange(0, 6)]
        rows.append((generator.randrange(0, 100), " ".join(words)))
    rows += [(200 + n, "same words again " * 40) for n in range(20)] + [(300 + n, " ".join(passages[0] * 3)) for n in range(10)]
    rows += [(400, None), (401, ""), (402, " \n "), (None, " ".join(passages[1] * 2)), (None, "x"), (403, "a\x1cb\x85c é " * 70), (404, "a\x1cb\x85c é " * 70)]
    rows += [rows[3], (405, "long text " * 30_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("clash"), "key": F.lit(1), "tie": F.lit(2)})
    found = repeats.drop_repeats(frame, "doc_id", "text", length, anchor_words).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found], key=repr) == slow_repeats(rows, length)
    for row in found:
        spans = [tuple(span) for span in row["spans"]]
        assert sum(stop - start for start, stop in spans) == row["n_removed"] and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert repeats.drop_repeats(frame.limit(0), "doc_id", "text", length, anchor_words).count() == 0


def test_equal_windows_choose_equal_anchors():
    generator = np.random.default_rng(2)
    passage = generator.integers(0, 1 << 60, 80, dtype=np.uint64)
    chosen = []
    for size in (0, 7, 33):
        words = np.concatenate([generator.integers(0, 1 << 60, size, dtype=np.uint64), passage])
        places = repeats.least_places(repeats.gram_hashes(words, 16), 35) - size
        chosen.append(places[size:].tolist())
    assert chosen[0] == chosen[1] == chosen[2]
    for width in (1, 2, 5, 8):
        values = generator.integers(0, 4, 60)
        want = [at + width - 1 - int(np.argmin(values[at : at + width][::-1])) for at in range(60 - width + 1)]
        assert repeats.least_places(values, width).tolist() == want
