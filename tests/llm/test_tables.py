"""Operators on pages, vectors, shards, mixes, and the pipeline."""

import base64
import gzip
import hashlib
import io
import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from retentia.functions.scratch import scratch_path
from retentia.llm import arc, dimension_scan, hilbert, mixing, near_copies, spherical, vectors
from retentia.llm.vectors import sample_vectors, spherical_kmeans

SMALL = "/root/testdata/sf0.001"


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = [
    (1, "http://a.example/ü x", "<p>one</p>"),
    (2, None, "<p>one</p>"),
    (3, "ftp://odd", None),
    (4, "http://b", ""),
    (5, "HTTP://c", "line\r\n\r\nbreaks\nWARC/1.1\r\n\r\n"),
    (5, "HTTP://c", "line\r\n\r\nbreaks\nWARC/1.1\r\n\r\n"),
    (6, "http://d", "long " * 200_000),
    (None, "http://e", "<p>one</p>"),
]


@pytest.mark.parametrize("least", [0, 1, 11])
def test_archive_pages(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"file": F.lit("x"), "ordinal": F.lit(1)})
    found = arc.archive_pages(pages.repartition(3), "page_id", "url", "html", scratch_path(spark, "a"), least).collect()
    want = []
    for data, some in itertools.groupby(sorted(((h or "").encode(), -1 if p is None else p) for p, _, h in PAGES), lambda x: x[0]):
        keys = [key for _, key in some]
        for at, key in enumerate(keys):
            original = len(data) < least or at == len(keys) - 1
            want.append((key, len(data), sha(data), "response" if original else "revisit", None if original else keys[-1]))
    got = [(-1 if r["key"] is None else r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len({r["record_id"] for r in found}) == len(PAGES)
    assert {r["date"] for r in found if r["key"] == 4} == {"2000-01-01T00:00:04Z"}


def test_archive_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert arc.archive_pages(pages, "page_id", "url", "html", scratch_path(spark, "a")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_read_arc(version, packed):
    bodies = [b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nhello\n", b"", b"plain text of another scheme"]
    urls = ["http://a/b c", "http://empty", "dns:a"]
    parts = [arc.arc_header("x.arc", version, "20010203040506")] + [arc.arc_record(u, "20010203040506", b, version, "x.arc", 7) for u, b in zip(urls, bodies)]
    data = b"".join(map(gzip.compress, parts)) if packed else b"".join(parts)
    stream = gzip.open(io.BytesIO(data)) if packed else io.BytesIO(data)
    records = list(arc.read_arc(stream))
    assert [r.content for r in records[1:]] == bodies and records[0].is_header
    assert [r.payload for r in records[1:]] == [b"hello\n", b"", bodies[2]]
    assert ("checksum" in records[1].fields) == (version == 2) and records[1].fields["url"] == "http://a/b%20c"
    kinds = [arc._warc("response" if r.is_http else "resource", r, "x", at, None) for at, r in enumerate(records[1:])]
    fields = [f for f, _ in arc.read_warc(io.BytesIO(b"".join(kinds)))]
    assert [f["warc-type"] for f in fields] == ["response", "resource", "resource"]
    assert fields[0]["warc-date"] == "2001-02-03T04:05:06Z" and fields[0]["warc-payload-digest"] == f"sha1:{sha(b'hello' + bytes([10]))}"
    cut = list(arc.read_arc(io.BytesIO(b"".join(parts)[:-10])))
    assert cut[-1].short and b"WARC-Truncated: length" in arc._warc("resource", cut[-1], "x", 3, None)


def test_damaged_archives():
    for data in (b"no header\n", b"filedesc://x 0.0.0.0 20010203040506 text/plain 10\n9 0 other\n\n"):
        with pytest.raises(ValueError):
            list(arc.read_arc(io.BytesIO(data)))
    record = arc._warc("resource", arc.ArcRecord({"url": "dns:a", "archive-date": "2001", "ip-address": "1", "content-type": "t"}, b"abc"), "x", 1, None)
    with pytest.raises(ValueError):
        list(arc.read_warc(io.BytesIO(record.replace(b"abc", b"abd"))))


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    return [None, [], [0.0, 0.0, 0.0], [1.0, nan, 0.0], [inf, 1.0, 1.0], [1.0, None, 2.0]]


def vector_rows():
    generator = np.random.default_rng(4)
    base = generator.standard_normal((120, 8))
    near = base[:40] + generator.standard_normal((40, 8)) * 0.08
    rows = [(n, [float(x) for x in v], int(n % 3)) for n, v in enumerate(np.vstack([base, near, base[:20], base[:20] * 3]))]
    hub = generator.standard_normal(8)
    rows += [(500 + n, [float(x) for x in hub + generator.standard_normal(8) * 0.02], 1) for n in range(60)]
    rows += [(1000 + n, v, 1) for n, v in enumerate(odd_vectors())] + [(2000, rows[0][1], None), (0, rows[0][1], 0), (3, rows[3][1], 0), (3000, [1.0], 2), (3001, [1.0, 0.0], 2)]
    return rows


def valid(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector) and any(vector)


@pytest.mark.parametrize("cell_points, block", [(1 << 12, 1 << 12), (20, 7)])
@pytest.mark.parametrize("kind", ["double", "float"])
def test_near_vectors(spark, cell_points, block, kind):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({"point": F.lit(1), "digest": F.lit("x"), "copies": F.lit(0)})
    found = spherical.near_duplicates(frame, "vec_id", "embedding", "label", 0.98, cell_points, block).collect()
    width = 8
    wide = [np.array([*v, *[0.0] * (width - len(v))], "f4" if kind == "float" else float).astype(float) if valid(v) else None for _, v, _ in rows]
    group = list(range(len(rows)))
    links = [[] for _ in rows]
    for i, j in itertools.permutations(range(len(rows)), 2):
        if wide[i] is not None and wide[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2]:
            if wide[i] @ wide[j] / (np.linalg.norm(wide[i]) * np.linalg.norm(wide[j])) >= 0.98:
                links[i].append(j)
    changed = True
    while changed:
        lowest = [min([group[i], *(group[j] for j in links[i])]) for i in range(len(rows))]
        changed, group = lowest != group, lowest
    smallest = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group)}
    want = [(rows[i][0], len(links[i]), smallest[group[i]], rows[i][0] == smallest[group[i]]) for i in range(len(rows))]
    assert sorted(map(tuple, found)) == sorted(want)


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (2, [0.0], 1)], [(1, [], None)]])
def test_no_vectors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = spherical.near_duplicates(frame, "vec_id", "embedding", "label").collect()
    assert sorted(map(tuple, found)) == [(r[0], 0, r[0], True) for r in rows]
    assert dimension_scan.nearest(frame, "vec_id", "embedding", F.lit(True)).count() == 0


def test_gaps_of_many_wide_centres_take_little_memory():
    centres = np.random.default_rng(5).standard_normal((2048, 768))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    centres[1] = centres[0]
    tracemalloc.start()
    gaps = spherical.centre_gaps(centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    true = np.linalg.norm(centres[:50, None] - centres[None, :50], axis=2)
    assert ((gaps[:50, :50] >= true) & (gaps[:50, :50] <= true + 1e-5)).all()


def test_samples_are_bounded_by_bytes(spark, monkeypatch):
    rows = spark.range(200).select(F.md5(F.col("id").cast("string")).alias("digest"), F.lit(np.ones(8).tobytes()).alias("vector"))
    assert sample_vectors(rows, "<f8", 8).shape == (200, 8)
    monkeypatch.setattr(vectors, "SAMPLE_BYTES", 8 * 8 * 50)
    assert sample_vectors(rows, "<f8", 8).shape == (50, 8)


def test_kmeans_has_no_empty_cells():
    sample = np.random.default_rng(0).standard_normal((400, 5))
    centres = spherical_kmeans(np.vstack([sample, np.ones((400, 5))]), 20)
    assert len(centres) == 20 and np.allclose(np.linalg.norm(centres, axis=1), 1)


def exact_nearest(rows, chosen, k):
    matrix = [np.array(v, float) if valid(v) else None for _, v, _ in rows]
    found = {}
    for i, (key, _, _) in enumerate(rows):
        if matrix[i] is not None and chosen(key):
            scores = sorted((-(matrix[i] @ matrix[j]), rows[j][0]) for j in range(len(rows)) if j != i and matrix[j] is not None)
            found.setdefault(key, []).append([(key_there, -s) for s, key_there in scores[:k]])
    return found


def test_nearest_small_is_exact_in_order(spark):
    rows = [r for r in vector_rows() if r[1] is None or len(r[1]) not in (1, 2)][:70] + [(9000 + n, v, 0) for n, v in enumerate(odd_vectors())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"row": F.lit(1), "score": F.lit(2), "list": F.lit(3)})
    found = dimension_scan.nearest(frame, "vec_id", "embedding", F.col("key") % 20 == 0, k=5, epsilon=50.0).collect()
    want = exact_nearest(rows, lambda key: key % 20 == 0, 5)
    for key, answers in want.items():
        got = sorted((r["rank"], r["neighbour_id"], r["score"]) for r in found if r["query_id"] == key)
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert [g[1] for g in got] == [a[0] for a in answers[0]]
        assert np.allclose([g[2] for g in got], [a[1] for a in answers[0]], rtol=1e-12)
    assert {r["query_id"] for r in found} == set(want)


def test_nearest_recall_over_lists_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(dimension_scan, "BLOCK_POINTS", 64)
    monkeypatch.setattr(dimension_scan, "BLOCK_QUERIES", 16)
    generator = np.random.default_rng(7)
    data = generator.standard_normal((1_200, 40)) * generator.uniform(0.5, 2, (1_200, 1))
    rows = [(n, [float(x) for x in v], 0) for n, v in enumerate(data)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = dimension_scan.nearest(frame, "vec_id", "embedding", F.col("key") % 20 == 0, k=20, lists=12).collect()
    want = exact_nearest(rows, lambda key: key % 20 == 0, 20)
    got = {}
    for row in found:
        got.setdefault(row["query_id"], []).append(row["neighbour_id"])
    assert all(len(got[key]) == 20 == len(set(got[key])) for key in want)
    assert sum(len({a for a, _ in want[key][0]} & set(got[key])) for key in want) / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("dims, bits", [(1, 3), (2, 3), (3, 2), (4, 2)])
def test_hilbert_steps_are_neighbours(spark, dims, bits):
    names = [f"d{at}" for at in range(dims)]
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    frame = spark.createDataFrame(cells, ", ".join(f"{name} long" for name in names))
    found = hilbert.curve_index(frame, names, bits, F.struct(*names), "curve").select("row.*", "curve").collect()
    path = [tuple(r)[:-1] for r in sorted(found, key=lambda r: r["curve"])]
    assert sorted(r["curve"] for r in found) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def test_shard_rows(spark):
    rows = [(n, "ab"[n % 2] * (n % 7 + 1), None if n % 11 == 0 else n % 5) for n in range(300)] + [(7, "same", 1)] * 90 + [(None, None, None)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, part long").withColumns({"slot": F.lit("x"), "position": F.lit(1), "row": F.lit(2), "__part": F.lit(3)})
    found = hilbert.shard_rows(frame, "doc_id", ["text", "part"], 16)
    assert found.columns == ["doc_id", "text", "part", "position", "row", "__part", "shard", "slot", "curve"]
    rows_found = found.collect()
    assert sorted(map(str, (tuple(r)[:3] for r in rows_found))) == sorted(map(str, rows))
    by_shard = {}
    for row in rows_found:
        by_shard.setdefault(row["shard"], []).append(row)
    assert set(by_shard) == set(range(16)) and max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    last = -1
    for shard in range(16):
        ordered = sorted(by_shard[shard], key=lambda r: r["slot"])
        assert [r["slot"] for r in ordered] == list(range(len(ordered)))
        for row in ordered:
            assert row["curve"] >= last
            last = row["curve"]
    path = scratch_path(spark, "shards")
    hilbert.write_shards(found, path)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 16
    assert hilbert.shard_rows(frame.limit(0), "doc_id", ["text", "part"], 16).count() == 0


def brute_cost(offers, wants, members, costs):
    """Least cost and largest flow by trying all ways to send whole words."""
    best = {}
    ways = []
    for at, offer in enumerate(offers):
        most = offer * len(costs)
        ways.append([s for s in itertools.product(range(most + 1), repeat=len(members[at])) if sum(s) <= most])
    for choice in itertools.product(*ways):
        got, cost = [0] * len(wants), 0
        for at, sent in enumerate(choice):
            for source, n in zip(members[at], sent):
                got[source] += n
            left = sum(sent)
            for price in costs:
                cost += price * min(left, offers[at])
                left -= min(left, offers[at])
        if all(g <= w for g, w in zip(got, wants)):
            flow = sum(got)
            best[flow] = min(best.get(flow, math.inf), cost)
    return max(best), best[max(best)]


def test_min_cost_flow():
    generator = random.Random(1)
    for _ in range(25):
        members = [[0], [1], [0, 1]]
        offers, wants = [generator.randrange(4) for _ in members], [generator.randrange(8) for _ in range(2)]
        flows = mixing.min_cost_flow(offers, wants, members, [1, 3])
        total, cost = 0, 0
        for offer, flow in zip(offers, flows):
            sent = sum(flow.values())
            total, cost = total + sent, cost + min(sent, offer) + 3 * max(0, sent - offer)
        assert (total, cost) == brute_cost(offers, wants, members, [1, 3])
        assert all(sum(flow.get(s, 0) for flow in flows) <= wants[s] for s in range(2))


def test_targets():
    sizes = {"b": 100, "a": 10, None: 1000, "c": 0}
    found = mixing.targets(sizes)
    assert found["a"] == 20 and found["c"] == 0 and found["b"] + found[None] == pytest.approx(1.5 * 1110 - 20)
    assert found["b"] == 200
    assert mixing.targets({}) == {}


def mixed_rows():
    generator = random.Random(6)
    rows = [(n, "w " * generator.randrange(1, 40), ["s1", "s2", "s3", None, "s0"][min(4, int(generator.random() ** 2 * 5))]) for n in range(600)]
    return rows + [(1000, None, "s1"), (1001, "", "s2"), (1002, "one", "s9"), (5, "again " * 7, "s1"), (5, "again " * 7, "s1"), (None, "x y", None), (1003, "y " * 50_000, "big")]


def test_mix_single_sources(spark):
    rows = mixed_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "taken": F.lit(1), "pattern": F.lit(2), "row": F.lit(3)})
    run = lambda: mixing.mix(frame.repartition(5), "doc_id", mixing.word_count("text"), F.array("source")).select("row.doc_id", "row.source", "size", "source_size", "target", "taken", "repeats").collect()
    found = run()
    assert sorted(map(str, found)) == sorted(map(str, run())) and len(found) == len(rows)
    size = lambda text: len((text or "").split())
    assert sorted(map(str, ((r["doc_id"], r["size"]) for r in found))) == sorted(map(str, ((k, size(t)) for k, t, _ in rows)))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    wanted = mixing.targets(sizes)
    for source in sizes:
        mine = [r for r in found if r["source"] == source]
        assert {(r["source_size"], r["target"]) for r in mine} == {(sizes[source], wanted[source])}
        assert abs(sum(r["taken"] for r in mine) - wanted[source]) <= max(r["size"] for r in mine) / 2 + 1
    assert all(r["taken"] == r["repeats"] * r["size"] and 0 <= r["repeats"] <= 2 for r in found)


def test_mix_overlapping_sources(spark):
    generator = random.Random(8)
    sets = [["a"], ["b"], ["a", "b"], ["b", "c"], [], ["c", "c", "a"]]
    rows = [(n, generator.randrange(1, 20), sets[n % len(sets)]) for n in range(900)] + [(5000, 3, None)]
    frame = spark.createDataFrame(rows, "id long, words long, sources array<string>")
    found = mixing.mix(frame, "id", F.col("words"), F.col("sources"), volume=1.2).select("row.*", "size", "source", "target", "taken", "repeats").collect()
    assert len(found) == len(rows)
    assert all(r["taken"] == 0 for r in found if not r["sources"])
    for source in "abc":
        mine = [r for r in found if r["source"] == source]
        assert all(source in r["sources"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 25 * len(sets)


def test_mix_empty_and_too_many(spark, monkeypatch):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(frame, "doc_id", mixing.word_count("text"), F.array("source")).count() == 0
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    frame = spark.createDataFrame([(n, "x", str(n)) for n in range(5)], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixing.mix(frame, "doc_id", mixing.word_count("text"), F.array("source"))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def pipeline_rows():
    generator = random.Random(3)
    words = {"xx": "the quick brown fox jumps over lazy dogs".split(), "yy": "der schnelle braune fuchs springt über hunde".split()}
    rows = []
    for n in range(120):
        lang = ("xx", "yy")[n % 2]
        text = " ".join(generator.choices(words[lang], k=60))
        rows.append((n, text, lang, f"s{n % 4}", len(text)))
    rows += [(900 + n, *rows[3][1:]) for n in range(5)] + [rows[8]]
    rows += [(1001, None, "xx", "s1", None), (1002, "", "yy", None, 0), (1003, "12 34 !!", "xx", "s2", 8), (None, rows[9][1] + " end", None, None, None)]
    return rows


def test_stages(spark):
    rows = pipeline_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit(1), "score": F.lit(2), "repeats": F.lit(3), "key": F.lit(4)})
    kept = corpus_pipeline.keep_languages(spark, docs, SMALL)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {1001, 1002, 1003}
    single = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert single.columns == corpus_pipeline.COLUMNS
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in single.collect())
    assert not {900, 901, 902, 903, 904} & set(ids) and ids.count(8) == 1 and 3 in ids
    mixed = corpus_pipeline.mix_sources(spark, docs, SMALL)
    assert mixed.columns == corpus_pipeline.COLUMNS
    assert max(r["count"] for r in mixed.filter("doc_id <> 8").groupBy("doc_id").count().collect()) == 2
    encoded = corpus_pipeline.encode(spark, docs, SMALL).collect()
    assert len(encoded) == len(rows) and all(r["n_tokens"] == len(r["token_ids"]) for r in encoded)
    plain = {r[0]: hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows}
    assert all(plain[r["doc_id"]] == r["decoded_sha256"] for r in encoded)


def test_unlearned_languages_are_rejected(spark):
    finnish = "Hallitus päätti eilen, että uusi laki tulee voimaan vasta ensi vuonna, koska kysymyksiä on vielä paljon."
    italian = "Il governo ha deciso ieri che la nuova legge entrerà in vigore solo il prossimo anno perché ci sono ancora molte domande. "
    given = spark.read.parquet(f"{SMALL}/documents.parquet").select(corpus_pipeline.COLUMNS)
    # Rows without a key are held out, so that nothing is learned from them.
    added = spark.createDataFrame([(None, finnish, "en", "f", 1), (None, italian * 5, "en", "i", 1)], DOCS)
    kept = corpus_pipeline.keep_languages(spark, given.unionByName(added), SMALL)
    assert kept.filter("doc_id is null").count() == 0 and kept.count() == given.count()


def changed(words, places):
    return " ".join(f"new{at}" if at in places else word for at, word in enumerate(words))


def jaccard(a, b):
    x, y = ({tuple(t.split()[at : at + 5]) for at in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_are_dropped(spark):
    generator = random.Random(12)
    rows, copies, others = [], set(), set()
    for n in range(0, 80, 2):
        words = [f"w{generator.randrange(10**6)}" for _ in range(60)]
        near = n % 4 == 0
        text = changed(words, {30} if near else {20, 40})
        assert (jaccard(" ".join(words), text) >= 0.8) == near
        rows += [(n, " ".join(words), "xx", "s", 1), (n + 1, text, "xx", "s", 1)]
        (copies if near else others).add(n + 1)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), SMALL).collect()}
    assert not copies & kept and others <= kept and set(range(0, 80, 2)) <= kept


def test_simhash_proposes_copies(spark, monkeypatch):
    generator = random.Random(16)
    words = [f"w{generator.randrange(10**6)}" for _ in range(400)]
    # One word changed is within the reach of SimHash; one in ten is alike for no method, and the whole texts refuse a group of both.
    texts = [" ".join(words), changed(words, {200}), changed(words, set(range(5, 400, 10)))]
    rows = [(n, text, "xx", "s", 1) for n, text in enumerate([*texts, texts[1], None, " "])]
    asked, operator = [], corpus_pipeline.simhash.near_duplicates
    monkeypatch.setattr(corpus_pipeline.simhash, "near_duplicates", lambda *args: (asked.append(operator(*args)), asked[-1])[1])
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), SMALL)
    assert {r["doc_id"] for r in kept.collect()} == {0, 2, 4}
    groups = {r["key"]["doc_id"]: r["component_id"]["doc_id"] for r in asked[0].collect()}
    assert groups[1] == groups[3] == 0 and groups[5] == 4
    # Pairs that only the proposal has are decided, not believed.
    monkeypatch.setattr(near_copies, "_runs", lambda sets, least: spark.createDataFrame([], "shingle long, a long, b long"))
    given = spark.createDataFrame([(n, text) for n, text in enumerate(texts)], "id long, text string")
    all_one = given.select("id", F.lit(0).cast("long").alias("component_id"))
    found = {r["id"]: r["component_id"] for r in near_copies.near_copies(given, "id", "text", 5, 0.8, all_one).collect()}
    links = {tuple(sorted((r["a"], r["b"]))) for r in near_copies.proposed_pairs(near_copies.shingle_sets(given, "id", "text", 5, 0.8), all_one, "id").collect()}
    assert len(links) == 2 and found[2] == 2 and found[0] == 0


@pytest.mark.parametrize("n", [10, 2048, 2049, 5000, 20000])
def test_parities_bound_the_difference(n):
    generator = np.random.default_rng(n)
    hashes = np.unique(generator.integers(0, 1 << 63, 3 * n, dtype=np.int64).astype(np.uint64))
    least = 0.8
    for shared in (0, n // 2, n - n // 20):
        a, b = hashes[:n], np.sort(np.r_[hashes[:shared], hashes[n : 2 * n - shared]])
        odd = [near_copies.parities(x) for x in (a, b)]
        bits = [near_copies.folded(x)[None] for x in odd]
        near = near_copies.within_bounds(np.array([len(a)]), np.array([len(b)]), *bits, lambda at: odd, least)  # noqa: B023
        alike = shared / (len(a) + len(b) - shared) >= least
        assert near[0] or not alike
        # Sets without anything in common are told apart at every size.
        assert not near[0] or shared
    # Of different sizes, the larger folds to the smaller; the parities of a difference stay within it.
    a, b = near_copies.parities(hashes[: n + n // 8]), near_copies.parities(hashes[:n])
    size = min(len(a), len(b))
    assert np.bitwise_count(near_copies.folded(a, size) ^ near_copies.folded(b, size)).sum() <= n // 8


def test_key_filter_lets_all_wanted_pass(spark):
    rows = spark.range(5000).select(F.struct("id", F.col("id").cast("string").alias("name")).alias("key"))
    wanted = rows.filter("key.id % 50 = 0")
    kept = {r["key"]["id"] for r in near_copies.filtered(rows, F.col("key"), wanted).collect()}
    assert set(range(0, 5000, 50)) <= kept and len(kept) < 200
    assert near_copies.filtered(rows, F.col("key"), wanted.limit(0)).count() == 0


def test_long_texts_are_compared_whole(spark):
    # Long texts that share a passage, and near copies of some: only these are linked.
    generator = random.Random(14)
    passage = [f"p{at}" for at in range(60)]
    rows = []
    for n in range(0, 12, 2):
        words = [f"w{generator.randrange(10**7)}" for _ in range(6000)] + passage
        other = list(words)
        for at in range(0, 6000, 100 if n % 4 == 0 else 20):
            other[at] = "changed"
        rows += [(n, " ".join(words)), (n + 1, " ".join(other))]
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    alike = {n: jaccard(rows[n][1], rows[n + 1][1]) >= 0.8 for n in range(0, 12, 2)}
    assert set(alike.values()) == {True, False}
    assert found == {n: n - 1 if n % 2 and alike[n - 1] else n for n in range(12)}


@pytest.mark.parametrize("tile", [near_copies.TILE_SETS, 20])
def test_long_runs_are_cut_into_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE_SETS", tile)
    generator = np.random.default_rng(15)
    base = generator.integers(0, 1 << 62, 100)
    sets = [np.unique(np.r_[base[generator.permutation(100)[: 88 + n % 12]], generator.integers(0, 1 << 62, n % 9)]).astype(np.uint64) for n in range(50)]
    points = spark.createDataFrame([(n, len(x), near_copies.parities(x)) for n, x in enumerate(sets)], "set long, n long, parities binary")
    runs = [(7, n, n % 3) for n in range(50)] + [(8, n, 1) for n in range(20)] + [(9, n, n % 3) for n in range(0, 50, 4)]
    found = near_copies._across(spark.createDataFrame(runs, "shingle long, set long, label long"), points, 0.8).collect()
    alike = {(a, b) for a in range(50) for b in range(a + 1, 50) if a % 3 != b % 3 and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    pairs = [(r["a"], r["b"]) for r in found]
    assert alike and alike <= set(pairs) and len(pairs) == len(set(pairs))
    assert all(a < b and a % 3 != b % 3 for a, b in pairs)


def test_near_copies_over_long_runs(spark):
    # Copies with one word changed each, linked only by the text that all of them come from.
    generator = random.Random(13)
    words = [f"w{generator.randrange(10**6)}" for _ in range(60)]
    rows = [(n, changed(words, {n})) for n in range(6, 54)] + [(100, " ".join(words)), (101, changed(words, {20, 40})), (102, " ".join(words).upper()), (103, None), (104, " ")]
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    texts = {n: (text or "").lower() for n, text in rows[:-2]}
    group = dict(zip(texts, texts))
    for _ in texts:
        group = {a: min(group[b] for b in texts if jaccard(texts[a], texts[b]) >= 0.8) for a in texts}
    assert found == group | {103: 103, 104: 103}


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and all(r["n_tokens"] == len(r["token_ids"]) for r in rows)


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n.startswith("op")])
def test_queries(spark, name):
    table = {"1": "pages", "2": "embeddings", "5": "embeddings"}.get(name[2:].split("_")[0], "documents")
    rows = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    found = __spark_entry__.queries()[name](spark, SMALL)
    if name == "op12_prefix_trie":
        convs = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id").distinct().count()
        assert found.filter("depth = 0").collect()[0]["n_convs"] == convs
        return
    assert found.count() == (rows if name != "op5_dimension_scan" else len(range(0, rows, 20)) * 20)


def test_long_common_prefixes_are_told_apart(spark):
    """Texts that differ only late still cut the rows: one source to a shard."""
    prefix = "https://example.org/a/very/long/common/path/" * 3
    rows = [(n, f"{prefix}{n % 8}", n % 5) for n in range(800)] + [(900 + n, None, 1) for n in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, part int")
    found = hilbert.shard_rows(frame.filter("source is not null"), "doc_id", ["source"], 8).groupBy("shard").agg(F.countDistinct("source").alias("n")).collect()
    assert [r["n"] for r in found] == [1] * 8
    borders = hilbert.text_borders(frame, "source", 8)
    assert borders == sorted(borders) and set(borders) <= {r[1] for r in rows}
    assert hilbert.shard_rows(frame, "doc_id", ["source", "part"], 3).count() == 802


def test_a_third_of_the_rows_with_one_text(spark):
    rows = [(n, "same" if n % 3 == 0 else f"t{n:04d}") for n in range(3_000)]
    cells = hilbert.curve_index(spark.createDataFrame(rows, "k long, t string"), ["t"], 8, F.struct("k", "t"), "at").select("row.t", "at").collect()
    by_text = {}
    for text, at in cells:
        by_text.setdefault(text, set()).add(at)
    assert all(len(some) == 1 for some in by_text.values())
    ordered = [next(iter(by_text[text])) for text in sorted(by_text)]
    assert ordered == sorted(ordered) and len(set(ordered)) > 120


def test_single_sources_need_no_flow():
    generator = random.Random(4)
    for _ in range(30):
        members = [["a"], ["b"], ["c"], ["b", "c"]][: generator.randrange(1, 5)]
        sums = [(names, generator.randrange(5)) for names in members]
        wanted = {name: float(generator.randrange(9)) for name in "abc"}
        flows = mixing.route(sums, wanted, 2)
        plain = mixing.min_cost_flow([size for _, size in sums], [round(wanted[x]) for x in "abc"], [["abc".index(x) for x in names] for names in members], [1, 3])
        assert [sum(flow.values()) for flow in flows] == [sum(flow.values()) for flow in plain]
    many = [([f"s{n}"], 10) for n in range(200_000)]
    wanted = mixing.targets({names[0]: size for names, size in many})
    assert all(flow == {names[0]: round(wanted[names[0]])} for (names, _), flow in zip(many, mixing.route(many, wanted, 2)))


def test_mix_of_equal_rows(spark):
    """Rows alike in every column are taken one by one, and the same file gives the same mix."""
    frame = spark.createDataFrame([(1, "one two", "a")] * 50 + [(2, "three", "b")], "doc_id long, text string, source string")
    found = mixing.mix(frame, "doc_id", mixing.word_count("text"), F.array("source"), volume=0.5).select("row.doc_id", "taken", "target", "repeats").collect()
    taken = sum(r["taken"] for r in found if r["doc_id"] == 1)
    assert len(found) == 51 and abs(taken - next(r["target"] for r in found if r["doc_id"] == 1)) <= 1.5


def test_no_jump_at_any_length(spark):
    """Texts alike but for their length are kept or rejected by one rule."""
    scored = spark.createDataFrame([(n, "x" * n, 0.45) for n in range(1, 3_000)], "n int, text string, score double")
    doubts = [r[0] for r in scored.orderBy("n").select(corpus_pipeline.score_doubt(F.col("score"), "text")).collect()]
    assert all(0 <= a - b < 0.6 / n**1.5 for n, (a, b) in enumerate(zip(doubts, doubts[1:]), 1))


def test_long_lines_are_hot(spark):
    from retentia.llm import token_counts

    line = "-" * 40
    pieces = spark.createDataFrame([(line, 3_000, 1), ("rare", 1, 1), ("x" * 2_000, 3_000, 9)], "piece string, n long, tokens long")
    assert [r["piece"] for r in token_counts.hottest(pieces, 1).collect()] == [line]


def test_paths_of_stores():
    from retentia.llm import files

    assert [files.arrow_uri(x) for x in ("s3a://b/k", "s3n://b/k", "s3://b/k", "file:/a", "file:///a", "hdfs://h/a")] == [
        "s3://b/k", "s3://b/k", "s3://b/k", "file:///a", "file:///a", "hdfs://h/a",
    ]
