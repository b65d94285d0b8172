"""Operators on texts: encoding, records, counts, SimHash, languages."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retentia.functions.scratch import scratch_path
from retentia.llm import language, near_copies, piece_table, pretokens, records, simhash, token_counts, transducer
from retentia.llm.components import Links, components
from retentia.llm.pretokens import TokenizerFile, tokenizer_file

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "the guarantee of " * 9_000 + "x" * 70_000
TEXTS = [
    (1, "Hello world, it's 2024!\n\n  Twice  spaced\ttab"),
    (2, None),
    (3, ""),
    (4, "été über naïve 東京都に行く \U0001f600 ՘ ࢏"),
    (5, "before<|endoftext|>after <|endoftext|>"),
    (6, LONG),
    (1, "Hello world, it's 2024!\n\n  Twice  spaced\ttab"),
    (7, " \n\t "),
]
CLASHING = "n_tokens"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({CLASHING: F.lit("clash"), "key": F.lit(1), "__row": F.lit(2)})


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def blob(ids, kind="<u4"):
    return np.array(ids, kind).tobytes()


def test_encode_decode(texts, library):
    rows = transducer.digests(transducer.encode_decode(texts, "doc_id", "text", PATH)).collect()
    want = sorted(
        (key, len(ids), hashlib.sha256(blob(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        for key, text in TEXTS
        for ids in [ids_of(library, text)]
    )
    assert sorted(map(tuple, rows)) == want


def test_encode_decode_arrays(texts, library):
    rows = transducer.encode_decode(texts, "doc_id", "text", PATH, as_arrays=True).collect()
    assert sorted((r[0], r[2]) for r in rows) == sorted((key, ids_of(library, text)) for key, text in TEXTS)
    assert {r[0]: r[3] for r in rows} == {key: text or "" for key, text in TEXTS}


def test_empty_tables(spark, texts):
    none = texts.limit(0)
    assert transducer.encode_decode(none, "doc_id", "text", PATH).count() == 0
    assert token_counts.count_tokens(none, "doc_id", "text", PATH, 512).count() == 0
    assert simhash.near_duplicates(none, "doc_id", "text").count() == 0
    files = records.write_records(none, "doc_id", "text", PATH, scratch_path(spark, "records"))
    assert records.read_records(records.read_index(files, "long"), PATH, "long").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25), st.lists(st.integers(0, 3), max_size=400), st.integers(1, 40))
def test_stream_equals_whole(pairs, data, chunk):
    """With any merge list, emitting after the lookahead gives the tokens of the whole input."""
    lengths, merges, made = [1] * 4, [], set()
    for left, right in pairs:
        if left < len(lengths) and right < len(lengths) and (left, right) not in made:
            made.add((left, right))
            merges.append((left, right, len(lengths)))
            lengths.append(lengths[left] + lengths[right])
    coder = transducer.Transducer(merges, list(range(4)), lengths)
    whole, piece = coder._merge_many(bytes(data)), bytes(data)
    assert coder._merge_few(list(data)) == whole
    assert list(coder.stream(piece[at : at + chunk] for at in range(0, len(piece), chunk))) == whole


def test_lookahead_is_of_the_merge_list():
    assert transducer.sufficient_lookahead([], [1, 1]) == 0
    assert transducer.sufficient_lookahead([(0, 1, 2)], [1, 1, 2]) == 1
    # b c changes whether a b can merge, and c d whether b c can.
    assert transducer.sufficient_lookahead([(2, 3, 4), (1, 2, 5), (0, 1, 6)], [1, 1, 1, 1, 2, 2, 2]) == 3
    with pytest.raises(ValueError):
        transducer.sufficient_lookahead([(0, 1, 2), (1, 1, 2)], [1, 1, 2])
    assert transducer.Transducer.of(tokenizer_file(PATH)).lookahead == 320


def test_detokenizer_holds_unfinished_characters(library):
    state = transducer.Detokenizer(tokenizer_file(PATH).tokens)
    ids = ids_of(library, "aé東\U0001f600")
    assert "".join([*(state.feed([x]) for x in ids), state.close()]) == "aé東\U0001f600"
    random_ids = [random.Random(3).randrange(50_257) for _ in range(500)]
    state = transducer.Detokenizer(tokenizer_file(PATH).tokens)
    assert "".join([*(state.feed([x]) for x in random_ids), state.close()]) == library.decode(random_ids, skip_special_tokens=False)


def test_pretokens_follow_the_library(library):
    file = TokenizerFile(PATH)
    for text in ("ab՘c1ೝd ࢏x", "x" * 200_000, ("word " * 40_000), "'re're 're'R", "a\u0085b   c"):
        mine = [piece for pieces, _ in file.parts(text) for piece in pieces]
        assert mine == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "É", "1", "²", " ", "  ", "\n", "\t", "'", "'s", "'re", "'R", "!", "-", "\xa0", "\x85", "\x1c", " '", "'ll"]), max_size=12), min_size=1, max_size=4))
def test_piece_starts_follow_the_library(parts):
    texts = ["".join(part) for part in parts]
    joined = "".join(text + chr(piece_table.SEPARATOR) for text in texts)
    codes = np.frombuffer(joined.encode("utf-16-le"), "<u2")
    starts = piece_table.piece_starts(codes)
    found = [joined[a:b] for a, b in zip(starts, np.append(starts[1:], len(codes))) if joined[a] != chr(piece_table.SEPARATOR)]
    cut = tokenizer_file(PATH).library.pre_tokenizer.pre_tokenize_str
    assert found == [text[a:b] for text in texts for _, (a, b) in cut(text)]


def test_piece_classes_are_the_librarys():
    cut = tokenizer_file(PATH).library.pre_tokenizer.pre_tokenize_str
    for code in range(piece_table.LATIN):
        char = chr(code)
        for text in (f"a{char}1{char} {char}{char} {char}", f"{char}a{char} {char}1 '{char}", f"'s{char}{char}{char}b"):
            codes = np.frombuffer((text + chr(piece_table.SEPARATOR)).encode("utf-16-le"), "<u2")
            assert piece_table.piece_starts(codes)[:-1].tolist() == [a for _, (a, _) in cut(text)]


def test_full_tables_start_anew(library):
    generator = random.Random(9)
    texts = [" ".join("".join(generator.choices("abcdeé", k=generator.randrange(1, 9))) for _ in range(60)) for _ in range(40)]
    table = piece_table.PieceTable(tokenizer_file(PATH).encode, np.dtype("<u2"), limit=100, slots=256)
    found = [blob for at in range(0, 40, 3) for blob in table(texts[at : at + 3])]
    assert [np.frombuffer(blob, "<u2").tolist() for blob in found] == [ids_of(library, text) for text in texts]


def thue_morse(n):
    """Two words over a and b of ``n`` letters that every polynomial modulo 2^64 takes for one, if n is 1,024 or more."""
    first = "".join("ab"[at.bit_count() & 1] for at in range(n))
    return [first, first.translate({97: "b", 98: "a"})]


def test_pieces_with_equal_keys_stay_apart(library, monkeypatch):
    """Keys propose entries, characters decide."""
    words = [word for n in (1_024, 2_048, 4_096, 8_192) for word in thue_morse(n)]
    encode, kind = tokenizer_file(PATH).encode, np.dtype("<u2")
    table = piece_table.PieceTable(encode, kind)
    for texts in (words, words[::-1], [" ".join(words)]):
        assert [np.frombuffer(blob, "<u2").tolist() for blob in table(texts)] == [ids_of(library, text) for text in texts]
    # With bases of one, a piece's key is the sum of its characters.
    monkeypatch.setattr(piece_table, "BASES", (1, 1))
    texts = ["abc cab bca", "ad bc cb da", "cab", "abc abd acc bca", " bca ad", "ad da bc"]
    for table in (piece_table.PieceTable(encode, kind), piece_table.PieceTable(encode, kind, limit=3, slots=8)):
        for some in (texts, texts[:1], texts[::-1], texts[3:]):
            assert [np.frombuffer(blob, "<u2").tolist() for blob in table(some)] == [ids_of(library, text) for text in some]


def test_equal_keys_through_the_operators(spark, library):
    rows = list(enumerate(thue_morse(2_048) + thue_morse(1_024)[::-1]))
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = transducer.encode_decode(frame, "doc_id", "text", PATH, as_arrays=True).collect()
    assert sorted((r[0], r[2], r[3]) for r in found) == [(key, ids_of(library, text), text) for key, text in rows]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        TokenizerFile(public_tokenizers.path("word_bpe_49k.json"))


def test_records_round_trip(spark, texts, library):
    files = records.write_records(texts, "doc_id", "text", PATH, scratch_path(spark, "records"))
    index = records.read_index(files, "long")
    rows = records.read_records(index, PATH, "long").collect()
    ordered = sorted(TEXTS, key=lambda r: r[0])
    start, want = 0, []
    for key, text in ordered:
        ids = [*ids_of(library, text), 0]
        want.append((key, start, len(ids), zlib.crc32(blob(ids))))
        start += len(ids)
    assert sorted((r["key"], r["start"], r["n_ids"], zlib.crc32(r["ids"])) for r in rows) == sorted(want)
    shuffled = records.read_records(index.repartition(3, F.xxhash64("key", F.lit(9))), PATH, "long")
    assert sorted((r["key"], bytes(r["ids"])) for r in shuffled.collect()) == sorted((r["key"], bytes(r["ids"])) for r in rows)


def test_checksums():
    assert records.crc32c([b"123456789"]).tolist() == [0xE3069283]
    blobs = [random.Random(n).randbytes(n * 37 % 3_000) for n in range(60)]
    frames = [records.frame([one]) for one in blobs]
    assert records.unframe(frames) == blobs
    frames[7] = frames[7][:-5] + bytes([frames[7][-5] ^ 1]) + frames[7][-4:]
    with pytest.raises(ValueError):
        records.unframe(frames)


@pytest.mark.parametrize("hot", [0, 4, 1 << 18])
def test_token_counts(texts, library, hot):
    rows = token_counts.count_tokens(texts, "doc_id", "text", PATH, 512, hot=hot).collect()
    want = [(key, len((text or "").encode()), len(ids), len(ids) > 512) for key, text in TEXTS for ids in [ids_of(library, text)]]
    assert sorted(map(tuple, rows)) == sorted(want)


def slow_fingerprint(text, words):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    found = [word for word in lowered.split(" ") if word]
    shingles = [" ".join(found[at : at + words]) for at in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(one, 42) for one in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in ("", None, "One", "a b c", "a b c d", "A\tb c  D\x1ce É f", "x y " * 300):
        assert simhash.fingerprint(text, 4) & (1 << 64) - 1 == slow_fingerprint(text, 4)


def test_simhash_groups(spark):
    base = " ".join(f"w{n}" for n in range(400))
    rows = [(n, base) for n in range(30)] + [(100 + n, base + " tail") for n in range(3)] + [(200 + n, f"text {n} of its own kind " * 9) for n in range(40)]
    rows += [(300, None), (301, ""), (302, "  "), (200, "text 0 of its own kind " * 9), (None, base), (400, LONG)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fingerprint": F.lit(0), "component_id": F.lit("x")})
    found = simhash.near_duplicates(frame, "doc_id", "text").collect()
    prints = [slow_fingerprint(text, 4) for _, text in rows]
    groups = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            groups[i] = min(groups[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4)
    smallest = {g: min((rows[i][0] for i in range(len(rows)) if groups[i] == g and rows[i][0] is not None), default=None) for g in set(groups)}
    want = [(rows[i][0], f"{prints[i]:016x}", smallest[groups[i]]) for i in range(len(rows))]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_links_over_many_shards(spark):
    generator = np.random.default_rng(1)
    base = generator.integers(0, 1 << 63, 300, dtype=np.uint64)
    points = [base]
    for flips in range(1, 6):
        moved = base.copy()
        for _ in range(flips):
            moved = moved ^ (np.uint64(1) << generator.integers(0, 64, len(moved), dtype=np.uint64))
        points.append(moved)
    points = np.unique(np.concatenate(points))
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points) <= 4)
    want = Links(len(points))
    want.add(i, j)
    frame = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fingerprint long")
    found = simhash.links(frame, 4, shard_points=100, sample=500).collect()
    place = {int(x): at for at, x in enumerate(points.view(np.int64))}
    got = Links(len(points))
    got.add(np.array([place[a] for a, _ in found]), np.array([place[b] for _, b in found]))
    assert (got.settle() == want.settle()).all()


def test_components(spark):
    generator = random.Random(5)
    edges = [(generator.randrange(400), generator.randrange(400)) for _ in range(230)] + [(1000 + n, 1001 + n) for n in range(60)] + [(5000, 6000 + n) for n in range(200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = components(spark.createDataFrame([*edges, (7, None)], "a long, b long")).collect()
    assert sorted(map(tuple, found)) == sorted((x, find(x)) for x in linked)


LANGUAGES = {
    "xx": "the quick brown fox jumps over lazy dogs while nobody watches them run through open fields".split(),
    "yy": "der schnelle braune fuchs springt über den faulen hund während niemand hinter bäumen zusieht".split(),
}


def test_languages(spark):
    generator = random.Random(2)
    rows = [(n, " ".join(generator.choices(LANGUAGES[lang], k=30)), lang) for n in range(400) for lang in [("xx", "yy")[n % 2]]]
    rows += [(1001, None, "xx"), (1002, "", "yy"), (1003, "123 !?", "xx"), (1004, "the fox", None), (1005, "THE QUICK " * 3_000, "xx"), (None, "der hund", "yy")]
    rows += [rows[0]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("?"))
    found = language.identify(frame, "doc_id", "text", "lang", columns=frame.columns).collect()
    assert len(found) == len(rows)
    for row in found:
        if row["doc_id"] in (1001, 1002, 1003):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
        else:
            assert row["lang_pred"] == (row["lang"] or "xx") and 0 <= row["score"] <= 1
    out = [r for r in found if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(out) > 50


def test_no_language_learned(spark):
    frame = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.identify(frame, "doc_id", "text", "lang", columns=["doc_id"]).collect()[0][1:] == ("und", 0.0)
    assert language.identify(frame.limit(0), "doc_id", "text", "lang", columns=["doc_id"]).count() == 0


def test_filters_return_all_languages():
    names = [f"l{n:03d}" for n in range(70)]
    entries = [(chr(97 + n % 26) + chr(97 + n // 26), sorted(random.Random(n).sample(range(70), 3))) for n in range(500)]
    filters = language.LanguageFilters.build(names, entries)
    assert filters.masks.shape[1] == 2
    masks = filters.containing(np.array([ord(a) | ord(b) << language.CODE_BITS for (a, b), _ in entries], np.uint64))
    bits = np.stack([filters._bit(masks, at) for at in range(70)], axis=1)
    assert all(bits[at, numbers].all() for at, (_, numbers) in enumerate(entries))
    assert bits.sum() - 1500 <= 3 * filters.false_rates().sum() * 500 + 20


def test_counts_are_those_of_the_words(monkeypatch):
    """Counting whole texts at once, together or in pieces, is counting the n-grams of their words."""
    texts = ["", "a", "Ab, cd\nE", " über ½x² ", "123", "word " * 50, "x" * 130, "a b"]
    entries = {}
    for at, text in enumerate(texts[1:6]):
        for word in language.words_of(text):
            for gram in language.ngrams(word):
                entries.setdefault(gram, set()).add(at % 3)
    filters = language.LanguageFilters.build(["l0", "l1", "l2"], [(gram, sorted(x)) for gram, x in entries.items()])

    def claimed(text):
        grams = [gram for word in language.words_of(text) for gram in language.ngrams(word)]
        packed = np.array([sum(ord(c) << language.CODE_BITS * at for at, c in enumerate(gram)) for gram in grams], np.uint64)
        masks = filters.containing(packed)
        return [len(grams), *(int(filters._bit(masks, at).sum()) for at in range(3))]

    want = [claimed(text) for text in texts]
    assert filters.counts(texts).tolist() == want
    for size in (1, 2, 7, 40):
        monkeypatch.setattr(language, "PIECE_CHARS", size)
        assert filters.counts(texts).tolist() == want


def test_stages_without_tokenizer_drop_it(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "a word or two", "xx")], "id long, text string, lang string")
    monkeypatch.setattr(near_copies, "shingle_counts", lambda texts, words: np.zeros(near_copies.COUNTERS, np.uint16))
    filters, tasks, take = language.fit(frame, "text", "lang"), [], type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, *args: (tasks.append(run), take(self, run, *args))[1])
    simhash.fingerprints(frame, "id", "text", 5)
    near_copies.shingle_sets(frame, "id", "text", 5, 0.8)
    language.predict(frame, "text", filters, ["id"])
    assert len(tasks) == 3
    for run in tasks:
        codec = transducer._codec(PATH)
        codec.encode(["東京都 naïve " * 50])
        assert codec.encode._memo is pretokens.Memo._holder and records.token_bytes(["x"], PATH)
        list(run(iter([])))
        assert pretokens.Memo._holder is None
        assert not any(cached.cache_info().currsize for cached in (tokenizer_file, transducer._codec, records._encoder))
