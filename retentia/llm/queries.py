"""Registered queries of the subpackage, each beside the SQL it must agree with where SQL can state it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.functions.scratch import materialize, scratch_path
from retentia.llm.arc import archive_pages
from retentia.llm.dimension_scan import nearest
from retentia.llm.files import spread
from retentia.llm.hilbert import shard_rows
from retentia.llm.language import held_out, identify
from retentia.llm.mixing import mix, word_count
from retentia.llm.periodic import periodic_runs, with_planted_period
from retentia.llm.prefix_trie import EMPTY_SHA256, id_list_digests, number_turns, prefix_trie, rebuilt
from retentia.llm.records import read_index, read_records, write_records
from retentia.llm.repeats import drop_repeats
from retentia.llm.simhash import near_duplicates
from retentia.llm.spherical import near_duplicates as near_vectors
from retentia.llm.token_counts import count_tokens
from retentia.llm.transducer import digests, encode_decode

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BYTE_BPE = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can state it, its oracle."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_BASE32 = """list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(x, (5 * i // 4 + 1)::BIGINT, 2))::BIGINT >> (3 - 5 * i % 4)::BIGINT) & 31) + 1)::BIGINT, 1)), 'string_agg', '')"""


@query(
    "op1_arc_to_warc",
    f"""WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
          t AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS largest FROM d)
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
          CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> largest THEN largest END AS refers_to FROM t""",
)
def op1_arc_to_warc(spark, folder):
    read = archive_pages(table(spark, folder, "pages"), "page_id", "url", "html", scratch_path(spark, "archives"), least_bytes=0)
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op2_spherical_cells",
    """WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
          links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
          reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
          smallest AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
        SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN smallest ON a = vec_id""",
)
def op2_spherical_cells(spark, folder):
    return near_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding", "label", threshold=0.98)


@query("op3_simhash")
def op3_simhash(spark, folder):
    return near_duplicates(table(spark, folder, "documents"), "doc_id", "text", words=4, reach=4)


@query("op4_hilbert_shards")
def op4_hilbert_shards(spark, folder):
    documents = table(spark, folder, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    sharded = shard_rows(documents.withColumn("size", size), "doc_id", ["lang", "source", "size"], shards=16)
    return sharded.select(
        "doc_id",
        "size",
        F.crc32("text").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_dimension_scan")
def op5_dimension_scan(spark, folder):
    found = nearest(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("key") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("neighbour_id").alias("vec_id"), "score")


@query("op6_language_filters")
def op6_language_filters(spark, folder):
    found = identify(table(spark, folder, "documents"), "doc_id", "text", "lang", columns=["doc_id"], folds=5)
    return found.select("doc_id", held_out("doc_id", 5).alias("held_out"), "lang_pred", "score")


@query("op7_framed_records")
def op7_framed_records(spark, folder):
    documents, path = table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE)
    files = write_records(documents, "doc_id", "text", path, scratch_path(spark, "records"))
    index = spread(read_index(files, "long")).sortWithinPartitions("file", "offset")
    records = read_records(index, path, "long")
    return records.select(
        F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query("op8_bpe_transducer")
def op8_bpe_transducer(spark, folder):
    documents = table(spark, folder, "documents")
    return digests(encode_decode(documents, "doc_id", "text", public_tokenizers.path(BYTE_BPE)))


@query("op9_token_counts")
def op9_token_counts(spark, folder):
    documents = table(spark, folder, "documents")
    return count_tokens(documents, "doc_id", "text", public_tokenizers.path(BYTE_BPE), 512)


@query("op10_flow_mix")
def op10_flow_mix(spark, folder):
    documents = table(spark, folder, "documents")
    # Counted once and written: the mix reads its rows twice.
    sized = materialize(documents.select("doc_id", "source", word_count("text").alias("words")), "sized")
    mixed = mix(sized, "doc_id", F.col("words"), F.array("source"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
# CRC-32 of a decimal number, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda r, i: xor(r >> 1, (r & 1) * 3988292384))))"""


@query(
    "op11_periodic_runs",
    f"""WITH d AS (SELECT doc_id, {_WORDS} AS o, {_CRC32.format('doc_id')} AS h FROM documents),
          p AS (SELECT *, len(o) AS n, h // 10 AS g FROM d),
          q AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM p),
          r AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN o ELSE list_transform(range(n), lambda i: o[(CASE WHEN i >= a
            THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END + 1)::BIGINT]) END AS w FROM q),
          t AS (SELECT doc_id, unnest(range(n)) AS pos, unnest(w) AS word FROM r),
          grams AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i + 1 : i + 16], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(n - 15)) AS i FROM r WHERE n >= 16)),
          pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS gap FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i),
          islands AS (SELECT doc_id, gap, i, i - row_number() OVER (PARTITION BY doc_id, gap ORDER BY i) AS island FROM pairs),
          stretches AS (SELECT doc_id, gap, min(i) AS start, count(*) + 15 + gap AS length FROM islands GROUP BY doc_id, gap, island),
          runs AS MATERIALIZED (SELECT doc_id, start, length, min(gap) AS period FROM stretches WHERE length >= greatest(24, 3 * gap) GROUP BY doc_id, start, length),
          listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
          best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
          gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS pos FROM runs),
          kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM t ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
          sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM r LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
)
def op11_periodic_runs(spark, folder):
    documents = table(spark, folder, "documents")
    runs = periodic_runs(documents, "doc_id", with_planted_period(F.col("doc_id"), F.col("text")))
    line = lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n"))
    best = F.col("strongest")
    return runs.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    "op12_prefix_trie",
    f"""WITH t AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
          l AS (SELECT conv_id, list(turn ORDER BY place) AS turns, {_CRC32.format('conv_id')} % 6 AS h FROM t GROUP BY conv_id),
          c AS (SELECT l.conv_id, coalesce(b.turns[1:l.h], []) || l.turns[l.h + 1:] AS turns FROM l LEFT JOIN l b ON b.conv_id = l.conv_id - l.conv_id % 100),
          p AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM c),
          nodes AS MATERIALIZED (SELECT turns[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY ALL),
          children AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
          parents AS (SELECT n.prefix, u.conv_id AS parent_conv_id FROM nodes n JOIN nodes u ON n.depth = u.depth + 1 AND n.prefix[1:n.depth - 1] = u.prefix),
          up AS (SELECT prefix AS below, unnest(range(depth + 1)) AS height, depth, n_convs, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (prefix)),
          sums AS (SELECT below[1:height] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves,
            sum(CASE WHEN depth > 0 THEN (n_convs - 1) * length(below[depth].text) ELSE 0 END)::BIGINT AS saved_tokens FROM up GROUP BY ALL),
          ends AS (SELECT turns AS prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM c GROUP BY turns)
        SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM nodes JOIN sums USING (prefix) LEFT JOIN children USING (prefix) LEFT JOIN parents USING (prefix) LEFT JOIN ends USING (prefix)""",
)
def op12_prefix_trie(spark, folder):
    """Prefixes of conversations that begin as others, with what sharing them saves."""
    turns = materialize(number_turns(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text"), "turns")
    nodes, ends = prefix_trie(*rebuilt(turns))
    digests = F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")
    joined = nodes.join(id_list_digests(ends), "name", "left")
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digests)


@query(
    "op13_repeats",
    f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
          windows AS MATERIALIZED (SELECT doc_id, i, sha256(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
          firsts AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
          gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM windows JOIN firsts USING (h) WHERE doc_id > least),
          t AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM d),
          kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM t ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
)
def op13_repeats(spark, folder):
    """Words that the passages of earlier documents cover, taken out."""
    kept = drop_repeats(table(spark, folder, "documents"), "doc_id", "text", length=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
