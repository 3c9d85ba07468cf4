"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspark.llm import (
    alignment,
    bpe,
    chat_windows,
    credentials,
    decontaminate,
    minmax,
    pseudonyms,
    quality,
    simhash,
    training_order,
    url_filter,
    warc_audit,
    whitening,
)
from wattspark.llm.common import table
from wattspark.operators.common import scratch_path, settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op1_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = bpe.bpe_decode(bpe.bpe_encode(docs, vocabulary(), pattern=public_tokenizers.PATTERN), vocabulary())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.ids_sha256("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# The vocabulary's ids are below 50,256, so they fit two bytes; these two are no ids of it.
TOKEN_END, TOKEN_PAD = 0xFFFF, 0xFFFE


def training_shards(docs: DataFrame, folder: str) -> DataFrame:
    """Shards of the documents' byte-level BPE ids, two bytes each."""
    # Stored, the ids are made once and read by both passes.
    tokens = bpe.bpe_packed(docs, vocabulary(), pattern=public_tokenizers.PATTERN).select("doc_id", "tokens")
    return training_order.write_shards(tokens, folder, key="training order 1", itemsize=2, end=TOKEN_END, pad=TOKEN_PAD, stage=True)


@query
def op2_training_order(spark: SparkSession, sf: str) -> DataFrame:
    return training_shards(table(spark, sf, "documents").select("doc_id", "text"), scratch_path(spark, "shards"))


# For the drill: pages whose copy in the second replica has decayed.
DECAYED = "page_id % 97 = 13"


@query
def op3_warc_audit(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    here, there = scratch_path(spark, "replica"), scratch_path(spark, "replica")
    settle(warc_audit.write_warc(pages, {here: None, there: F.expr(DECAYED)}))
    a, b = (settle(warc_audit.record_leaves(spark, folder)) for folder in (here, there))
    last = warc_audit.last_numbers(a, b)
    found = warc_audit.audit(warc_audit.merkle_levels(a, *last), warc_audit.merkle_levels(b, *last))
    found = found.select(F.col("g").alias("file_no"), "idx", "status")
    return a.join(found, ["file_no", "idx"], "left").select(
        F.col("page").cast("long").alias("page_id"),
        "file_no",
        F.col("start").alias("byte_offset"),
        F.col("length").alias("n_bytes"),
        F.col("hash").alias("record_sha256"),
        F.coalesce("status", F.lit("intact")).alias("status"),
    )


SQL["op3_warc_audit"] = f"""
WITH p AS (SELECT page_id, coalesce(page_id // {warc_audit.PER_FILE}, 0) AS file_no, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, file_no, url, html, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || replace(replace(url, chr(13), '%0A'), chr(10), '%0A') || chr(13) || chr(10)
    || 'WARC-Payload-Digest: sha256:' || sha256(html) || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(octet_length(encode(html)) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
    || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM p),
s AS (SELECT *, octet_length(encode(record)) AS n_bytes FROM r)
SELECT page_id, file_no,
    CAST(coalesce(sum(n_bytes) OVER (PARTITION BY file_no ORDER BY page_id NULLS FIRST, url, html ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset,
    CAST(n_bytes AS BIGINT) AS n_bytes, sha256(record) AS record_sha256,
    CASE WHEN {DECAYED} AND html <> '' THEN 'differs' ELSE 'intact' END AS status
FROM s"""


@query
def op4_simhash_pivots(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_budgeted_windows(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat_windows.conversation_digests(chat_windows.format_windows(given.unionByName(more)))


SQL["op5_budgeted_windows"] = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w - 1 AS pos, CAST(ceil(length(text) / 4.0) AS BIGINT) + {chat_windows.TURN_TOKENS} AS tok,
    3 + length(url_encode(role)) + 1
    + length(regexp_replace(text, '(<<?/?|\\[/?)(\\\\*)(s>|INST\\]|SYS>>|\\|)', '\\1_\\2\\3', 'g')) + 4 AS chars
    FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, pos = 0 AND role = 'system' AS is_system,
    coalesce(sum(tok) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    max(CASE WHEN pos = 0 AND role = 'system' THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_tok FROM o),
b AS (SELECT *, before - sys_tok AS t0, greatest(floor(({chat_windows.BUDGET} - {chat_windows.HISTORY} - sys_tok) / 2.0), 1) AS half FROM p WHERE NOT is_system),
v AS (SELECT *, 2 * floor(t0 / half) + CAST(tok > half AS INTEGER) AS win FROM b),
w AS (SELECT conv_id, win, min(t0) AS "from" FROM v GROUP BY ALL),
n AS (SELECT conv_id, count(*) AS windows FROM w GROUP BY ALL),
h AS (SELECT v.conv_id, sum(v.chars) AS chars FROM v JOIN w ON v.conv_id = w.conv_id AND v.t0 >= w."from" - {chat_windows.HISTORY} AND v.t0 < w."from" GROUP BY ALL)
SELECT p.conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(CASE WHEN is_system THEN p.chars * greatest(coalesce(n.windows, 0), 1) ELSE p.chars END) + coalesce(max(h.chars), 0) AS BIGINT) AS formatted_chars
FROM p LEFT JOIN n USING (conv_id) LEFT JOIN h USING (conv_id) GROUP BY p.conv_id"""


@query
def op6_certified_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    # Only counts are needed from here on: they are stored once and read for both passes.
    m = settle(docs.select("doc_id", "lang", quality.measure().alias("m")))
    cutoffs = settle(quality.calibrate(m, table(spark, sf, "labels"), "doc_id", "m", "lang"))
    return quality.apply_cutoffs(m, cutoffs, "m", "lang", "kept").select(
        "doc_id",
        *(f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        quality.base_failed("m").alias("base_failed"),
        "kept",
    )


# The rules of the contract, and words that mark unwanted hosts for the labelled table.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
UNWANTED = ["casino", "win", "free", "bets", "cheap", "pills", "ads", "track"]


@query
def op7_url_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    model = url_filter.fit(url_filter.seed_labels(pages, UNWANTED))
    return url_filter.judge(pages, model, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


# Each word of a benchmark phrase may stand this many positions from its place.
SLOP = 1


@query
def op8_positional_index(spark: SparkSession, sf: str) -> DataFrame:
    index = settle(decontaminate.build_index(table(spark, sf, "documents")), decontaminate.STORED)
    found = decontaminate.search_index(index, table(spark, sf, "benchmark"), slop=SLOP)
    exact = F.filter("matches", lambda m: m["exact"])
    items = decontaminate.matched_items(exact)
    hit = decontaminate.covered_words(exact)
    # A place beside an exact match is near it, too: an item counts as near where it has no exact match.
    near = F.array_except(decontaminate.matched_items(F.col("matches")), items)
    return found.select(
        F.col("doc_key").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size(exact) > 0).alias("contaminated"),
        F.size(near).cast("long").alias("n_near_items"),
        F.array_join(near, ",").alias("near_items"),
    )


@query
def op9_feistel_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = pseudonyms.pseudonymise(docs, key="pseudonym key 1")
    n = lambda k: F.size(F.filter("changed", lambda m: m["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(n(k) for k in pseudonyms.KINDS), "text")


@query
def op10_linked_credentials(spark: SparkSession, sf: str) -> DataFrame:
    docs = credentials.secret_spans(table(spark, sf, "documents").select("doc_id", "text"))
    kind = lambda *names: F.filter("spans", lambda s: s["kind"].isin(*names))
    base = ("assign", "access", "hex")
    return docs.select(
        "doc_id",
        *(F.size(kind(k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(credentials.spans_text(kind(*base)), 256).alias("base_sha256"),
        credentials.spans_text(F.col("spans")).alias("spans"),
    )


@query
def op11_exact_whitening(spark: SparkSession, sf: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf, "embeddings"), components=4, scale=256)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


@query
def op12_pair_bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(table(spark, sf, "documents"), a, b)


@query
def op13_minmax_groups(spark: SparkSession, sf: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf, "documents"), size=2, percent=80)
