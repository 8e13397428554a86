"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm import bytebpe, compaction, langid, licenses, linededup, merkle, simhash, streamdedup, tokenstore, winnow
from tagmill.llm.common import materialise, read_table, scratch


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in eight batches; after every four the shards are compacted. What the last version holds."""
    docs = read_table(spark, sf_dir, "documents")
    table = compaction.ShardTable(spark, scratch(spark, "shards"), docs.schema)
    for half in (0, 1):
        part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half)
        table.append(part, arrivals=4, by=F.shiftright(F.xxhash64("doc_id"), 1))
        table.compact()
        table.vacuum(keep_versions=1, keep_hours=0)  # there is no other writer
    return table.read().select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica of all pages, in which a byte of every 997th record's body is damaged: every record with its state."""
    pages = read_table(spark, sf_dir, "pages")
    first = materialise(pages.select(F.col("page_id").alias("rec_id"), merkle.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record")), "replica")
    body = F.locate("\r\n\r\n", F.col("record")) + 4
    damaged = F.overlay("record", F.when(F.substr("record", body, F.lit(1)) == "#", "*").otherwise("#"), body)
    second = materialise(first.select("rec_id", F.when((F.pmod("rec_id", F.lit(997)) == 13) & ~F.col("record").endswith("\r\n\r\n\r\n\r\n"), damaged).otherwise(F.col("record")).alias("record")), "replica")
    one, _, found = merkle.fixity(first, second)
    found = found.select(F.col("digest_a").alias("digest"), F.col("offset_a").alias("offset"), "status")
    return merkle.copies(one.records).join(found, ["digest", "offset"], "left").select(F.col("rec_id").alias("page_id"), "offset", "n_bytes", "range_no", F.col("digest").alias("rec_sha256"), F.coalesce("status", F.lit("ok")).alias("status"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document loses, and a digest of what stays."""
    docs = read_table(spark, sf_dir, "documents")
    kept = linededup.LineIndex.build(docs).apply(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document."""
    return bytebpe.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids to Re-Pair shards, and read the files back."""
    path = scratch(spark, "token-shards")
    tokenstore.write_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, path=path)
    return tokenstore.read_shards(spark, path)


def op8_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts, and the one that stays, of every document."""
    return streamdedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


def op9_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark passages in every document."""
    return winnow.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("spans")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return licenses.scan(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_token_shards": op2_token_shards,
    "op3_simhash": op3_simhash,
    "op4_compaction": op4_compaction,
    "op5_merkle": op5_merkle,
    "op6_line_dedup": op6_line_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_stream_dedup": op8_stream_dedup,
    "op9_winnow": op9_winnow,
    "op10_licenses": op10_licenses,
}

ORACLES: dict[str, str] = {
    "op4_compaction": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents",
    "op5_merkle": r"""
        WITH r AS (
            SELECT page_id, html, concat('WARC/1.1', n, 'WARC-Type: response', n, 'WARC-Target-URI: ', coalesce(url, ''), n, 'WARC-Record-ID: <urn:page:', page_id, '>', n,
                'Content-Length: ', octet_length(encode(coalesce(html, ''))), n, n, coalesce(html, ''), n, n) AS record
            FROM pages, (SELECT concat(chr(13), chr(10)) AS n)),
        d AS (SELECT page_id, html, CAST(octet_length(encode(record)) AS BIGINT) AS n_bytes, sha256(record) AS rec_sha256 FROM r),
        o AS (SELECT *, CAST(sum(n_bytes) OVER (ORDER BY page_id, rec_sha256 ROWS UNBOUNDED PRECEDING) - n_bytes AS BIGINT) AS "offset" FROM d)
        SELECT page_id, "offset", n_bytes, "offset" // 262144 AS range_no, rec_sha256, CASE WHEN page_id % 997 = 13 AND coalesce(html, '') <> '' THEN 'changed' ELSE 'ok' END AS status FROM o""",
    "op6_line_dedup": r"""
        WITH l AS (
            SELECT rid, doc_id, i, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT rid, doc_id, s[i] AS line, i FROM (SELECT rid, doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)))),
        c AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT rid) >= 5),
        d AS (SELECT l.*, coalesce(doc_id <> last, false) AS gone FROM l LEFT JOIN c USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM d GROUP BY rid, doc_id""",
    "op8_stream_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op9_winnow": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        i AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        iw AS (
            SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
            FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
        dw AS (
            SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM w, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
        h AS (SELECT doc_id, item_id, p, dw.n FROM dw JOIN iw USING (win)),
        hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
        hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
}
