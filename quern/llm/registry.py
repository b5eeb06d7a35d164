"""Queries of the corpus operators with their production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import exact_dedup, langid, license_scan, line_dedup, packing, pieces, simhash, suffix_dedup, topk, warc
from .shared import shipped


def op1_warc(spark, sf_dir):
    """Every page as a WARC record in seekable Zstandard bundles, read back from them."""
    archive = warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_archive(archive, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_topk(spark, sf_dir):
    """The five best candidates for each vector whose vec_id is divisible by 50."""
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op3_simhash(spark, sf_dir):
    """SimHash of 3-word shingles; documents within 3 bits are linked."""
    return simhash.near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, radius=3)


def op4_packing(spark, sf_dir):
    """Documents as sequences of at most 2048 tokens."""
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def op6_langid(spark, sf_dir):
    """Language of every document, learned from the labelled documents that are not held out."""
    return langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_line_dedup(spark, sf_dir):
    """Documents without the line templates that recur across documents, as digests."""
    return line_dedup.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_exact_dedup(spark, sf_dir):
    """Exact dedup of documents: of equal texts the one with the largest doc_id stays."""
    return exact_dedup.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


def op8_pieces(spark, sf_dir):
    """SentencePiece ids and decoded text of every document, as digests."""
    return pieces.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_suffix_dedup(spark, sf_dir):
    """Documents without byte strings of 50 bytes that documents with smaller ids hold, as digests."""
    return suffix_dedup.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_license_scan(spark, sf_dir):
    """Licence notices of every document, by Dice coefficient of 0.8 or more."""
    return license_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_topk": op2_topk,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_langid": op6_langid,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_pieces": op8_pieces,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_license_scan": op10_license_scan,
}
QUERIES = {name: shipped(query) for name, query in QUERIES.items()}

ORACLE = {
    "op10_license_scan": license_scan.scan_sql(),
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        q AS (SELECT page_id, body, CASE WHEN strlen(body) >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS first FROM p)
        SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM q""",
    "op2_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r),
        r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
