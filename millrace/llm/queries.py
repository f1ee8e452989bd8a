"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import scratch_root
from .chat import format_chats
from .exact import exact_dedup
from .fingerprints import fingerprint
from .licenses import scan_licenses
from .mixing import mix_sources
from .neardup import near_duplicates
from .packing import pack_documents
from .repeats import find_repeats
from .tokenids import pack_token_ids, write_packed
from .toxicity import score_toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents"))


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), capacity=2048)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(_read(spark, sf_dir, "documents"), min_words=50, block=25, maximal=True)


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"), count="copies")


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_token_ids(_read(spark, sf_dir, "documents"), capacity=2048)
    return write_packed(packed, f"{scratch_root(spark)}/packed-{uuid.uuid4().hex[:12]}")


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_read(spark, sf_dir, "conversations"))


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"), seed=1, copy="copy")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(_read(spark, sf_dir, "documents"))


def packing_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op2: the pieces of every document."""
    return packing(spark, sf_dir).select("doc_id", "piece", "start", "n_tokens")


def packing_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op2's packs: that none is beyond the capacity and that slots and offsets follow one another without a gap."""
    at = Window.partitionBy("pack_id").orderBy("slot")
    p = packing(spark, sf_dir).filter("pack_id is not null")
    p = p.withColumn("due", F.coalesce(F.sum("n_tokens").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("nth", F.row_number().over(at) - 1)
    return p.agg(F.sum("n_tokens").alias("tokens"), (F.max(F.col("pack_offset") + F.col("n_tokens")) <= 2048).alias("fits"), F.bool_and((F.col("due") == F.col("pack_offset")) & (F.col("nth") == F.col("slot"))).alias("dense"))


def fingerprint_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op10: every document's number of terms and samples."""
    return fingerprints(spark, sf_dir).select("doc_id", "n_terms", F.coalesce(F.size("signature"), F.lit(0)).alias("samples"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": license_scan,
    "op2_packing": packing,
    "op3_substring_dedup": substring_dedup,
    "op4_exact_dedup": dedup_exact,
    "op5_minhash_near_dedup": minhash_near_dedup,
    "op6_token_ids": token_ids,
    "op7_chat_format": chat_format,
    "op8_mixing": mixing,
    "op9_toxicity": toxicity,
    "op10_fingerprints": fingerprints,
    "packing_pieces": packing_pieces,
    "packing_fill": packing_fill,
    "fingerprint_terms": fingerprint_terms,
}

ORACLES: dict[str, str] = {
    "packing_pieces": """
        SELECT doc_id, piece::INTEGER AS piece, piece * 2048 AS start, least(2048, n - piece * 2048)::INTEGER AS n_tokens
        FROM (SELECT doc_id, n, unnest(range(greatest(1, ceil(n / 2048.0))::BIGINT)) AS piece
              FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS n FROM documents))
    """,
    "packing_fill": """
        SELECT sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')))::BIGINT AS tokens, true AS fits, true AS dense FROM documents
    """,
    "fingerprint_terms": """
        SELECT doc_id, n::INTEGER AS n_terms, CASE WHEN n > 0 THEN 64 ELSE 0 END AS samples
        FROM (SELECT doc_id, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\\x{80}-\\x{10FFFF}]+'))) AS n FROM documents)
    """,
    "op4_exact_dedup": """
        SELECT doc_id, text, lang, source, n_chars, copies
        FROM (SELECT *, count(*) OVER (PARTITION BY text) AS copies,
                     row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, lang, source, n_chars) AS nth
              FROM documents)
        WHERE nth = 1
    """,
    "op7_chat_format": """
        WITH whole AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(length(role)::VARCHAR || ':' || role || length(text)::VARCHAR || ':' || text, '' ORDER BY turn, role, text) AS log,
                   string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
            FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
            GROUP BY conv_id)
        SELECT conv_id, n_turns::INTEGER AS n_turns, rendered FROM whole a
        WHERE NOT EXISTS (SELECT 1 FROM whole b
                          WHERE (b.log = a.log AND b.conv_id < a.conv_id)
                             OR (b.n_turns > a.n_turns AND starts_with(b.log, a.log)))
    """,
    "op8_mixing": """
        WITH sized AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS toks FROM documents),
             per AS (SELECT source, sum(toks) AS tokens FROM sized GROUP BY source HAVING sum(toks) > 0),
             rates AS (SELECT source, 1.0::DOUBLE * (SELECT sum(tokens)::DOUBLE FROM per) / ((SELECT count(*)::DOUBLE FROM per) * tokens) AS rate FROM per),
             drawn AS (SELECT d.*, floor(rate) + CASE WHEN ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < rate - floor(rate) THEN 1 ELSE 0 END AS n
                       FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n::BIGINT + 1))::INTEGER AS copy FROM drawn WHERE n > 0
    """,
}
