"""A training corpus from ``documents``: clean, deduplicate, mix and pack, stage by stage.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table and further columns of any name,
with the results that its operator's docstring defines; all but the last return exactly the columns they got.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.exact import exact_dedup
from millrace.llm.mixing import mix_sources
from millrace.llm.neardup import near_dedup
from millrace.llm.packing import pack_documents
from millrace.llm.toxicity import keep_clean
from millrace.scratch import discard, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the nearest labelled examples don't call toxic; null and empty texts have no neighbours and stay unless most such
    examples are toxic. Without toxic or without clean labels all rows stay."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every text, that of the least doc_id; null texts are one text, empty ones another."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies, that of the least doc_id; null, empty and wordless texts stay."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or thinned so that all sources give equally many tokens; the null source is one, and rows of a source
    without tokens go. The draw depends on the doc_id alone."""
    return mix_sources(docs, seed=1)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every row's tokens in packs of 2,048; longer rows are cut into pieces, rows without tokens have no pack."""
    return pack_documents(docs, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("mixing", mixing),
    ("packing", packing),
]

#: Nearest neighbours, near copies and packing have no SQL; a test holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
