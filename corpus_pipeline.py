"""The corpus pipeline: judge, clean, de-duplicate, decontaminate and encode ``documents``.

Each stage takes all rows that the one before it kept, is written as Parquet and read again.
"""

from __future__ import annotations

from public_tokenizers import PATTERN, path as vocabulary
from pyspark.sql import DataFrame, SparkSession, functions as F

from slicelake.llm import byte_bpe, decontaminate, line_dedup, minhash, quality_rules
from slicelake.llm.common import SPACES, column, ready, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the learned decision list go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the smallest id; ``n_chars`` follows the text. Documents left without words go."""
    ready(spark)
    cleaned = line_dedup.drop_repeated_lines(docs).where(F.trim("text", F.lit(SPACES)) != "")
    length = F.length("text").cast("bigint").alias("n_chars")
    return cleaned.select(*[length if c == "n_chars" else column(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id."""
    ready(spark)
    return minhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, the ids, their digest, and the digest of the bytes they decode to."""
    ready(spark)
    docs = docs.select("doc_id", "text")
    encoded = byte_bpe.encode_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), PATTERN)
    return encoded.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark),
    ("tokens", tokens),
]
ORACLE_SQL = None  # the learned list, signatures, alignments and merges have no SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
