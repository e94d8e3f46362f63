"""The registered queries of this subpackage, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import PATTERN, path as vocabulary
from pyspark.sql import DataFrame, SparkSession, functions as F

from slicelake.llm import alignment, byte_bpe, conversations, decontaminate, line_dedup, minhash, quality_rules, sharding, suffix_dedup, token_counts, token_files, toxicity, warc
from slicelake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("row.doc_id", "judged.*")


@query(
    "op7_line_dedup",
    r"""
WITH lines AS (
  SELECT doc_id, pos, line,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), repeated AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.first AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.mark_lines(docs).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), PATTERN, with_ids=False)
    return encoded.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, vocabulary("word_bpe_49k.json"))
    return counted.select("row.doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = token_files.token_files(docs, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.digests(read).withColumnRenamed("doc", "doc_id")


@query("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs, 24).select(
        F.col("doc").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op9_warc")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.read_archives(warc.write_archives(pages), with_payload=False)


@query("op5_minhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, words=4).select(
        F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept"
    )


@query("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return leaks.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "score")


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    repeats = suffix_dedup.find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return repeats.select(
        F.col("doc").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"),
        (F.col("end") - F.col("start")).alias("n_words"), F.col("other").alias("other_doc_id"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults of known kinds, by a hash of each row; ``present`` is false for rows that are dropped."""
    blank = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn"))
    code = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    copies = F.when(code == 0, F.array(F.lit(False))).when(code == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))
    role, text = (F.coalesce(F.col(c), blank) for c in ("role", "text"))
    return rows.select(
        "conv_id", "turn",
        F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("present"),
    )


@query("op11_conversations")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(damaged(table(spark, sf_dir, "conversations")), present="present")


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    labels = table(spark, sf_dir, "labels").where(remainder != 0).select("doc_id", "toxic")
    scored = toxicity.score_documents(docs, labels).select("row.doc_id", "score", "predicted")
    return scored.withColumn("held_out", F.coalesce(remainder == 0, F.lit(False)))


@query("op13_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    return alignment.align_corpus(docs, *paths, with_groups=False).select(
        "row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
