"""Line dedup: explode, hash, count documents per hash, drop, reassemble by position.

A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at
least ``min_chars`` code points that ``min_documents`` or more documents hold keep their lines in the
smallest document id only.

Only hashes, ids and positions are shuffled by key; hot keys are combined before the shuffle
and their join side is split by AQE. Texts move once, by document, in one copy.

Defined cases: a NULL or empty text is one empty line. Rows with equal ids are one document. NULL ids
together are one document, the last in order. An empty table gives an empty result. Extra columns
are carried along unchanged, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from slicelake.llm.common import SPACES, column, hash128, let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bare(line: Column) -> Column:
    """Without white space at its ends; ``trim`` fills arrays as long as the line, so only lines that need it pay for it."""
    ends = reduce(or_, [F.startswith(line, F.lit(c)) | F.endswith(line, F.lit(c)) for c in SPACES])
    return F.when(ends, F.trim(line, F.lit(SPACES))).otherwise(line)


def _lowered(line: Column) -> Column:
    ascii_only = F.length(line) == F.octet_length(line)
    return F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_keys(text: Column) -> Column:
    """The keys of all lines, each made once: as columns behind ``posexplode`` they would be made again for every use."""
    return F.transform(F.transform(_lines(text), _bare), _lowered)


def mark_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = 10, min_documents: int = 2
) -> DataFrame:
    """``row`` (the document), ``n_lines``, ``n_dropped`` and ``kept`` (the text that stays)."""
    # columns go by place, whatever their names, so that the text is in a row once; ``row`` is put together at the end
    places = [f"c{i}" for i in range(len(docs.columns))]
    place = {name.lower(): at for name, at in zip(docs.columns, places)} | dict(zip(docs.columns, places))
    doc, whole = F.col(place.get(id) or place[id.lower()]), F.coalesce(place.get(text) or place[text.lower()], F.lit(""))
    base = docs.select(*[column(c).alias(at) for c, at in zip(docs.columns, places)]).withColumn("version", F.xxhash64(whole))
    # a row is found again by its id and its text: equal rows have equal lines
    lines = (
        base.select(doc.alias("doc"), "version", F.posexplode(line_keys(whole)).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .select("doc", "version", "pos", hash128(F.col("line")).alias("key"))
    )
    holders = lines.groupBy("key", "doc").agg(F.lit(1).alias("one"))
    repeated = (
        holders.groupBy("key")
        .agg(F.count("one").alias("n"), F.min("doc").alias("first"))
        .where(F.col("n") >= min_documents)
        .select("key", "first")
    )
    drops = (
        lines.join(repeated, "key")
        .where(~F.col("doc").eqNullSafe(F.col("first")))
        .groupBy("doc", "version")
        .agg(F.collect_set("pos").alias("drop"))  # at most the lines of one document
        .select(F.col("doc").alias("d"), F.col("version").alias("v"), "drop")
    )
    joined = base.join(drops, doc.eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    row = F.struct(*[F.col(at).alias(c) for c, at in zip(docs.columns, places)]).alias("row")
    everything = F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1)
    kept = let(
        _lines(F.col("text")),
        lambda line: F.array_join(
            F.transform(F.array_except(everything, F.col("drop")), lambda i: line[i]), "\n"
        ),
    )
    return (
        joined.select(row, whole.alias("text"), "drop")
        .withColumn("n_lines", (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("bigint"))
        .withColumn("n_dropped", F.coalesce(F.size("drop"), F.lit(0)).cast("bigint"))
        .select("row", "n_lines", "n_dropped", F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("kept"))
    )


def drop_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with only the lines that stay; every row stays, if need be with an empty text."""
    marked = mark_lines(docs, id, text, **options)
    return marked.select(
        *[F.col("kept").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    )
