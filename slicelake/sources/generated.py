"""Deterministic benchmark rows by count or by byte size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slicelake.operators import skew

HEADER_BYTES = 43  # length of the header line with its line end
EVENT_TS = "2026-07-19 12:00:00.000000"  # fixed value of every row


def benchmark_row(record_id: Column, payload_bytes: int) -> list[Column]:
    return [
        record_id.alias("record_id"),
        F.lit(EVENT_TS).alias("event_ts"),
        F.concat(F.lit("group-"), F.lpad((record_id % 16).cast("string"), 2, "0")).alias("category"),
        F.repeat(F.lit("x"), payload_bytes).alias("payload"),
        F.concat((record_id % 10000).cast("string"), F.lit(".25")).alias("amount"),
    ]


def row_bytes(record_id: Column, payload_bytes: int) -> Column:
    """Length of the CSV line: id, timestamp, category, payload, amount, four commas, line end."""
    digits = F.length(record_id.cast("string")) + F.length((record_id % 10000).cast("string"))
    return (digits + F.lit(len(EVENT_TS) + len("group-00") + payload_bytes + len(".25") + 5)).cast("bigint")


def _check(payload_bytes: int) -> None:
    if not 1 <= payload_bytes <= 512:
        raise ValueError("payload size must be from 1 to 512")


def generate_rows(spark: SparkSession, rows: int, start_id: int = 1, payload_bytes: int = 128, partitions: int | None = None) -> DataFrame:
    _check(payload_bytes)
    ids = spark.range(start_id, start_id + rows, numPartitions=partitions)
    return ids.select(*benchmark_row(F.col("id"), payload_bytes))


def rows_for_bytes(target_bytes: int, start_id: int = 1, payload_bytes: int = 128) -> int:
    """How many rows bring the file to at least ``target_bytes``.

    Rows are equally long while the digits of the id do not change, except for the amount,
    whose length cycles every 10,000 ids; whole cycles are skipped over, so the answer
    costs a few steps per digit instead of a pass over the rows.
    """
    _check(payload_bytes)
    fixed = len(EVENT_TS) + len("group-00") + payload_bytes + len(".25") + 5
    length = lambda i: fixed + len(str(i)) + len(str(i % 10000))
    cycle_amount = 10 * 1 + 90 * 2 + 900 * 3 + 9000 * 4
    written, record, rows = HEADER_BYTES, start_id, 0
    while written < target_bytes:
        same_digits = 10 ** len(str(record)) - record
        cycle = 10000 * (fixed + len(str(record))) + cycle_amount
        cycles = min(same_digits // 10000, (target_bytes - written) // cycle)
        if cycles > 0:
            written, record, rows = written + cycles * cycle, record + cycles * 10000, rows + cycles * 10000
            continue
        written, record, rows = written + length(record), record + 1, rows + 1
    return rows


def generate_bytes(spark: SparkSession, target_bytes: int, start_id: int = 1, payload_bytes: int = 128, partitions: int | None = None) -> DataFrame:
    return generate_rows(spark, rows_for_bytes(target_bytes, start_id, payload_bytes), start_id, payload_bytes, partitions)


def limit_bytes(ids: DataFrame, target_bytes: int | Column, payload_bytes: int = 128) -> DataFrame:
    """Rows for the ids of ``ids`` (``id``), in id order, while the bytes before a row are below the target.

    The bytes before a row come from per-block totals plus a sum inside the block.
    """
    _check(payload_bytes)
    size = row_bytes(F.col("id"), payload_bytes)
    summed = skew.running(
        ids, [], [F.col("id")], skew.seq_block("id"), {"_before": ("sum", size)}, inclusive=False
    )
    return summed.where(F.col("_before") + HEADER_BYTES < target_bytes).select(
        *benchmark_row(F.col("id"), payload_bytes)
    )
