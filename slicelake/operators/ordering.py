"""Ordered processing lanes (D1-D8) and duplicate deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slicelake.operators import skew
from slicelake.operators.metrics import exact_percentile

IDEMPOTENCY = ["event_id", "version", "action"]
ENTRY_ORDER = ["event_time", "received_at", "id"]


def lane_key(scope: str = "table") -> Column:
    if scope == "table":
        return F.concat(F.lit("table:"), F.col("target_database"), F.lit("."), F.col("target_table"))
    if scope == "mapping":
        return F.concat(F.lit("mapping:"), F.col("mapping_id").cast("string"))
    raise ValueError("Lane scope must be table or mapping.")


def lane_order(df: DataFrame, block_rows: int = skew.BLOCK_ROWS) -> DataFrame:
    """Position of each entry in its lane by event time, arrival, id.

    A lane can hold most of the entries, and most of them can have one time: blocks are cut by position in
    the whole order, so that they are of equal size.
    """
    return skew.rank_numbered(df, ["lane"], ENTRY_ORDER, "lane_position", block_rows)


def grace_flags(df: DataFrame, seconds: int, block_rows: int = skew.BLOCK_ROWS) -> DataFrame:
    """When an entry may run, and whether a later event had already arrived before it."""
    seen = skew.running_numbered(
        df, ["lane"], ["received_at", "id"], {"_seen": ("max", F.col("event_time"))}, block_rows, inclusive=False
    )
    return seen.withColumns(
        {
            "eligible_at": F.col("received_at") + F.expr(f"INTERVAL '{int(seconds)}' SECOND"),
            "late": F.coalesce(F.col("_seen") > F.col("event_time"), F.lit(False)),
        }
    ).drop("_seen")


def head_of_line(
    df: DataFrame, terminal: tuple[str, ...] = ("SUCCESS",), block_rows: int = skew.BLOCK_ROWS
) -> DataFrame:
    """Entries behind an earlier one of their lane that has not ended are blocked."""
    open_ = F.when(~F.col("status").isin(*terminal), F.lit(1)).otherwise(F.lit(0))
    marked = skew.running_numbered(df, ["lane"], ENTRY_ORDER, {"_open": ("max", open_)}, block_rows, inclusive=False)
    return marked.withColumn("blocked", F.coalesce(F.col("_open") == 1, F.lit(False))).drop("_open")


def stale_guard(df: DataFrame, source: list[str]) -> DataFrame:
    """Marks loads older than the newest version or delete known for their source."""
    newest = df.groupBy(*source).agg(F.max(F.struct("event_time", "received_at", "id")).alias("_newest"))
    own = F.struct("event_time", "received_at", "id")
    return (
        df.join(newest, source)
        .withColumn("stale", (F.col("action") != "DELETE") & (own < F.col("_newest")))
        .drop("_newest")
    )


def idempotency_key(event_id: Column, version: Column, action: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", event_id.cast("string"), version, action), 256)


def dedup_events(df: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """One row per delivery key. On a stream, keys are forgotten once the watermark passes them."""
    if watermark:
        column, delay = watermark
        return df.withWatermark(column, delay).dropDuplicatesWithinWatermark(IDEMPOTENCY)
    return df.dropDuplicates(IDEMPOTENCY)


def budget_check(
    queue: DataFrame,
    history: DataFrame,
    min_start: float = 30.0,
    factor: float = 1.35,
    reserve: float = 20.0,
    budget: float = 300.0,
) -> DataFrame:
    """START, DEFER or BLOCKED per waiting entry.

    ``history``: finished loads with ``mapping_id, seconds``; ``queue``: entries with
    ``mapping_id, remaining_seconds``. An entry needs the larger of the minimum start time and
    the mapping's 95th percentile times ``factor``, plus the reserve; one that would not even
    fit a whole budget is BLOCKED.
    """
    usual = exact_percentile(history, ["mapping_id"], "seconds", 0.95, "p95_seconds")
    need = F.greatest(F.lit(min_start), F.coalesce(F.col("p95_seconds"), F.lit(0.0)) * factor) + reserve
    return (
        queue.join(usual, "mapping_id", "left")
        .withColumn("needed_seconds", need)
        .withColumn(
            "decision",
            F.when(F.col("needed_seconds") > budget, "BLOCKED")
            .when(F.col("remaining_seconds") > F.col("needed_seconds"), "START")
            .otherwise("DEFER"),
        )
    )


def manifest_status(manifest: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A data set is complete when chunks 1..n all succeeded with the rows they announce.

    ``manifest``: ``dataset, chunk, chunks, rows, resource_name``; ``outcomes``: one final row per
    object with ``resource_name, event_status, loaded_rows``.
    """
    good = F.coalesce(
        (F.col("event_status") == "SUCCESS") & (F.col("loaded_rows") == F.col("rows")), F.lit(False)
    )
    in_range = F.col("chunk").between(1, F.col("chunks"))
    # one row per chunk first: repeated manifest lines of a chunk must all be good
    chunks = manifest.join(outcomes, "resource_name", "left").groupBy("dataset", "chunk").agg(
        F.max("chunks").alias("chunks"), F.bool_and(good & in_range).alias("good")
    )
    return chunks.groupBy("dataset").agg(
        F.max("chunks").cast("bigint").alias("expected_chunks"),
        F.count_if("good").alias("good_chunks"),
        F.bool_and("good").alias("_all"),
    ).select(
        "dataset", "expected_chunks", "good_chunks",
        (F.col("_all") & (F.col("good_chunks") == F.col("expected_chunks"))).alias("complete"),
    )
