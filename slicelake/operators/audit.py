"""Reading the control tables: timing, links, activity, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slicelake.functions import events as ev
from slicelake.operators.lifecycle import TARGET
from slicelake.operators.skew import latest_per_key, running, seq_block

TIMING = {"event_received_at": "received_at", "event_completed_at": "completed_at", "event_duration_ms": "duration_ms"}


def _link(link: Column, own_id: Column) -> Column:
    """A join key that spreads missing links: real ids are never negative, so these match nothing."""
    return F.coalesce(link, -own_id - 1)


def with_timing(tx: DataFrame, raw: DataFrame) -> DataFrame:
    """Audit rows with the raw event's timing and the mode recorded at execution."""
    events = raw.select(
        F.col("id").alias("_link"),
        F.col("invocation_mode").alias("_event_mode"),
        *[F.col(source).alias(name) for name, source in TIMING.items()],
    )
    return (
        tx.withColumn("_link", _link(F.col("object_event_id"), F.col("id")))
        .join(events, "_link", "left")
        .withColumn("invocation_mode", ev.mode_snapshot(F.col("invocation_mode"), F.col("_event_mode")))
        .select(*tx.columns, *TIMING)
    )


def detached_processes(tx: DataFrame, mappings: DataFrame, limit: int = 200) -> DataFrame:
    """Newest detached transactions with the mapping's current worker count."""
    newest = (
        tx.withColumn("invocation_mode", F.coalesce("invocation_mode", F.lit("UNKNOWN")))
        .where(F.col("invocation_mode") == "DETACHED")
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(limit)
    )
    workers = mappings.select(F.col("id").alias("mapping_id"), "worker_threads")
    return newest.join(workers, "mapping_id", "left").select(
        "id", "mapping_id", "event_action", "event_status", *TARGET, "bucket_name", "resource_name",
        "message", "created_at", "invocation_mode",
        F.coalesce("worker_threads", F.lit(4)).cast("int").alias("worker_threads"),
    )


def registered_tables(mappings: DataFrame, tx: DataFrame | None = None) -> DataFrame:
    """Mappings and logged events per target. Both sides are reduced before they meet."""
    registered = mappings.groupBy(*TARGET).agg(F.count(F.lit(1)).alias("mapping_count"))
    if tx is None:
        return registered.withColumns(
            {"event_count": F.lit(0).cast("bigint"), "last_event_at": F.lit(None).cast("timestamp_ntz")}
        )
    logged = tx.groupBy(*TARGET).agg(
        F.count(F.lit(1)).alias("event_count"), F.max("created_at").alias("last_event_at")
    )
    return (
        registered.join(logged, TARGET, "left")
        .withColumn("event_count", F.coalesce("event_count", F.lit(0)))
        .orderBy(F.desc("last_event_at"), *TARGET)
    )


def link_lifecycle(raw: DataFrame, tx: DataFrame, errors: DataFrame) -> DataFrame:
    """Each raw event with the outcome of its latest transaction.

    First by the recorded event id; rows without one fall back to the latest unlinked
    transaction of the same bucket, object and action (NULLs compare equal); then to
    the raw timing columns.
    """
    worst = errors.groupBy(F.col("event_log_id").alias("id")).agg(F.max("id").alias("error_id"))
    outcome = tx.select(
        "id", "object_event_id", "bucket_name", "resource_name", "event_action", "created_at", "event_status",
        F.coalesce("invocation_mode", F.lit("UNKNOWN")).alias("mode"),
    )
    linked = latest_per_key(
        outcome.where(F.col("object_event_id").isNotNull()).select("object_event_id", "id", "event_status", "mode"),
        ["object_event_id"],
        ["id"],
    ).join(worst, "id", "left").select(
        F.col("object_event_id").alias("_link"), F.struct("event_status", "mode", "error_id").alias("_direct")
    )
    identity = _identity("bucket_name", "resource_name", "event_action")
    loose = latest_per_key(
        outcome.where(F.col("object_event_id").isNull())
        .withColumn("_key", identity)
        .select("_key", "created_at", "id", "event_status", "mode"),
        ["_key"],
        ["created_at", "id"],
    ).join(worst, "id", "left").select("_key", F.struct("event_status", "mode", "error_id").alias("_loose"))

    action = ev.event_action(F.col("event_type"))
    joined = (
        raw.join(linked, raw["id"] == linked["_link"], "left")
        .withColumn("event_action", action)
        .withColumn(
            "_key",
            # rows that need no fallback get a key of their own, so they spread
            F.when(F.col("_direct").isNull() & F.col("event_action").isNotNull(), identity).otherwise(
                F.concat(F.lit("\x1e"), raw["id"].cast("string"))
            ),
        )
        .join(loose, "_key", "left")
        .withColumn("_found", F.coalesce("_direct", "_loose"))
    )
    return joined.select(
        *[raw[c] for c in raw.columns if c != "invocation_mode"],
        F.coalesce("_found.event_status", ev.raw_lifecycle(F.col("completed_at"))).alias("lifecycle_status"),
        F.col("_found.error_id").alias("error_id"),
        F.coalesce("_found.mode", raw["invocation_mode"], F.lit("UNKNOWN")).alias("invocation_mode"),
    )


def _identity(*columns: str) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("\x00")) for c in columns])


def visible_rows(data: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows whose attempt is the one its slice shows. Slice and attempt are partition columns
    of a lake table, so the semi join also prunes files."""
    shown = registry.where(F.col("visible_attempt").isNotNull()).select(
        *TARGET, "batch_num", F.col("visible_attempt").alias("attempt")
    )
    return data.join(shown, [*TARGET, "batch_num", "attempt"], "left_semi")


def target_view(data: DataFrame, registry: DataFrame, database: str, table: str) -> DataFrame:
    """What a reader of one target sees: visible rows without the hidden columns."""
    mine = (F.col("target_database") == database) & (F.col("target_table") == table)
    hidden = [*TARGET, "batch_num", "attempt", "mapping_id", "bucket_name", "resource_name"]
    return visible_rows(data.where(mine), registry.where(mine)).drop(*hidden)


def registered_only(df: DataFrame, mappings: DataFrame) -> DataFrame:
    return df.join(mappings.select(*TARGET), TARGET, "left_semi")


def orphan_attempts(attempts: DataFrame, registry: DataFrame, as_of, stale_seconds: int = 600) -> DataFrame:
    """Staged data no slice shows. ``blocked`` while its target has a recent load in progress."""
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    shown = registry.where(F.col("visible_attempt").isNotNull()).select(
        *TARGET, "batch_num", F.col("visible_attempt").alias("attempt")
    )
    fresh = F.timestamp_diff("SECOND", F.col("updated_at"), as_of) <= stale_seconds
    busy = (
        registry.where((F.col("lifecycle_state") == "LOADING") & fresh)
        .select(*TARGET)
        .distinct()
        .withColumn("_busy", F.lit(True))
    )
    return (
        attempts.join(shown, [*TARGET, "batch_num", "attempt"], "left_anti")
        .join(busy, TARGET, "left")
        .withColumn("blocked", F.coalesce("_busy", F.lit(False)))
        .drop("_busy")
    )


def verify_load(tx: DataFrame, actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Latest terminal transaction per object and action against row counts.

    ``actual`` and ``expected`` hold one row count per object (``resource_name``, ``rows``).
    """
    last = latest_per_key(
        tx.where(F.col("event_status").isin("SUCCESS", "ERROR")).select(
            "resource_name", "event_action", "id", "event_status"
        ),
        ["resource_name", "event_action"],
        ["id"],
    )
    found = actual.select("resource_name", F.col("rows").alias("actual_rows"))
    wanted = expected.select("resource_name", F.col("rows").alias("expected_rows"))
    return (
        last.join(found, "resource_name", "left")
        .join(wanted, "resource_name", "left")
        .withColumn("actual_rows", F.coalesce("actual_rows", F.lit(0)).cast("bigint"))
        .withColumn("expected_rows", F.coalesce("expected_rows", F.lit(0)).cast("bigint"))
        .withColumn(
            "verified", (F.col("event_status") == "SUCCESS") & (F.col("actual_rows") == F.col("expected_rows"))
        )
    )


def audit_gaps(raw: DataFrame, tx: DataFrame) -> DataFrame:
    """Raw events without a transaction and transactions without a raw event."""
    events = raw.select(F.col("id").alias("raw_id"), F.col("id").alias("_link"))
    logs = tx.select(F.col("id").alias("tx_id"), _link(F.col("object_event_id"), F.col("id")).alias("_link"))
    return (
        events.join(logs, "_link", "full_outer")
        .where(F.col("raw_id").isNull() | F.col("tx_id").isNull())
        .select(
            F.when(F.col("tx_id").isNull(), "event without transaction")
            .otherwise("transaction without event")
            .alias("gap"),
            F.coalesce("raw_id", "tx_id").alias("id"),
        )
    )


def error_rollup(errors: DataFrame) -> DataFrame:
    return errors.groupBy("mapping_id", "error_code").agg(
        F.count(F.lit(1)).alias("error_count"), F.max("created_at").alias("last_error_at")
    )


def error_rows(tx: DataFrame, error_class: Column) -> DataFrame:
    """Error-log rows of the failed transactions in ``tx``."""
    return tx.where(F.col("event_status") == "ERROR").select(
        F.col("id").alias("event_log_id"), "mapping_id", *TARGET, "event_action",
        ev.error_code(error_class).alias("error_code"),
        F.col("message").alias("error_message"), "created_at",
    )


def attempt_numbers(tx: DataFrame) -> DataFrame:
    """Each try of an object operation: its number and how many earlier tries failed.

    An object may be tried any number of times, so the counts are carried over blocks of ids.
    """
    keys = ["bucket_name", "resource_name", "event_action"]
    failed = F.when(F.col("event_status") == "ERROR", F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    counted = running(
        tx, keys, [F.col("id")], seq_block("id"),
        {"attempt_no": ("sum", F.lit(1).cast("bigint")), "_failed": ("sum", failed)},
    )
    return counted.withColumn("failures_before", F.col("_failed") - failed).drop("_failed")
