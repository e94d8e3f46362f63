"""Load metrics: rates, regression, projection, comparison, monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slicelake.functions import events as ev
from slicelake.operators import skew
from slicelake.operators.lifecycle import TARGET

MIB = 1048576
# Seconds a run may take, whole and with 20 % kept back.
BUDGETS = {"sync hard": 300, "sync 80%": 240, "detached hard": 3600, "detached 80%": 2880}
RECEIVED = "Received function invocation request"
SERVED = "Served function invocation request"


def load_rates(df: DataFrame) -> DataFrame:
    """Latency and throughput columns from times, bytes and rows; zero or NULL input gives NULL."""
    seconds = lambda a, b: F.timestamp_diff("MICROSECOND", a, b) / F.lit(1e6)
    mib = F.col("file_bytes") / F.lit(float(MIB))
    spent = F.nullif(F.col("duration_ms").cast("double") / 1000, F.lit(0.0))
    rows = F.nullif(F.col("rows").cast("double"), F.lit(0.0))
    return df.withColumns(
        {
            "file_mib": mib,
            "delivery_latency_seconds": seconds(F.col("event_time"), F.col("received_at")),
            "end_to_end_seconds": seconds(F.col("event_time"), F.col("completed_at")),
            "processing_seconds": F.col("duration_ms").cast("double") / 1000,
            "throughput_mib_per_second": mib / spent,
            "rows_per_second": F.col("rows").cast("double") / spent,
            "seconds_per_100_rows": spent / rows * 100,
        }
    )


def invocation_summary(log: DataFrame, limit: int | None = 100) -> DataFrame:
    """One row per request: when it started and ended, and its other messages in time order.

    Messages are first sorted and joined per request and minute, then per request, so that a request
    with very many records is not sorted in one place; only the finished texts meet.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    flat = log.select(
        "request_id",
        text("time").alias("time"),
        text("message").alias("raw"),
        F.regexp_replace(text("message"), r"[\t\r\n]+", " ").alias("message"),
    )
    start, end = F.col("raw") == RECEIVED, F.col("raw").startswith(SERVED)
    entry = F.struct("time", "message")
    joined = lambda entries: F.array_join(F.transform(F.sort_array(entries), lambda x: x["message"]), " | ")
    parts = flat.groupBy("request_id", F.left("time", F.lit(16)).alias("minute")).agg(
        F.min(F.when(start, entry)).alias("start"),
        F.min(F.when(end, entry)).alias("end"),
        F.collect_list(F.when(~(start | end), entry)).alias("others"),
    )
    piece = F.when(F.size("others") > 0, F.struct(F.col("minute").alias("time"), joined("others").alias("message")))
    summary = parts.groupBy("request_id").agg(
        F.min("start").alias("s"), F.min("end").alias("e"), joined(F.collect_list(piece)).alias("function_output")
    ).select(
        "request_id",
        text("s.time").alias("started"),
        text("e.time").alias("completed"),
        text("s.message").alias("received_message"),
        text("e.message").alias("completion_message"),
        "function_output",
    )
    if limit is None:
        return summary
    return summary.orderBy(F.desc("started"), F.desc("request_id")).limit(limit)


def load_metrics(raw: DataFrame, tx: DataFrame, files: DataFrame, residue: DataFrame | None = None) -> DataFrame:
    """Per object: its latest load event and transaction, latest delete, and the rates.

    ``files``: ``resource_name, file_bytes, rows``. ``residue``: unreferenced attempts per object.
    The latest row is a combining maximum, so an object with very many events is fine.
    """
    action = ev.event_action(F.col("event_type"))
    last = lambda test, *columns: F.max(F.when(test, F.struct("id", *columns)))
    events = raw.groupBy("resource_name").agg(
        last(action.isin("CREATE", "UPDATE"), "event_time", "received_at", "completed_at", "duration_ms").alias("_load"),
        last(action == "DELETE", "duration_ms").alias("_delete"),
    )
    logs = tx.groupBy("resource_name").agg(
        last(F.col("event_action").isin("CREATE", "UPDATE"), "event_status", "message").alias("_load_tx"),
        last(F.col("event_action") == "DELETE", "event_status").alias("_delete_tx"),
    )
    joined = files.join(events, "resource_name", "left").join(logs, "resource_name", "left").select(
        *files.columns,
        *[F.col(f"_load.{c}").alias(c) for c in ("event_time", "received_at", "completed_at", "duration_ms")],
        F.col("_load_tx.event_status").alias("create_status"),
        F.col("_load_tx.message").alias("create_message"),
        F.col("_delete_tx.event_status").alias("delete_status"),
        (F.col("_delete.duration_ms").cast("double") / 1000).alias("delete_processing_seconds"),
    )
    if residue is not None:
        joined = joined.join(residue, "resource_name", "left").withColumn(
            "staging_tables_after_cleanup", F.coalesce("staging_tables_after_cleanup", F.lit(0)).cast("bigint")
        )
    return load_rates(joined)


def fit_duration(metrics: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Least-squares duration over size with its R², and the throughput the slope implies."""
    x, y = F.col("file_mib"), F.col("processing_seconds")
    aggregates = [
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.count(F.lit(1)).alias("points"),
    ]
    fitted = metrics.groupBy(*keys).agg(*aggregates)
    return fitted.withColumn("fitted_mib_per_second", F.lit(1.0) / F.nullif(F.col("slope"), F.lit(0.0)))


def project_capacity(scenarios: DataFrame, budgets: dict[str, int] = BUDGETS) -> DataFrame:
    """Largest size per scenario (``scenario``, ``mib_per_second``) and time budget."""
    limits = F.array(*[F.struct(F.lit(k).alias("budget"), F.lit(v).alias("seconds")) for k, v in budgets.items()])
    return scenarios.select("scenario", "mib_per_second", F.inline(limits)).withColumn(
        "max_gib", F.col("mib_per_second") * F.col("seconds") / 1024
    )


def compare_runs(old: DataFrame, new: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Percent change of each measure from one run to the other."""
    a = old.select(*keys, *[F.col(m).alias(f"old_{m}") for m in measures])
    b = new.select(*keys, *[F.col(m).alias(f"new_{m}") for m in measures])
    change = lambda m: (F.col(f"new_{m}") - F.col(f"old_{m}")) / F.nullif(F.col(f"old_{m}").cast("double"), F.lit(0.0)) * 100
    return a.join(b, keys).withColumns({f"{m}_change_pct": change(m) for m in measures})


def exact_percentile(
    df: DataFrame, keys: list[str], value: str, fraction: float, name: str, block_rows: int = skew.BLOCK_ROWS
) -> DataFrame:
    """Exact interpolated percentile per key without gathering a key's values in one place.

    Equal values are counted first; the counts are summed along the values in blocks of equal size;
    the one or two values at the wanted position remain.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    summed = skew.running_numbered(counted, keys, [*keys, value], {"_end": ("sum", F.col("_n"))}, block_rows)
    totals = summed.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max("_end").alias("_total"))
    summed = summed.join(totals, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    at = (F.col("_total") - 1) * F.lit(float(fraction))
    low, high = F.floor(at), F.ceil(at)
    begin = F.col("_end") - F.col("_n")
    covers = lambda p: (begin <= p) & (F.col("_end") > p)
    picked = summed.where(covers(low) | covers(high)).groupBy(*keys).agg(
        F.min(F.when(covers(low), F.col(value))).alias("_a"),
        F.min(F.when(covers(high), F.col(value))).alias("_b"),
        F.first(at - low).alias("_w"),
    )
    return picked.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias(name))


def monitor_summary(samples: DataFrame, start: str, end: str) -> DataFrame:
    """Average, exact 95th percentile and peak of each metric in a time range."""
    window = samples.where(
        (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    )
    plain = window.groupBy("metric").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("value").alias("average"), F.max("value").alias("peak")
    )
    return plain.join(exact_percentile(window, ["metric"], "value", 0.95, "p95"), "metric", "left")


def final_state(visible: DataFrame, orphans: DataFrame, registry: DataFrame, raw: DataFrame) -> DataFrame:
    """One row per closing check with its count."""
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("check"), "value")
    live = registry.where(F.col("lifecycle_state").isin("ACTIVE", "LOADING"))
    return (
        count("target rows", visible)
        .unionByName(count("residual attempts", orphans))
        .unionByName(count("active or loading batches", live))
        .unionByName(count("null mode snapshots", raw.where(F.col("invocation_mode").isNull())))
    )


def event_rates(tx: DataFrame, window: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Events and errors per target and time window; works on a batch and on a stream."""
    if watermark:
        tx = tx.withWatermark("created_at", watermark)
    failed = F.col("event_status") == "ERROR"
    return (
        tx.groupBy(F.window("created_at", window).alias("w"), *TARGET)
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(failed).alias("errors"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *TARGET, "events", "errors")
    )


def rate_column(name: str, digits: int = 6) -> Column:
    """A rate as a decimal, for results that must compare equal across engines."""
    return F.round(F.col(name), digits).cast(f"decimal(28,{digits})").alias(name)
