"""Queries over aggregates, metrics and generated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slicelake.operators import audit, lifecycle, metrics, profile, quality
from slicelake.operators.lifecycle import TARGET
from slicelake.plans import views as v
from slicelake.plans.joins import ORPHANS, VISIBLE, attempts
from slicelake.plans.registry import query
from slicelake.plans.scalars import LOADED, _dec, loaded
from slicelake.sources import generated

rate = metrics.rate_column


@query(
    "A2_registered_without_log",
    v.sql(
        """SELECT target_database, target_table, count(*) AS mapping_count, CAST(0 AS BIGINT) AS event_count,
           CAST(NULL AS TIMESTAMP) AS last_event_at FROM customer_mapping GROUP BY ALL""",
        "customer_mapping",
    ),
)
def registered_without_log(spark, sf_dir):
    return audit.registered_tables(v.customer_mappings(spark, sf_dir))


@query(
    "A3_next_batch",
    v.sql(
        """SELECT target_database, target_table, CAST(greatest(max(batch_num) + 1, max(promised)) AS BIGINT) AS next_batch_num FROM
           (SELECT target_database, target_table, batch_num, CASE WHEN target_table = 'us_feed' THEN 1000 END AS promised FROM registry)
           GROUP BY ALL""",
        "registry",
    ),
)
def next_batch(spark, sf_dir):
    registry = v.registry(spark, sf_dir)
    sequences = registry.select(*TARGET).distinct().where(F.col("target_table") == "us_feed").withColumn(
        "next_batch_num", F.lit(1000).cast("bigint")
    )
    return lifecycle.next_batch(registry, sequences)


@query(
    "A4_totals",
    v.sql("SELECT target_table, count(*) AS total FROM tx GROUP BY target_table", "tx"),
)
def totals(spark, sf_dir):
    return v.tx_log(spark, sf_dir).groupBy("target_table").agg(F.count(F.lit(1)).alias("total"))


@query(
    "A5_inserted_rows",
    v.sql("SELECT target_table, CAST(batch_num AS BIGINT) AS batch_num, count(*) AS rows FROM contents GROUP BY ALL", "contents"),
)
def inserted_rows(spark, sf_dir):
    return v.contents(spark, sf_dir).groupBy("target_table", "batch_num").agg(F.count(F.lit(1)).alias("rows"))


INDEX = """SELECT 'mart' AS target_database, concat('t_', p_partkey) AS target_table, i.index_name, i.column_name FROM part,
    (VALUES ('PRIMARY', 'id', 0), ('PRIMARY', 'BATCH_NUM', 0), ('uq', 'code', 3), ('uq', 'batch_num', 6)) i(index_name, column_name, k)
    WHERE i.k = 0 OR p_partkey % i.k = 0"""


def index_columns(spark, sf_dir) -> DataFrame:
    """Unique-index columns of one table per part; some second keys lack the slice column."""
    part = v.table(spark, sf_dir, "part")
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("index_name"), F.lit(c).alias("column_name"), F.lit(k).alias("k"))
            for n, c, k in (("PRIMARY", "id", 1), ("PRIMARY", "BATCH_NUM", 1), ("uq", "code", 3), ("uq", "batch_num", 6))
        ]
    )
    return (
        part.select(
            F.lit("mart").alias("target_database"), F.concat(F.lit("t_"), "p_partkey").alias("target_table"),
            "p_partkey", F.inline(entries),
        )
        .where(F.col("p_partkey") % F.col("k") == 0)
        .drop("p_partkey", "k")
    )


@query(
    "A6_unique_keys",
    v.sql(
        """SELECT target_database, target_table, index_name FROM ix GROUP BY ALL
           HAVING NOT bool_or(lower(column_name) = 'batch_num')""",
        ix=INDEX,
    ),
)
def unique_keys(spark, sf_dir):
    return quality.unique_key_findings(index_columns(spark, sf_dir))


TEXTS = """SELECT o_orderkey AS row_no, CAST(o_orderkey AS VARCHAR) AS key_text,
    concat(CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '' END, o_custkey, '.5') AS number_text,
    concat(' ', substr(CAST(o_orderdate AS VARCHAR), 1, 10), ' ') AS date_text,
    replace(CAST(o_orderdate AS VARCHAR), ' ', 'T') AS moment_text, o_orderpriority AS priority,
    CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE '' END AS nothing,
    CASE WHEN o_orderkey = 700 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END AS mostly_number FROM orders"""
TEXT_COLUMNS = ["key_text", "number_text", "date_text", "moment_text", "priority", "nothing", "mostly_number"]


def texts(spark, sf_dir) -> DataFrame:
    orders = v.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    return orders.select(
        F.col("o_orderkey").alias("row_no"),
        key.alias("key_text"),
        F.concat(F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise(""), "o_custkey", F.lit(".5")).alias("number_text"),
        F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" ")).alias("date_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("moment_text"),
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise("").alias("nothing"),
        F.when(F.col("o_orderkey") == 700, "x").otherwise(key).alias("mostly_number"),
    )


def _infer_sql(source: str) -> str:
    one = """SELECT '{c}' AS "column", CASE WHEN count(x) = 0 THEN 'TEXT'
        WHEN bool_and(regexp_full_match(x, '[-+]?[0-9]+')) THEN 'BIGINT'
        WHEN bool_and(regexp_full_match(x, '[-+]?[0-9]+(\\.[0-9]*)?')) THEN 'DECIMAL(38, 10)'
        WHEN bool_and(try_cast(x AS TIMESTAMP) IS NOT NULL AND regexp_matches(x, '^[0-9]{{4}}-')) THEN 'DATETIME'
        ELSE concat('VARCHAR(', max(length(x)), ')') END AS type FROM (SELECT nullif(trim({c}), '') AS x FROM {s})"""
    return " UNION ALL ".join(one.format(c=c, s=source) for c in TEXT_COLUMNS)


@query("A7_infer_types", v.sql(_infer_sql("texts"), texts=TEXTS))
def infer_types(spark, sf_dir):
    return profile.infer_types(texts(spark, sf_dir), TEXT_COLUMNS)


@query("A8_infer_types_preview", v.sql(_infer_sql("(SELECT * FROM texts WHERE row_no <= 25)"), texts=TEXTS))
def infer_types_preview(spark, sf_dir):
    """The preview looks at the first 25 rows of a file; that is the feature."""
    return profile.infer_types(texts(spark, sf_dir), TEXT_COLUMNS, profile.SAMPLE_ROWS)


LOG = """SELECT concat('req-', event_id) AS request_id, k, concat(strftime(ts + k * INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S.%f'), 'Z') AS time,
    CASE k WHEN 0 THEN 'Received function invocation request' WHEN 3 THEN concat('Served function invocation request in ', event_id, ' ms')
      ELSE concat(event_type, ' ', k) END AS message
    FROM events, (VALUES (0), (1), (2), (3)) n(k) WHERE NOT (event_id % 5 = 0 AND k = 3) AND NOT (event_id % 4 = 0 AND k = 1)"""


def invocation_log(spark, sf_dir) -> DataFrame:
    e = v.table(spark, sf_dir, "events").withColumn("k", F.explode(F.array(*[F.lit(i) for i in (3, 1, 0, 2)])))
    message = (
        F.when(F.col("k") == 0, metrics.RECEIVED)
        .when(F.col("k") == 3, F.concat(F.lit(metrics.SERVED + " in "), "event_id", F.lit(" ms")))
        .otherwise(F.concat("event_type", F.lit(" "), "k"))
    )
    time = F.concat(F.date_format(F.expr("ts + k * INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    dropped = ((F.col("event_id") % 5 == 0) & (F.col("k") == 3)) | ((F.col("event_id") % 4 == 0) & (F.col("k") == 1))
    return e.where(~dropped).select(
        F.concat(F.lit("req-"), "event_id").alias("request_id"), time.alias("time"), message.alias("message")
    )


@query(
    "A9_invocation_summary",
    v.sql(
        """SELECT request_id, coalesce(min(time) FILTER (k = 0), '') AS started, coalesce(min(time) FILTER (k = 3), '') AS completed,
             coalesce(min(message) FILTER (k = 0), '') AS received_message, coalesce(min(message) FILTER (k = 3), '') AS completion_message,
             coalesce(string_agg(message, ' | ' ORDER BY time) FILTER (k IN (1, 2)), '') AS function_output
           FROM log GROUP BY request_id""",
        log=LOG,
    ),
)
def invocation_summary(spark, sf_dir):
    return metrics.invocation_summary(invocation_log(spark, sf_dir), limit=None)


FILES = """SELECT resource_name, CAST(sum(quantity) AS BIGINT) * 1000000 AS file_bytes, count(*) AS rows FROM contents GROUP BY resource_name"""


def files(spark, sf_dir) -> DataFrame:
    return v.contents(spark, sf_dir).groupBy("resource_name").agg(
        (F.sum("quantity") * 1000000).alias("file_bytes"), F.count(F.lit(1)).alias("rows")
    )


@query(
    "A10_load_metrics",
    v.sql(
        "SELECT f.resource_name, f.rows, c.event_status AS create_status, c.message AS create_message, d.event_status AS delete_status, "
        "CAST(coalesce(o.n, 0) AS BIGINT) AS staging_tables_after_cleanup, "
        + ", ".join(
            [
                _dec("f.file_bytes / 1048576.0::DOUBLE", "file_mib"),
                _dec("date_diff('microsecond', e.event_time, e.received_at) / 1e6", "delivery_latency_seconds"),
                _dec("e.duration_ms::DOUBLE / 1000", "processing_seconds"),
                _dec("f.file_bytes / 1048576.0::DOUBLE / nullif(e.duration_ms::DOUBLE / 1000, 0)", "throughput_mib_per_second"),
                _dec("nullif(e.duration_ms::DOUBLE / 1000, 0) / f.rows * 100", "seconds_per_100_rows"),
                _dec("x.duration_ms::DOUBLE / 1000", "delete_processing_seconds"),
            ]
        )
        + """ FROM files f
        LEFT JOIN (SELECT raw_event.* FROM raw_event JOIN acted ON acted.object_event_id = raw_event.id AND action IN ('CREATE', 'UPDATE')
            QUALIFY row_number() OVER (PARTITION BY raw_event.resource_name ORDER BY id DESC) = 1) e ON e.resource_name = f.resource_name
        LEFT JOIN (SELECT raw_event.* FROM raw_event JOIN acted ON acted.object_event_id = raw_event.id AND action = 'DELETE'
            QUALIFY row_number() OVER (PARTITION BY raw_event.resource_name ORDER BY id DESC) = 1) x ON x.resource_name = f.resource_name
        LEFT JOIN (SELECT * FROM tx WHERE event_action IN ('CREATE', 'UPDATE')
            QUALIFY row_number() OVER (PARTITION BY resource_name ORDER BY id DESC) = 1) c ON c.resource_name = f.resource_name
        LEFT JOIN (SELECT * FROM tx WHERE event_action = 'DELETE'
            QUALIFY row_number() OVER (PARTITION BY resource_name ORDER BY id DESC) = 1) d ON d.resource_name = f.resource_name
        LEFT JOIN (SELECT resource_name, count(*) AS n FROM (SELECT DISTINCT resource_name, attempt FROM contents) GROUP BY 1) o
            ON o.resource_name = f.resource_name""",
        "contents", "tx", "raw_event", files=FILES,
    ),
)
def load_metrics(spark, sf_dir):
    residue = (
        v.contents(spark, sf_dir).select("resource_name", "attempt").distinct().groupBy("resource_name")
        .agg(F.count(F.lit(1)).alias("staging_tables_after_cleanup"))
    )
    found = metrics.load_metrics(v.raw_event(spark, sf_dir), v.tx_log(spark, sf_dir), files(spark, sf_dir), residue)
    rates = [
        "file_mib", "delivery_latency_seconds", "processing_seconds", "throughput_mib_per_second",
        "seconds_per_100_rows", "delete_processing_seconds",
    ]
    return found.select(
        "resource_name", "rows", "create_status", "create_message", "delete_status", "staging_tables_after_cleanup",
        *[rate(c) for c in rates],
    )


FIT = f"""SELECT event_type, {_dec('regr_slope(y, x)', 'slope')}, {_dec('regr_intercept(y, x)', 'intercept')}, {_dec('regr_r2(y, x)', 'r2')},
    count(*) AS points, {_dec('1 / nullif(regr_slope(y, x), 0)', 'fitted_mib_per_second', 3)} FROM
    (SELECT event_type, file_bytes / 1048576.0::DOUBLE AS x, duration_ms::DOUBLE / 1000 + file_bytes / 1048576.0::DOUBLE / 15 AS y FROM loaded)
    GROUP BY event_type"""


def measured(spark, sf_dir) -> DataFrame:
    """Loads whose time grows with their size, plus what the event table says they took."""
    rates = metrics.load_rates(loaded(spark, sf_dir))
    return rates.withColumn("processing_seconds", F.col("processing_seconds") + F.col("file_mib") / 15)


@query("A11_fit_duration", v.sql(FIT, "raw_event", loaded=LOADED))
def fit_duration(spark, sf_dir):
    fit = metrics.fit_duration(measured(spark, sf_dir), ["event_type"])
    return fit.select(
        "event_type", rate("slope"), rate("intercept"), rate("r2"), "points", rate("fitted_mib_per_second", 3)
    )


@query(
    "A12_project_capacity",
    v.sql(
        f"""SELECT scenario, budget, seconds, {_dec('mib_per_second * seconds / 1024', 'max_gib', 4)} FROM
            (SELECT event_type AS scenario, avg(file_bytes / 1048576.0::DOUBLE / (duration_ms::DOUBLE / 1000)) AS mib_per_second
             FROM loaded WHERE duration_ms > 0 GROUP BY event_type),
            (VALUES ('sync hard', 300), ('sync 80%', 240), ('detached hard', 3600), ('detached 80%', 2880)) b(budget, seconds)""",
        "raw_event", loaded=LOADED,
    ),
)
def project_capacity(spark, sf_dir):
    rates = metrics.load_rates(loaded(spark, sf_dir))
    scenarios = rates.groupBy(F.col("event_type").alias("scenario")).agg(
        F.avg("throughput_mib_per_second").alias("mib_per_second")
    )
    return metrics.project_capacity(scenarios).select("scenario", "budget", "seconds", rate("max_gib", 4))


RUN = """SELECT event_type, CAST(sum(file_bytes) AS BIGINT) AS bytes, CAST(sum(rows) AS BIGINT) AS rows,
    CAST(sum(duration_ms) AS DECIMAL(28,3)) AS duration FROM loaded WHERE id % 2 = {n} GROUP BY event_type"""


@query(
    "A13_compare_runs",
    v.sql(
        "SELECT a.event_type, a.bytes AS old_bytes, b.bytes AS new_bytes, "
        + ", ".join(_dec(f"(b.{m} - a.{m})::DOUBLE / a.{m}::DOUBLE * 100", f"{m}_change_pct", 4) for m in ("bytes", "rows", "duration"))
        + " FROM a JOIN b USING (event_type)",
        "raw_event", loaded=LOADED, a=RUN.format(n=0), b=RUN.format(n=1),
    ),
)
def compare_runs(spark, sf_dir):
    run = lambda n: loaded(spark, sf_dir).where(F.col("id") % 2 == n).groupBy("event_type").agg(
        F.sum("file_bytes").alias("bytes"), F.sum("rows").alias("rows"),
        F.sum("duration_ms").cast("decimal(28,3)").alias("duration"),
    )
    compared = metrics.compare_runs(run(0), run(1), ["event_type"], ["bytes", "rows", "duration"])
    return compared.select(
        "event_type", "old_bytes", "new_bytes",
        *[rate(f"{m}_change_pct", 4) for m in ("bytes", "rows", "duration")],
    )


@query(
    "A14_monitor_summary",
    f"""SELECT event_type AS metric, count(*) AS samples, {_dec('avg(value)', 'average', 6)}, {_dec('max(value)', 'peak', 6)},
        {_dec('quantile_cont(value, 0.95)', 'p95', 6)} FROM events
        WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-27 00:00:00' GROUP BY event_type""",
)
def monitor_summary(spark, sf_dir):
    samples = v.table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("metric"), "value")
    summary = metrics.monitor_summary(samples, "2024-01-03 00:00:00", "2024-01-27 00:00:00")
    return summary.select("metric", "samples", rate("average"), rate("peak"), rate("p95"))


@query(
    "A15_final_state",
    v.sql(
        f"""SELECT 'target rows' AS "check", count(*) AS value FROM ({VISIBLE})
            UNION ALL SELECT 'residual attempts', count(*) FROM ({ORPHANS})
            UNION ALL SELECT 'active or loading batches', count(*) FROM registry WHERE lifecycle_state IN ('ACTIVE', 'LOADING')
            UNION ALL SELECT 'null mode snapshots', count(*) FROM raw_event WHERE invocation_mode IS NULL""",
        "contents", "registry", "raw_event",
    ),
)
def final_state(spark, sf_dir):
    registry = v.registry(spark, sf_dir)
    return metrics.final_state(
        audit.visible_rows(v.contents(spark, sf_dir), registry),
        audit.orphan_attempts(attempts(spark, sf_dir), registry, v.AS_OF),
        registry,
        v.raw_event(spark, sf_dir),
    )


@query(
    "A16_error_rollup",
    v.sql(
        """SELECT CAST(mapping_id AS BIGINT) AS mapping_id, error_code, count(*) AS error_count, max(created_at) AS last_error_at
           FROM errs GROUP BY ALL""",
        "errs",
    ),
)
def error_rollup(spark, sf_dir):
    return audit.error_rollup(v.errors(spark, sf_dir))


# ---------------------------------------------------------------- generated rows

ROW = """CAST(o_orderkey AS VARCHAR) AS id_text, '2026-07-19 12:00:00.000000' AS event_ts,
    concat('group-', lpad(CAST(o_orderkey % 16 AS VARCHAR), 2, '0')) AS category, repeat('x', 12) AS payload,
    concat(o_orderkey % 10000, '.25') AS amount"""


@query("S9_generated_rows", f"SELECT o_orderkey AS record_id, * EXCLUDE (id_text) FROM (SELECT o_orderkey, {ROW} FROM orders) ".replace("* EXCLUDE (id_text)", "event_ts, category, payload, amount"))
def generated_rows(spark, sf_dir):
    """Benchmark rows for the order keys."""
    ids = v.table(spark, sf_dir, "orders")
    return ids.select(*generated.benchmark_row(F.col("o_orderkey"), 12))


SIZED = """SELECT id, event_ts, category, payload, amount, 43 + coalesce(sum(length(id) + length(event_ts) + length(category) + length(payload)
      + length(amount) + 5) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM
    (SELECT o_orderkey AS id, '2026-07-19 12:00:00.000000' AS event_ts, concat('group-', lpad(CAST(o_orderkey % 16 AS VARCHAR), 2, '0')) AS category,
       repeat('x', 12) AS payload, concat(o_orderkey % 10000, '.25') AS amount FROM orders)""".replace("length(id)", "length(CAST(id AS VARCHAR))")


@query(
    "S10_generated_bytes",
    v.sql(
        """SELECT id AS record_id, event_ts, category, payload, amount FROM sized
           WHERE before < (SELECT max(before) // 2 FROM sized)""",
        sized=SIZED,
    ),
)
def generated_bytes(spark, sf_dir):
    """Rows up to half the bytes that all of them would take."""
    ids = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    size = generated.row_bytes(F.col("id"), 12)
    last = F.max_by(size, "id")
    half = ids.agg(F.floor((F.sum(size) - last + generated.HEADER_BYTES) / 2).alias("half")).scalar()
    return generated.limit_bytes(ids, half, 12)


@query("W8_running_bytes", v.sql("SELECT id, CAST(before AS BIGINT) AS bytes_before FROM sized", sized=SIZED))
def running_bytes(spark, sf_dir):
    from slicelake.operators import skew

    ids = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    size = generated.row_bytes(F.col("id"), 12)
    summed = skew.running(
        ids, [], [F.col("id")], skew.seq_block("id", 4096), {"before": ("sum", size)}, inclusive=False
    )
    return summed.select("id", (F.col("before") + generated.HEADER_BYTES).cast("bigint").alias("bytes_before"))


@query(
    "X6_stale_leases",
    v.sql(
        """SELECT CAST(mapping_id AS BIGINT) AS mapping_id, bucket_name, resource_name,
             date_sub('second', updated_at, TIMESTAMP '2024-01-30 12:00:00') AS age_seconds FROM registry
           WHERE lifecycle_state = 'LOADING' AND date_sub('second', updated_at, TIMESTAMP '2024-01-30 12:00:00') >= 600""",
        "registry",
    ),
)
def stale_leases(spark, sf_dir):
    late = lifecycle.stale_leases(v.registry(spark, sf_dir), "2024-01-30 12:00:00", lifecycle.STALE_LOADING_SECONDS)
    return late.select("mapping_id", "bucket_name", "resource_name", "age_seconds")
