"""Views derived from the given tables, once for Spark and once as SQL text.

The Spark forms run the library's operators; the SQL forms are independent plain SQL
(GLOB, QUALIFY, windows) and serve as the yardstick.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slicelake.functions import events as ev
from slicelake.operators import lifecycle, routing
from slicelake.session import prepare, work_dir

AS_OF = "2024-01-31 00:00:00"

EVENT_COLUMNS = [
    "event_id AS object_event_id",
    "concat('com.oraclecloud.objectstorage.', CASE event_type WHEN 'signup' THEN 'createobject' "
    "WHEN 'purchase' THEN 'updateobject' WHEN 'view' THEN 'UpdateObject' WHEN 'click' THEN 'deleteobject' "
    "ELSE 'restoreobject' END) AS event_type",
    "CASE WHEN user_id % 7 = 6 THEN 'other' ELSE 'dept' END AS compartment_name",
    "concat('bucket-', user_id % 3) AS bucket_name",
    "concat('feed/', CASE WHEN user_id % 2 = 0 THEN 'eu' ELSE 'US' END, '/user-', user_id, '.csv') AS resource_name",
    "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('v', event_id) END AS version_id",
    "CASE WHEN event_id % 2 = 0 THEN NULL ELSE concat('e', event_id) END AS etag",
    "ts AS event_time",
    "ts + (event_id % 7000) * INTERVAL 1 MILLISECOND AS received_at",
    "event_id % 7000 AS latency_ms",
    "CAST(floor(value * 10) AS BIGINT) AS duration_ms",
    "event_id % 5 <> 4 AS load_ok",
]
MAPPING_ROWS = """
  (1, 'dept', 'bucket-0', 'feed/*',            'mart', 'all_feed', 'SYNC',     4),
  (2, 'dept', 'bucket-0', 'feed/eu/*.csv',     'mart', 'eu_feed',  'DETACHED', 8),
  (3, 'dept', 'bucket-1', 'feed/US/user-?.csv','mart', 'us_feed',  'SYNC',     4),
  (4, 'dept', 'bucket-1', 'feed/[eU]*/*1*.csv','mart', 'us_feed',  'DETACHED', 4),
  (5, 'dept', 'bucket-2', 'feed/us/*.csv',     'mart', 'us_feed',  'SYNC',     2),
  (6, 'dept', 'bucket-2', 'feed/eu/*.csv',     'mart', 'eu_feed',  'SYNC',     4),
  (7, 'dept', 'bucket-2', 'feed/eu/*.csv',     'mart', 'eu_copy',  'SYNC',     4)"""
MAPPING_NAMES = (
    "id, compartment_name, bucket_name, resource_name_pattern, target_database, target_table, "
    "invocation_mode, worker_threads"
)
ROW_COLUMNS = [
    "l_orderkey AS object_event_id", "l_linenumber", "l_partkey", "l_suppkey",
    "CAST(l_quantity AS BIGINT) AS quantity", "CAST(l_extendedprice AS DECIMAL(14,2)) AS amount",
    "l_returnflag", "l_shipdate",
]
# Mapping forms as a user might enter them, one per customer; some are wrong on purpose.
FORM_COLUMNS = [
    "c_custkey AS id",
    "CASE WHEN c_custkey % 19 = 0 THEN '' ELSE concat(' dept-', c_nationkey, ' ') END AS compartment_name",
    "CASE WHEN c_custkey % 41 = 0 THEN repeat('b', 256) ELSE concat('bucket-', c_custkey % 5) END AS bucket_name",
    "CASE WHEN c_custkey % 11 = 0 THEN concat('feed/', c_nationkey, '/x', c_custkey, '/*.csv') "
    "ELSE concat('feed/', c_nationkey, '/*', c_custkey % 3, '.csv') END AS resource_name_pattern",
    "CASE WHEN c_custkey % 23 = 0 THEN '9mart' ELSE 'mart' END AS target_database",
    "concat(CASE WHEN c_custkey % 2 = 0 THEN '.' ELSE '' END, 'Segment_', c_mktsegment) AS target_table",
    "CASE c_custkey % 4 WHEN 0 THEN 'detached' WHEN 1 THEN 'SYNC' WHEN 2 THEN '' ELSE 'LATER' END AS invocation_mode",
    "CASE c_custkey % 6 WHEN 0 THEN '0' WHEN 1 THEN '65' WHEN 2 THEN 'many' WHEN 3 THEN '' ELSE '8' END AS worker_threads",
]
# Clean mappings, one per customer.
CUSTOMER_MAPPING_COLUMNS = [
    "c_custkey AS id",
    "concat('dept-', c_nationkey) AS compartment_name",
    "concat('bucket-', c_custkey % 5) AS bucket_name",
    "concat('feed/', c_mktsegment, '/*', c_custkey % 7, '.csv') AS resource_name_pattern",
    "'mart' AS target_database",
    "lower(c_mktsegment) AS target_table",
    "CASE WHEN c_custkey % 3 = 0 THEN 'DETACHED' ELSE 'SYNC' END AS invocation_mode",
    "CAST(c_custkey % 64 + 1 AS INT) AS worker_threads",
]


# ---------------------------------------------------------------- Spark

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived control table, written once per application and then read.

    The audit queries read these tables several times over, as a user's would read the tables
    an ingest has written; deriving them anew for every use would repeat the fold each time.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = work_dir(spark, name)
        build(spark, sf_dir).write.parquet(path)
        _STORED[key] = path
    return prepare(spark).read.parquet(_STORED[key])


def obj_event(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*EVENT_COLUMNS)


def mapping(spark) -> DataFrame:
    return spark.sql(f"SELECT * FROM (VALUES {MAPPING_ROWS}) AS m({MAPPING_NAMES})").withColumn(
        "id", F.col("id").cast("bigint")
    )


def object_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*ROW_COLUMNS)


def mapping_forms(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*FORM_COLUMNS)


def customer_mappings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*CUSTOMER_MAPPING_COLUMNS)


def routed(spark, sf_dir) -> DataFrame:
    events = obj_event(spark, sf_dir).withColumn("action", ev.event_action(F.col("event_type"), "UNKNOWN"))
    return routing.route(events, mapping(spark))


def lifecycle_events(spark, sf_dir) -> DataFrame:
    """Routed events with a supported action: what the fold sees."""
    return (
        routed(spark, sf_dir)
        .where(F.col("mapping_id").isNotNull() & (F.col("action") != "UNKNOWN"))
        .withColumnsRenamed({"load_ok": "ok"})
        .withColumn("seq", F.col("object_event_id"))
        .withColumn(
            "object_version",
            ev.object_version(F.col("version_id"), F.col("etag"), F.concat(F.lit("id-"), "object_event_id")),
        )
    )


def folded(spark, sf_dir) -> DataFrame:
    """Lifecycle events with their outcome and batch number (stored)."""
    return stored(spark, sf_dir, "folded", _folded)


def _folded(spark, sf_dir) -> DataFrame:
    events = lifecycle_events(spark, sf_dir)
    return lifecycle.with_batches(lifecycle.fold_lifecycle(events), lifecycle.allocate_batches(events))


def registry(spark, sf_dir) -> DataFrame:
    """Last state of every source that ever had a slice; every 17th is shown mid-load (stored)."""
    return stored(spark, sf_dir, "source_object_batches", _registry)


def _registry(spark, sf_dir) -> DataFrame:
    last = lifecycle.last_states(folded(spark, sf_dir))
    return last.select(
        "mapping_id", "bucket_name", "resource_name", "target_database", "target_table",
        F.col("slice_batch").alias("batch_num"),
        ev.source_key(F.col("mapping_id"), F.col("bucket_name"), F.col("resource_name")).alias("source_key"),
        "object_version",
        F.when(F.col("seq") % 17 == 0, "LOADING").otherwise(F.col("state")).alias("lifecycle_state"),
        F.col("visible_seq").alias("visible_attempt"),
        F.col("seq").alias("last_seq"),
        F.col("received_at").alias("updated_at"),
    )


def tx_log(spark, sf_dir) -> DataFrame:
    """The audit log: folded events, then unrouted and unsupported ones as errors (stored)."""
    return stored(spark, sf_dir, "event_tx_log", _tx_log)


def _tx_log(spark, sf_dir) -> DataFrame:
    done = folded(spark, sf_dir).select(
        "*",
        F.when(F.col("success"), "SUCCESS").otherwise("ERROR").alias("event_status"),
        lifecycle.outcome_message(F.lit(0), F.lit("load failed")).alias("message"),
    )
    version = ev.object_version(F.col("version_id"), F.col("etag"), F.concat(F.lit("id-"), "object_event_id"))
    everything = routed(spark, sf_dir)
    lost = everything.where(F.col("mapping_id").isNull() | (F.col("action") == "UNKNOWN")).select(
        "*",
        version.alias("object_version"),
        F.lit("ERROR").alias("event_status"),
        F.when(F.col("action") == "UNKNOWN", lifecycle.UNSUPPORTED).otherwise(lifecycle.NO_MAPPING).alias("message"),
    )
    nothing = lambda kind: F.lit(None).cast(kind)
    lost = lost.withColumns(
        {
            "batch_num": nothing("bigint"), "mapping_id": nothing("bigint"), "target_database": nothing("string"),
            "target_table": nothing("string"), "mapping_mode": nothing("string"),
        }
    )
    columns = [
        F.col("object_event_id").alias("id"),
        F.when(F.col("object_event_id") % 11 != 0, F.col("object_event_id")).alias("object_event_id"),
        "mapping_id", "target_database", "target_table", "batch_num",
        F.col("action").alias("event_action"), "event_status", "bucket_name", "resource_name", "object_version",
        F.when(F.col("object_event_id") % 9 != 0, F.col("mapping_mode")).alias("invocation_mode"),
        "message",
        F.expr("received_at + duration_ms * INTERVAL 1 MILLISECOND").alias("created_at"),
    ]
    return done.select(*columns).unionByName(lost.select(*columns))


def errors(spark, sf_dir) -> DataFrame:
    return tx_log(spark, sf_dir).where(F.col("event_status") == "ERROR").select(
        (F.col("id") * 10).alias("id"), F.col("id").alias("event_log_id"), "mapping_id",
        "target_database", "target_table", "event_action",
        ev.error_code(F.lit("ValueError")).alias("error_code"),
        F.col("message").alias("error_message"), "created_at",
    )


def raw_event(spark, sf_dir) -> DataFrame:
    """The raw event log with its timing columns; every 7th event has not completed."""
    return obj_event(spark, sf_dir).selectExpr(*RAW_COLUMNS)


RAW_COLUMNS = [
    "object_event_id AS id", "event_time AS event_date", "event_type", "bucket_name", "compartment_name",
    "resource_name", "event_time", "received_at",
    "CASE WHEN object_event_id % 7 <> 0 THEN received_at + duration_ms * INTERVAL 1 MILLISECOND END AS completed_at",
    "CASE WHEN object_event_id % 7 <> 0 THEN CAST(duration_ms AS DECIMAL(16,3)) END AS duration_ms",
    "CASE WHEN object_event_id % 4 = 0 THEN 'DETACHED' WHEN object_event_id % 4 = 1 THEN 'SYNC' END AS invocation_mode",
]


def contents(spark, sf_dir) -> DataFrame:
    """Target data: the rows of every successful load, tagged with slice and attempt."""
    loads = folded(spark, sf_dir).where(F.col("success") & F.col("action").isin("CREATE", "UPDATE")).select(
        *lifecycle.SOURCE, *lifecycle.TARGET, F.col("slice_batch").alias("batch_num"),
        F.col("object_event_id").alias("attempt"),
    )
    return loads.join(
        object_rows(spark, sf_dir).withColumnRenamed("object_event_id", "attempt"), "attempt"
    )


# ---------------------------------------------------------------- SQL

SQL = {
    "obj_event": "SELECT " + ", ".join(EVENT_COLUMNS) + " FROM events",
    "mapping": f"SELECT * FROM (VALUES {MAPPING_ROWS}) AS m({MAPPING_NAMES})",
    "object_rows": "SELECT " + ", ".join(ROW_COLUMNS) + " FROM lineitem",
    "forms": "SELECT " + ", ".join(FORM_COLUMNS) + " FROM customer",
    "customer_mapping": "SELECT " + ", ".join(CUSTOMER_MAPPING_COLUMNS) + " FROM customer",
    "acted": """SELECT *, CASE WHEN lower(event_type) LIKE '%createobject' THEN 'CREATE'
        WHEN lower(event_type) LIKE '%updateobject' THEN 'UPDATE'
        WHEN lower(event_type) LIKE '%deleteobject' THEN 'DELETE' ELSE 'UNKNOWN' END AS action,
        CASE WHEN version_id <> '' THEN version_id WHEN etag <> '' THEN etag
        ELSE concat('id-', object_event_id) END AS object_version FROM obj_event""",
    "routed": """SELECT a.*, m.id AS mapping_id, m.target_database, m.target_table,
        m.invocation_mode AS mapping_mode, m.worker_threads
        FROM acted a LEFT JOIN mapping m ON a.compartment_name = m.compartment_name
          AND a.bucket_name = m.bucket_name AND a.resource_name GLOB m.resource_name_pattern
        QUALIFY row_number() OVER (PARTITION BY a.object_event_id
          ORDER BY length(m.resource_name_pattern) DESC, m.id) = 1""",
    "lc": """SELECT *, object_event_id AS seq, load_ok AS ok FROM routed
        WHERE mapping_id IS NOT NULL AND action <> 'UNKNOWN'""",
    "lc1": """SELECT *, max(CASE WHEN action = 'CREATE' THEN 1 END) OVER w AS existed FROM lc
        WINDOW w AS (PARTITION BY mapping_id, bucket_name, resource_name ORDER BY seq)""",
    "lc2": """SELECT *, CASE WHEN action = 'CREATE' AND ok THEN 'ACTIVE'
          WHEN action = 'UPDATE' AND existed = 1 THEN CASE WHEN ok THEN 'ACTIVE' ELSE 'ERROR' END
          WHEN action = 'DELETE' AND existed = 1 THEN 'DELETED' END AS marker FROM lc1""",
    "lc3": """SELECT *, last_value(marker IGNORE NULLS) OVER w AS l,
          max(CASE WHEN marker IS NOT NULL THEN seq END) OVER w AS lseq,
          max(CASE WHEN action = 'CREATE' AND NOT ok THEN seq END) OVER w AS cfail FROM lc2
        WINDOW w AS (PARTITION BY mapping_id, bucket_name, resource_name ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "lc4": """SELECT *, CASE WHEN existed IS NULL THEN 'ABSENT' WHEN l = 'ACTIVE' THEN 'ACTIVE'
          WHEN cfail > coalesce(lseq, -1) THEN 'ERROR' ELSE l END AS state FROM lc3""",
    "lc5": """SELECT *, coalesce(lag(state) OVER (PARTITION BY mapping_id, bucket_name, resource_name
          ORDER BY seq), 'ABSENT') AS prev_state FROM lc4""",
    "lc6": """SELECT *, CASE action WHEN 'CREATE' THEN prev_state <> 'ACTIVE' AND ok
          WHEN 'UPDATE' THEN prev_state <> 'ABSENT' AND ok ELSE true END AS success FROM lc5""",
    "lc7": """SELECT *, last_value(CASE WHEN action <> 'DELETE' THEN CASE WHEN success THEN seq END
          WHEN prev_state NOT IN ('ABSENT', 'DELETED') THEN -1 END IGNORE NULLS) OVER
          (PARTITION BY mapping_id, bucket_name, resource_name ORDER BY seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shown FROM lc6""",
    "batches": """SELECT mapping_id, bucket_name, resource_name, row_number() OVER
          (PARTITION BY target_database, target_table ORDER BY first_seq) AS slice_batch
        FROM (SELECT mapping_id, bucket_name, resource_name, target_database, target_table, min(seq) AS first_seq
              FROM lc WHERE action = 'CREATE' GROUP BY ALL)""",
    "fold": """SELECT lc7.* EXCLUDE (shown), CASE WHEN shown >= 0 THEN shown END AS visible_seq, b.slice_batch,
          CASE WHEN action = 'CREATE' AND prev_state <> 'ACTIVE' THEN b.slice_batch
               WHEN action = 'UPDATE' AND prev_state <> 'ABSENT' THEN b.slice_batch
               WHEN action = 'DELETE' AND prev_state NOT IN ('ABSENT', 'DELETED') THEN b.slice_batch END AS batch_num
        FROM lc7 LEFT JOIN batches b USING (mapping_id, bucket_name, resource_name)""",
    "registry": """SELECT mapping_id, bucket_name, resource_name, target_database, target_table,
          slice_batch AS batch_num, object_version,
          CASE WHEN seq % 17 = 0 THEN 'LOADING' ELSE state END AS lifecycle_state,
          visible_seq AS visible_attempt, seq AS last_seq, received_at AS updated_at
        FROM fold WHERE state <> 'ABSENT'
        QUALIFY row_number() OVER (PARTITION BY mapping_id, bucket_name, resource_name ORDER BY seq DESC) = 1""",
    "outcomes": f"""SELECT object_event_id, mapping_id, target_database, target_table, batch_num, action,
          CASE WHEN success THEN 'SUCCESS' ELSE 'ERROR' END AS event_status, bucket_name, resource_name,
          object_version, mapping_mode,
          CASE WHEN action = 'CREATE' AND prev_state = 'ACTIVE' THEN '{lifecycle.ALREADY_ACTIVE}'
               WHEN action = 'UPDATE' AND prev_state = 'ABSENT' THEN '{lifecycle.NO_BATCH}'
               WHEN action = 'DELETE' AND prev_state IN ('ABSENT', 'DELETED') THEN '{lifecycle.ABSENT_DELETE}'
               WHEN action = 'DELETE' THEN '{lifecycle.TRUNCATED}'
               WHEN success THEN 'Loaded 0 row(s) by partition exchange.' ELSE 'load failed' END AS message,
          received_at, duration_ms FROM fold
        UNION ALL
        SELECT object_event_id, NULL, NULL, NULL, NULL, action, 'ERROR', bucket_name, resource_name, object_version,
          NULL, CASE WHEN action = 'UNKNOWN' THEN '{lifecycle.UNSUPPORTED}' ELSE '{lifecycle.NO_MAPPING}' END,
          received_at, duration_ms FROM routed WHERE mapping_id IS NULL OR action = 'UNKNOWN'""",
    "tx": """SELECT object_event_id AS id, CASE WHEN object_event_id % 11 <> 0 THEN object_event_id END AS object_event_id,
          mapping_id, target_database, target_table, batch_num, action AS event_action, event_status, bucket_name,
          resource_name, object_version,
          CASE WHEN outcomes.object_event_id % 9 <> 0 THEN mapping_mode END AS invocation_mode, message,
          received_at + duration_ms * INTERVAL 1 MILLISECOND AS created_at
        FROM outcomes""",
    "errs": """SELECT id * 10 AS id, id AS event_log_id, mapping_id, target_database, target_table, event_action,
          'VALUEERROR' AS error_code, message AS error_message, created_at FROM tx WHERE event_status = 'ERROR'""",
    "raw_event": "SELECT " + ", ".join(RAW_COLUMNS) + " FROM obj_event",
    "contents": """SELECT f.mapping_id, f.bucket_name, f.resource_name, f.target_database, f.target_table,
          f.slice_batch AS batch_num, r.object_event_id AS attempt, r.* EXCLUDE (object_event_id)
        FROM fold f JOIN object_rows r ON r.object_event_id = f.object_event_id
        WHERE f.success AND f.action IN ('CREATE', 'UPDATE')""",
}
_NEEDS = {
    "acted": ["obj_event"], "routed": ["acted", "mapping"], "lc": ["routed"], "lc1": ["lc"], "lc2": ["lc1"],
    "lc3": ["lc2"], "lc4": ["lc3"], "lc5": ["lc4"], "lc6": ["lc5"], "lc7": ["lc6"], "batches": ["lc"],
    "fold": ["lc7", "batches"], "registry": ["fold"], "outcomes": ["fold", "routed"], "tx": ["outcomes"],
    "errs": ["tx"], "raw_event": ["obj_event"], "contents": ["fold", "object_rows"],
}


def sql(body: str, *needs: str, **extra: str) -> str:
    """``body`` with the views it names in front as a WITH list; ``extra`` adds its own views."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    parts = [f"{name} AS ({SQL[name]})" for name in order] + [f"{name} AS ({text})" for name, text in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
