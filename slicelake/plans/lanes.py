"""Queries over ordered lanes, duplicates and control-table merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slicelake import schemas
from slicelake.operators import mappings as upkeep
from slicelake.operators import metrics, ordering, skew
from slicelake.operators.lifecycle import SOURCE
from slicelake.plans import views as v
from slicelake.plans.registry import query
from slicelake.streaming.ingest import split_by_mode

# Arrival is disturbed, so that lanes see late events.
ENTRIES = """SELECT object_event_id AS id, concat('table:', target_database, '.', target_table) AS lane, mapping_id, bucket_name, resource_name,
    event_time, event_time + (object_event_id * 7919 % 5000) * INTERVAL 1 SECOND AS received_at, action,
    CASE WHEN object_event_id % 400 = 7 THEN 'LOADING' ELSE 'SUCCESS' END AS status FROM lc"""


def entries(spark, sf_dir) -> DataFrame:
    e = v.lifecycle_events(spark, sf_dir)
    return e.select(
        F.col("object_event_id").alias("id"), ordering.lane_key("table").alias("lane"), *SOURCE, "event_time",
        F.expr("event_time + (object_event_id * 7919 % 5000) * INTERVAL 1 SECOND").alias("received_at"), "action",
        F.when(F.col("object_event_id") % 400 == 7, "LOADING").otherwise("SUCCESS").alias("status"),
    )


@query(
    "D1_lane_key",
    v.sql(
        """SELECT object_event_id AS id, concat('table:', target_database, '.', target_table) AS table_lane,
           concat('mapping:', mapping_id) AS mapping_lane FROM lc""",
        "lc",
    ),
)
def lane_key(spark, sf_dir):
    return v.lifecycle_events(spark, sf_dir).select(
        F.col("object_event_id").alias("id"), ordering.lane_key("table").alias("table_lane"),
        ordering.lane_key("mapping").alias("mapping_lane"),
    )


@query(
    "D2_lane_order",
    v.sql("SELECT id, row_number() OVER (PARTITION BY lane ORDER BY event_time, received_at, id) AS lane_position FROM entries", "lc", entries=ENTRIES),
)
def lane_order(spark, sf_dir):
    return ordering.lane_order(entries(spark, sf_dir)).select("id", "lane_position")


@query(
    "D3_reorder_grace",
    v.sql(
        """SELECT id, received_at + INTERVAL 90 SECOND AS eligible_at, coalesce(max(event_time) OVER (PARTITION BY lane ORDER BY received_at, id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > event_time, false) AS late FROM entries""",
        "lc", entries=ENTRIES,
    ),
)
def reorder_grace(spark, sf_dir):
    return ordering.grace_flags(entries(spark, sf_dir), 90).select("id", "eligible_at", "late")


@query(
    "D4_head_of_line",
    v.sql(
        """SELECT id, coalesce(max(CASE WHEN status <> 'SUCCESS' THEN 1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY event_time, received_at, id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS blocked FROM entries""",
        "lc", entries=ENTRIES,
    ),
)
def head_of_line(spark, sf_dir):
    return ordering.head_of_line(entries(spark, sf_dir)).select("id", "blocked")


@query(
    "D5_stale_guard",
    v.sql(
        """SELECT id, action <> 'DELETE' AND id <> first_value(id) OVER (PARTITION BY mapping_id, bucket_name, resource_name
           ORDER BY event_time DESC, received_at DESC, id DESC) AS stale FROM entries""",
        "lc", entries=ENTRIES,
    ),
)
def stale_guard(spark, sf_dir):
    return ordering.stale_guard(entries(spark, sf_dir), SOURCE).select("id", "stale")


@query(
    "D6_idempotency_key",
    v.sql("SELECT object_event_id, sha256(concat(object_event_id, chr(31), object_version, chr(31), action)) AS idempotency_key FROM lc", "lc"),
)
def idempotency_key(spark, sf_dir):
    key = ordering.idempotency_key(F.col("object_event_id"), F.col("object_version"), F.col("action"))
    return v.lifecycle_events(spark, sf_dir).select("object_event_id", key.alias("idempotency_key"))


@query(
    "D7_budget_check",
    v.sql(
        """SELECT object_event_id, CASE WHEN need > 100 THEN 'BLOCKED' WHEN rest > need THEN 'START' ELSE 'DEFER' END AS decision FROM
           (SELECT object_event_id, object_event_id % 120 AS rest, greatest(30, coalesce(p95, 0) * 1.35) + 20 AS need FROM lc
            LEFT JOIN (SELECT mapping_id, quantile_cont(duration_ms / 100.0::DOUBLE, 0.95) AS p95 FROM lc WHERE ok GROUP BY 1) h USING (mapping_id))""",
        "lc",
    ),
)
def budget_check(spark, sf_dir):
    e = v.lifecycle_events(spark, sf_dir)
    history = e.where("ok").select("mapping_id", (F.col("duration_ms") / F.lit(100.0)).alias("seconds"))
    queue = e.select("object_event_id", "mapping_id", (F.col("object_event_id") % 120).cast("double").alias("remaining_seconds"))
    return ordering.budget_check(queue, history, budget=100.0).select("object_event_id", "decision")


MANIFEST = """SELECT o_custkey AS dataset, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS chunk,
    count(*) OVER (PARTITION BY o_custkey) + CASE WHEN o_custkey % 17 = 0 THEN 1 ELSE 0 END AS chunks,
    CAST(floor(o_totalprice) AS BIGINT) AS rows, o_orderkey AS resource_name, o_orderstatus FROM orders"""


@query(
    "D8_manifest_status",
    v.sql(
        """SELECT dataset, max(chunks) AS expected_chunks, count(*) FILTER (good) AS good_chunks,
             bool_and(good) AND count(*) FILTER (good) = max(chunks) AS complete FROM
           (SELECT *, o_orderstatus <> 'P' OR resource_name % 2 = 0 AS good FROM m) GROUP BY dataset""",
        m=MANIFEST,
    ),
)
def manifest_status(spark, sf_dir):
    """A customer's orders as the chunks of one data set; some orders failed, some sets lack a chunk."""
    orders = v.table(spark, sf_dir, "orders")
    ranked = skew.rank_rows(
        orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_orderkey")],
        skew.seq_block("o_orderkey"), "chunk",
    )
    sizes = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    manifest = ranked.join(sizes, "o_custkey").select(
        F.col("o_custkey").alias("dataset"), "chunk",
        (F.col("n") + F.when(F.col("o_custkey") % 17 == 0, 1).otherwise(0)).alias("chunks"),
        F.floor("o_totalprice").cast("bigint").alias("rows"), F.col("o_orderkey").alias("resource_name"),
    )
    failed = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 != 0)
    outcomes = orders.select(
        F.col("o_orderkey").alias("resource_name"), F.when(failed, "ERROR").otherwise("SUCCESS").alias("event_status"),
        F.floor("o_totalprice").cast("bigint").alias("loaded_rows"),
    )
    return ordering.manifest_status(manifest, outcomes)


# ---------------------------------------------------------------- duplicates, modes, rates

@query(
    "X2_deduplicate",
    v.sql("SELECT action, count(*) AS events FROM (SELECT DISTINCT object_event_id, object_version, action FROM acted) GROUP BY action", "acted"),
)
def deduplicate(spark, sf_dir):
    """Every third event delivered twice, every fifth three times."""
    from slicelake.functions import events as ev

    i = F.col("object_event_id")
    e = v.obj_event(spark, sf_dir)
    times = F.when(i % 5 == 0, 3).when(i % 3 == 0, 2).otherwise(1)
    delivered = e.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).select(
        i.alias("event_id"),
        ev.object_version(F.col("version_id"), F.col("etag"), F.concat(F.lit("id-"), i)).alias("version"),
        ev.event_action(F.col("event_type"), "UNKNOWN").alias("action"),
    )
    return ordering.dedup_events(delivered).groupBy("action").agg(F.count(F.lit(1)).alias("events"))


@query(
    "X4_split_by_mode",
    v.sql(
        """SELECT CASE WHEN mapping_mode = 'DETACHED' THEN 'later' ELSE 'now' END AS handled, mapping_mode AS invocation_mode, count(*) AS events
           FROM routed GROUP BY ALL""",
        "routed",
    ),
)
def split(spark, sf_dir):
    now, later = split_by_mode(v.routed(spark, sf_dir).withColumn("invocation_mode", F.col("mapping_mode")))
    both = now.withColumn("handled", F.lit("now")).unionByName(later.withColumn("handled", F.lit("later")))
    return both.groupBy("handled", "invocation_mode").agg(F.count(F.lit(1)).alias("events"))


@query(
    "X7_event_rates",
    v.sql(
        """SELECT time_bucket(INTERVAL 6 HOUR, created_at, TIMESTAMP '1970-01-01') AS window_start,
             time_bucket(INTERVAL 6 HOUR, created_at, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_end,
             target_database, target_table, count(*) AS events, count(*) FILTER (event_status = 'ERROR') AS errors FROM tx GROUP BY ALL""",
        "tx",
    ),
)
def event_rates(spark, sf_dir):
    return metrics.event_rates(v.tx_log(spark, sf_dir), "6 hours")


# ---------------------------------------------------------------- control-table merges

CHANGES = """SELECT o_orderkey AS change_no, CASE o_orderkey % 4 WHEN 0 THEN 'insert' WHEN 3 THEN 'delete' ELSE 'update' END AS op,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey * 3 END AS id, concat('dept-', o_orderkey) AS compartment_name, 'bucket-9' AS bucket_name,
    concat('feed/', o_orderkey, '/*.csv') AS resource_name_pattern, 'mart' AS target_database, 'changed' AS target_table,
    CASE WHEN o_orderkey % 8 < 4 THEN 'SYNC' ELSE 'DETACHED' END AS invocation_mode, CAST(o_orderkey % 64 + 1 AS INT) AS worker_threads FROM orders"""


def changes(spark, sf_dir) -> DataFrame:
    """Orders as a feed of edits to the customers' mappings; two thirds of the ids do not exist."""
    text = CHANGES.removesuffix(" FROM orders").removeprefix("SELECT ")
    return v.table(spark, sf_dir, "orders").selectExpr(*_split_columns(text))


def _split_columns(text: str) -> list[str]:
    depth, out, start = 0, [], 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


_COLUMNS = ", ".join(upkeep.VALUES)


@query(
    "M1_mapping_changes",
    v.sql(
        f"""SELECT id, {_COLUMNS} FROM (
              SELECT m.id, {', '.join(f'coalesce(u.{c}, m.{c}) AS {c}' for c in upkeep.VALUES)} FROM customer_mapping m
              LEFT JOIN (SELECT * FROM changes WHERE op = 'update' QUALIFY row_number() OVER (PARTITION BY id ORDER BY change_no DESC) = 1) u ON u.id = m.id
              WHERE m.id NOT IN (SELECT id FROM changes WHERE op = 'delete'))
            UNION ALL SELECT (SELECT max(id) FROM customer_mapping) + row_number() OVER (ORDER BY change_no), {_COLUMNS} FROM changes WHERE op = 'insert'""",
        "customer_mapping", changes=CHANGES,
    ),
)
def mapping_changes(spark, sf_dir):
    return upkeep.apply_mapping_changes(v.customer_mappings(spark, sf_dir), changes(spark, sf_dir))


@query(
    "M1_change_outcomes",
    v.sql(
        """SELECT change_no, op, op = 'insert' OR (id IN (SELECT id FROM customer_mapping) AND coalesce(change_no <= d, true)) AS affected
           FROM changes LEFT JOIN (SELECT id AS did, min(change_no) AS d FROM changes WHERE op = 'delete' GROUP BY id) ON did = id""",
        "customer_mapping", changes=CHANGES,
    ),
)
def change_outcomes(spark, sf_dir):
    return upkeep.change_outcomes(v.customer_mappings(spark, sf_dir), changes(spark, sf_dir))


@query(
    "M6_schema_upgrade",
    v.sql(
        """SELECT id, compartment_name, bucket_name, resource_name_pattern, target_database, target_table, 'SYNC' AS invocation_mode,
           CAST(4 AS INT) AS worker_threads, CAST(NULL AS VARCHAR) AS event_rule_id, CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at
           FROM customer_mapping""",
        "customer_mapping",
    ),
)
def schema_upgrade(spark, sf_dir):
    name = "object_storage_mappings"
    old = v.customer_mappings(spark, sf_dir).drop("invocation_mode", "worker_threads")
    return upkeep.upgrade_schema(old, schemas.CONTROL[name], schemas.UPGRADE_DEFAULTS[name])
