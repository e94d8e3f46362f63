"""Queries over routing, lifecycle, audit joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slicelake import schemas
from slicelake.functions import events as ev
from slicelake.operators import audit, lifecycle, quality, routing, skew
from slicelake.operators.lifecycle import SOURCE, TARGET
from slicelake.plans import views as v
from slicelake.plans.registry import query
from slicelake.session import work_dir

FLAGSHIP = v.sql(
    """SELECT r.target_database, r.target_table, count(*) AS routed_sources,
         count(*) FILTER (r.lifecycle_state = 'ACTIVE') AS active_sources,
         count(*) FILTER (s.rows IS NOT NULL) AS sources_with_rows,
         CAST(coalesce(sum(s.rows), 0) AS BIGINT) AS visible_rows,
         CAST(coalesce(sum(s.quantity), 0) AS BIGINT) AS sum_quantity,
         CAST(coalesce(sum(s.amount), 0) AS DECIMAL(28,2)) AS sum_amount
       FROM (SELECT * FROM fold QUALIFY row_number() OVER
               (PARTITION BY mapping_id, bucket_name, resource_name ORDER BY seq DESC) = 1) AS q
         CROSS JOIN LATERAL (SELECT q.target_database, q.target_table, q.state AS lifecycle_state, q.visible_seq AS attempt) r
         LEFT JOIN (SELECT object_event_id, count(*) AS rows, sum(quantity) AS quantity, sum(amount) AS amount
                    FROM object_rows GROUP BY object_event_id) s ON s.object_event_id = r.attempt
       GROUP BY ALL""",
    "fold", "object_rows",
)


def slice_totals(spark, sf_dir) -> DataFrame:
    """Per target: sources with events, active ones, and what their visible versions hold.

    File rows are summed per event before they meet the sources, so no row is ever joined.
    """
    last = skew.latest_per_key(
        lifecycle.fold_lifecycle(v.lifecycle_events(spark, sf_dir)).select(*SOURCE, *TARGET, "seq", "state", "visible_seq"),
        SOURCE, ["seq"],
    )
    sums = v.object_rows(spark, sf_dir).groupBy(F.col("object_event_id").alias("visible_seq")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("quantity"), F.sum("amount").alias("amount")
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return last.join(sums, "visible_seq", "left").groupBy(*TARGET).agg(
        F.count(F.lit(1)).alias("routed_sources"),
        F.count_if(F.col("state") == "ACTIVE").alias("active_sources"),
        F.count("rows").alias("sources_with_rows"),
        zero("rows").cast("bigint").alias("visible_rows"),
        zero("quantity").cast("bigint").alias("sum_quantity"),
        zero("amount").cast("decimal(28,2)").alias("sum_amount"),
    )


query("slice_totals", FLAGSHIP)(slice_totals)


@query(
    "J1_route",
    v.sql(
        """SELECT object_event_id, CAST(mapping_id AS BIGINT) AS mapping_id, target_database, target_table,
           mapping_mode, CAST(worker_threads AS INT) AS worker_threads FROM routed""",
        "routed",
    ),
)
def route(spark, sf_dir):
    return v.routed(spark, sf_dir).select(
        "object_event_id", "mapping_id", *TARGET, "mapping_mode", F.col("worker_threads").cast("int").alias("worker_threads")
    )


@query(
    "J1_route_collated",
    v.sql(
        """SELECT CAST(id AS BIGINT) AS mapping_id, count(*) AS events FROM
           (SELECT object_event_id, m.id FROM obj_event a LEFT JOIN mapping m ON a.bucket_name = m.bucket_name
              AND a.compartment_name = m.compartment_name AND a.resource_name GLOB m.resource_name_pattern
            QUALIFY row_number() OVER (PARTITION BY object_event_id ORDER BY length(m.resource_name_pattern) DESC, m.id) = 1)
           GROUP BY id""",
        "obj_event", "mapping",
    ),
)
def route_collated(spark, sf_dir):
    """Scope compared without case and accents: mappings spelled differently still apply."""
    loud = v.mapping(spark).withColumns(
        {"compartment_name": F.lit("DÉPT"), "bucket_name": F.upper("bucket_name")}
    )
    hits = routing.route(v.obj_event(spark, sf_dir), loud, collation="UNICODE_CI_AI")
    return hits.groupBy("mapping_id").agg(F.count(F.lit(1)).alias("events"))


@query(
    "W1_longest_pattern",
    v.sql("SELECT mapping_id, count(*) AS events FROM routed GROUP BY mapping_id", "routed").replace(
        "SELECT mapping_id, count", "SELECT CAST(mapping_id AS BIGINT) AS mapping_id, count", 1
    ),
)
def longest_pattern(spark, sf_dir):
    """The join form of routing: matches reduced per event by a combining maximum."""
    events = v.obj_event(spark, sf_dir)
    hits = routing.route(events, v.mapping(spark), join_form=True)
    return hits.groupBy("mapping_id").agg(F.count(F.lit(1)).alias("events"))


@query(
    "J2_timing",
    v.sql(
        """SELECT t.id, coalesce(t.invocation_mode, r.invocation_mode, 'UNKNOWN') AS invocation_mode, r.received_at AS event_received_at,
           r.completed_at AS event_completed_at, r.duration_ms AS event_duration_ms
           FROM tx t LEFT JOIN raw_event r ON r.id = t.object_event_id""",
        "tx", "raw_event",
    ),
)
def timing(spark, sf_dir):
    joined = audit.with_timing(v.tx_log(spark, sf_dir), v.raw_event(spark, sf_dir))
    return joined.select("id", "invocation_mode", *audit.TIMING)


@query(
    "J3_detached_processes",
    v.sql(
        """SELECT t.id, CAST(t.mapping_id AS BIGINT) AS mapping_id, event_action, event_status, t.target_database, t.target_table, t.bucket_name,
           resource_name, message, created_at, t.invocation_mode, CAST(coalesce(m.worker_threads, 4) AS INT) AS worker_threads
           FROM tx t LEFT JOIN mapping m ON m.id = t.mapping_id WHERE t.invocation_mode = 'DETACHED'
           ORDER BY created_at DESC, t.id DESC LIMIT 200""",
        "tx", "mapping",
    ),
)
def detached_processes(spark, sf_dir):
    return audit.detached_processes(v.tx_log(spark, sf_dir), v.mapping(spark))


ACTIVITY = """SELECT target_database, target_table, mapping_count, coalesce(n, 0) AS event_count, newest AS last_event_at FROM
    (SELECT target_database, target_table, count(*) AS mapping_count FROM mapping GROUP BY ALL)
    LEFT JOIN (SELECT target_database, target_table, count(DISTINCT id) AS n, max(created_at) AS newest FROM tx GROUP BY ALL)
    USING (target_database, target_table)"""


@query("A1_registered_tables", v.sql(ACTIVITY, "tx", "mapping"))
def registered_tables(spark, sf_dir):
    return audit.registered_tables(v.mapping(spark), v.tx_log(spark, sf_dir))


@query(
    "J4_target_activity",
    v.sql(
        """SELECT 'mart' AS target_database, concat('c', c_custkey) AS target_table, count(o_orderkey) AS event_count
           FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL"""
    ),
)
def target_activity(spark, sf_dir):
    """Customers stand for targets, their orders for transactions; many customers have none."""
    database, name = F.lit("mart").alias("target_database"), "target_table"
    targets = v.table(spark, sf_dir, "customer").select(database, F.concat(F.lit("c"), "c_custkey").alias(name))
    log = v.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), database, F.concat(F.lit("c"), "o_custkey").alias(name),
        F.col("o_orderdate").alias("created_at"),
    )
    return audit.registered_tables(targets, log).select(*TARGET, "event_count")


LINKED = """SELECT r.id, coalesce(d.event_status, f.event_status, CASE WHEN r.completed_at IS NULL THEN 'RECEIVED' ELSE 'COMPLETED' END) AS lifecycle_status,
      CASE WHEN d.id IS NOT NULL THEN de.error_id ELSE fe.error_id END AS error_id,
      CASE WHEN d.id IS NOT NULL THEN coalesce(d.invocation_mode, 'UNKNOWN') WHEN f.id IS NOT NULL THEN coalesce(f.invocation_mode, 'UNKNOWN')
        ELSE coalesce(r.invocation_mode, 'UNKNOWN') END AS invocation_mode
    FROM (SELECT raw_event.*, nullif(acted.action, 'UNKNOWN') AS action FROM raw_event JOIN acted ON acted.object_event_id = raw_event.id) r
    LEFT JOIN (SELECT * FROM tx WHERE object_event_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY object_event_id ORDER BY id DESC) = 1) d
      ON d.object_event_id = r.id
    LEFT JOIN (SELECT * FROM tx WHERE object_event_id IS NULL QUALIFY row_number() OVER
        (PARTITION BY bucket_name, resource_name, event_action ORDER BY created_at DESC, id DESC) = 1) f
      ON d.id IS NULL AND f.bucket_name IS NOT DISTINCT FROM r.bucket_name AND f.resource_name IS NOT DISTINCT FROM r.resource_name
        AND f.event_action = r.action
    LEFT JOIN (SELECT event_log_id, max(id) AS error_id FROM errs GROUP BY 1) de ON de.event_log_id = d.id
    LEFT JOIN (SELECT event_log_id, max(id) AS error_id FROM errs GROUP BY 1) fe ON fe.event_log_id = f.id"""


@query("J5_lifecycle_link", v.sql(LINKED, "tx", "errs", "raw_event"))
def lifecycle_link(spark, sf_dir):
    linked = audit.link_lifecycle(v.raw_event(spark, sf_dir), v.tx_log(spark, sf_dir), v.errors(spark, sf_dir))
    return linked.select("id", "lifecycle_status", "error_id", "invocation_mode")


VISIBLE = """SELECT c.* FROM contents c SEMI JOIN registry r ON c.target_database = r.target_database
    AND c.target_table = r.target_table AND c.batch_num = r.batch_num AND c.attempt = r.visible_attempt"""


@query(
    "J6_visible_rows",
    v.sql(
        f"""SELECT target_database, target_table, CAST(batch_num AS BIGINT) AS batch_num, attempt, count(*) AS rows,
            CAST(sum(quantity) AS BIGINT) AS quantity FROM ({VISIBLE}) GROUP BY ALL""",
        "contents", "registry",
    ),
)
def visible_rows(spark, sf_dir):
    shown = audit.visible_rows(v.contents(spark, sf_dir), v.registry(spark, sf_dir))
    return shown.groupBy(*TARGET, "batch_num", "attempt").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("quantity")
    )


@query(
    "S4_visible_target",
    v.sql(
        f"""SELECT l_linenumber, l_partkey, l_suppkey, quantity, amount, l_returnflag, l_shipdate FROM ({VISIBLE})
            WHERE target_table = 'eu_feed'""",
        "contents", "registry",
    ),
)
def visible_target(spark, sf_dir):
    return audit.target_view(v.contents(spark, sf_dir), v.registry(spark, sf_dir), "mart", "eu_feed")


@query(
    "J7_registered_target",
    v.sql(
        """SELECT c_custkey AS id, 'mart' AS target_database, concat('c', c_custkey) AS target_table
           FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"""
    ),
)
def registered_target(spark, sf_dir):
    """Of the customers' targets, those that a mapping names; the orders stand for mappings."""
    database, name = F.lit("mart").alias("target_database"), "target_table"
    events = v.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), database, F.concat(F.lit("c"), "c_custkey").alias(name)
    )
    known = v.table(spark, sf_dir, "orders").select(database, F.concat(F.lit("c"), "o_custkey").alias(name))
    return audit.registered_only(events, known).select("id", *TARGET)


@query(
    "J8_reset_target",
    v.sql(
        """SELECT target_table, count(*) AS slices FROM registry WHERE NOT (target_database = 'mart' AND target_table = 'us_feed')
           GROUP BY target_table""",
        "registry",
    ),
)
def reset_target(spark, sf_dir):
    kept = lifecycle.reset_target(v.registry(spark, sf_dir), "mart", "us_feed")
    return kept.groupBy("target_table").agg(F.count(F.lit(1)).alias("slices"))


@query(
    "J9_pattern_conflict",
    v.sql(
        """SELECT id, compartment_name, bucket_name, resource_name_pattern, (SELECT min(o.id) FROM customer_mapping o
             WHERE o.compartment_name = m.compartment_name AND o.bucket_name = m.bucket_name
               AND o.resource_name_pattern = m.resource_name_pattern AND o.id <> m.id) AS conflict_id
           FROM customer_mapping m WHERE conflict_id IS NOT NULL""",
        "customer_mapping",
    ),
)
def pattern_conflict(spark, sf_dir):
    return routing.pattern_conflicts(v.customer_mappings(spark, sf_dir))


ORPHANS = """SELECT a.*, EXISTS (SELECT 1 FROM registry b WHERE b.target_table = a.target_table AND b.lifecycle_state = 'LOADING'
      AND date_sub('second', b.updated_at, TIMESTAMP '2024-01-30 12:00:00') <= 43200) AS blocked
    FROM (SELECT target_database, target_table, CAST(slice_batch AS BIGINT) AS batch_num, object_event_id AS attempt
          FROM fold WHERE success AND action IN ('CREATE', 'UPDATE')) a
    ANTI JOIN registry r ON r.target_database = a.target_database AND r.target_table = a.target_table
      AND r.batch_num = a.batch_num AND r.visible_attempt = a.attempt"""


def attempts(spark, sf_dir) -> DataFrame:
    loads = v.folded(spark, sf_dir).where(F.col("success") & F.col("action").isin("CREATE", "UPDATE"))
    return loads.select(*TARGET, F.col("slice_batch").alias("batch_num"), F.col("object_event_id").alias("attempt"))


@query("J10_orphan_attempts", v.sql(ORPHANS, "fold", "registry"))
def orphan_attempts(spark, sf_dir):
    registry = v.registry(spark, sf_dir)
    return audit.orphan_attempts(attempts(spark, sf_dir), registry, "2024-01-30 12:00:00", 43200)


@query(
    "J11_verify_load",
    v.sql(
        f"""SELECT t.resource_name, t.event_action, t.event_status, coalesce(a.rows, 0) AS actual_rows, coalesce(e.rows, 0) AS expected_rows,
              t.event_status = 'SUCCESS' AND coalesce(a.rows, 0) = coalesce(e.rows, 0) AS verified
            FROM (SELECT * FROM tx QUALIFY row_number() OVER (PARTITION BY resource_name, event_action ORDER BY id DESC) = 1) t
            LEFT JOIN (SELECT resource_name, count(*) AS rows FROM ({VISIBLE}) GROUP BY 1) a ON a.resource_name = t.resource_name
            LEFT JOIN (SELECT resource_name, count(*) AS rows FROM contents GROUP BY 1) e ON e.resource_name = t.resource_name""",
        "tx", "contents", "registry",
    ),
)
def verify_load(spark, sf_dir):
    data = v.contents(spark, sf_dir)
    rows = lambda df: df.groupBy("resource_name").agg(F.count(F.lit(1)).alias("rows"))
    actual = rows(audit.visible_rows(data, v.registry(spark, sf_dir)))
    return audit.verify_load(v.tx_log(spark, sf_dir), actual, rows(data)).select(
        "resource_name", "event_action", "event_status", "actual_rows", "expected_rows", "verified"
    )


@query(
    "J12_audit_gaps",
    v.sql(
        """SELECT CASE WHEN t.id IS NULL THEN 'event without transaction' ELSE 'transaction without event' END AS gap,
             coalesce(r.id, t.id) AS id FROM raw_event r FULL JOIN tx t ON t.object_event_id = r.id WHERE r.id IS NULL OR t.id IS NULL""",
        "tx", "raw_event",
    ),
)
def audit_gaps(spark, sf_dir):
    return audit.audit_gaps(v.raw_event(spark, sf_dir), v.tx_log(spark, sf_dir))


# ---------------------------------------------------------------- windows

@query(
    "W2_latest_per_key",
    v.sql(
        """SELECT bucket_name, resource_name, event_action, id, event_status FROM tx
           QUALIFY row_number() OVER (PARTITION BY bucket_name, resource_name, event_action ORDER BY id DESC) = 1""",
        "tx",
    ),
)
def latest(spark, sf_dir):
    keys = ["bucket_name", "resource_name", "event_action"]
    return skew.latest_per_key(v.tx_log(spark, sf_dir).select(*keys, "id", "event_status"), keys, ["id"])


@query(
    "W3_lifecycle_fold",
    v.sql("SELECT object_event_id, action, prev_state, state, success, visible_seq FROM fold", "fold"),
)
def lifecycle_fold(spark, sf_dir):
    rows = lifecycle.fold_lifecycle(v.lifecycle_events(spark, sf_dir))
    return rows.select("object_event_id", "action", "prev_state", "state", "success", "visible_seq")


@query(
    "W3_lifecycle_fold_hot_sources",
    v.sql("SELECT object_event_id, prev_state, state, success, visible_seq FROM fold", "fold"),
)
def lifecycle_fold_hot(spark, sf_dir):
    """The same fold with every busier source treated as hot: scanned in blocks and chained."""
    rows = lifecycle.fold_lifecycle(v.lifecycle_events(spark, sf_dir), min_hot_rows=40, block_rows=256)
    return rows.select("object_event_id", "prev_state", "state", "success", "visible_seq")


@query(
    "W4_allocate_batches",
    v.sql("SELECT CAST(mapping_id AS BIGINT) AS mapping_id, bucket_name, resource_name, slice_batch AS batch_num FROM batches", "batches"),
)
def allocate_batches(spark, sf_dir):
    return lifecycle.allocate_batches(v.lifecycle_events(spark, sf_dir)).select(*SOURCE, "batch_num")


@query(
    "W7_attempt_numbers",
    v.sql(
        """SELECT bucket_name, resource_name, event_action, id, row_number() OVER w AS attempt_no,
             count(*) FILTER (event_status = 'ERROR') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failures_before
           FROM tx WINDOW w AS (PARTITION BY bucket_name, resource_name, event_action ORDER BY id)""",
        "tx",
    ),
)
def attempt_numbers(spark, sf_dir):
    return audit.attempt_numbers(v.tx_log(spark, sf_dir)).select(
        "bucket_name", "resource_name", "event_action", "id", "attempt_no", "failures_before"
    )


# ---------------------------------------------------------------- control tables, publication rules

@query(
    "S8_control_scan",
    v.sql("SELECT count(*) AS rows, count(event_rule_id) AS rules, min(invocation_mode) AS lowest_mode FROM (SELECT *, NULL AS event_rule_id FROM customer_mapping)", "customer_mapping"),
)
def control_scan(spark, sf_dir):
    """A control table written before some columns existed, plus one that does not exist."""
    import uuid

    from slicelake.sources import control

    name = f"slicelake_{uuid.uuid4().hex[:8]}"
    old = v.customer_mappings(spark, sf_dir).drop("worker_threads")
    old_schema = control.upgrade(old, "object_storage_mappings")
    missing = control.control(spark, "event_errors", name)
    return old_schema.unionByName(
        missing.select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.CONTROL["object_storage_mappings"]]
        )
    ).agg(
        F.count(F.lit(1)).alias("rows"), F.count("event_rule_id").alias("rules"), F.min("invocation_mode").alias("lowest_mode")
    )


@query(
    "K2_validate_stage",
    v.sql(
        """SELECT attempt, count(*) AS foreign_rows FROM (SELECT attempt, batch_num AS expected_batch,
             CASE WHEN l_partkey % 97 = 0 THEN batch_num + 1 ELSE batch_num END AS batch_num FROM contents)
           WHERE batch_num <> expected_batch GROUP BY attempt""",
        "contents",
    ),
)
def validate_stage(spark, sf_dir):
    wrong = F.when(F.col("l_partkey") % 97 == 0, F.col("batch_num") + 1).otherwise(F.col("batch_num"))
    staged = v.contents(spark, sf_dir).withColumn("expected_batch", F.col("batch_num")).withColumn("batch_num", wrong)
    return quality.stage_purity(staged)


@query(
    "K4_retire_slices",
    v.sql(
        """SELECT target_table, lifecycle_state, count(*) AS slices, count(visible_attempt) AS showing FROM
           (SELECT target_table, CASE WHEN batch_num % 2 = 0 AND lifecycle_state IN ('ACTIVE', 'ERROR') THEN 'DELETED' ELSE lifecycle_state END AS lifecycle_state,
              CASE WHEN NOT (batch_num % 2 = 0 AND lifecycle_state IN ('ACTIVE', 'ERROR')) THEN visible_attempt END AS visible_attempt FROM registry)
           GROUP BY ALL""",
        "registry",
    ),
)
def retire_slices(spark, sf_dir):
    registry = v.registry(spark, sf_dir)
    after = lifecycle.retire(registry, registry.where(F.col("batch_num") % 2 == 0))
    return after.groupBy("target_table", "lifecycle_state").agg(
        F.count(F.lit(1)).alias("slices"), F.count("visible_attempt").alias("showing")
    )


@query(
    "K6_transaction_rows",
    v.sql(
        """SELECT id, object_event_id, CAST(mapping_id AS BIGINT) AS mapping_id, target_database, target_table, CAST(batch_num AS BIGINT) AS batch_num,
           event_action, event_status, bucket_name, resource_name, object_version, invocation_mode, message, created_at FROM tx""",
        "tx",
    ),
)
def transaction_rows(spark, sf_dir):
    return v.tx_log(spark, sf_dir)


@query(
    "K7_error_rows",
    v.sql(
        """SELECT id AS event_log_id, CAST(mapping_id AS BIGINT) AS mapping_id, target_database, target_table, event_action,
           CASE WHEN id % 2 = 0 THEN 'TARGET_TABLE_NOT_FOUND' ELSE 'A' || repeat('R', 63) END AS error_code,
           message AS error_message, created_at FROM tx WHERE event_status = 'ERROR'""",
        "tx",
    ),
)
def error_rows(spark, sf_dir):
    kind = F.when(F.col("id") % 2 == 0, "TargetTableError").otherwise(F.concat(F.lit("a"), F.repeat(F.lit("r"), 80)))
    return audit.error_rows(v.tx_log(spark, sf_dir), kind)


@query(
    "M7_merge_registry",
    v.sql(
        """SELECT target_table, lifecycle_state, count(*) AS slices, CAST(sum(last_seq) AS BIGINT) AS sum_seq,
           CAST(sum(batch_num) AS BIGINT) AS sum_batch FROM registry GROUP BY ALL""",
        "registry",
    ),
)
def merge_registry(spark, sf_dir):
    """The registry rebuilt in two micro-batches: early events, then late ones on top."""
    events = v.lifecycle_events(spark, sf_dir)
    half = events.agg(F.floor(F.avg("seq")).alias("m")).scalar()
    empty = spark.createDataFrame([], schemas.CONTROL["source_object_batches"])

    def rows(folded: DataFrame) -> DataFrame:
        last = lifecycle.last_states(folded)
        return last.select(
            *SOURCE, *TARGET, F.col("slice_batch").alias("batch_num"),
            ev.source_key(F.col("mapping_id"), F.col("bucket_name"), F.col("resource_name")).alias("source_key"),
            "object_version", F.col("state").alias("lifecycle_state"), F.col("visible_seq").alias("visible_attempt"),
            F.col("seq").alias("last_seq"), F.col("received_at").alias("updated_at"),
        ).select(*empty.columns)

    early = events.where(F.col("seq") < half)
    first = lifecycle.with_batches(lifecycle.fold_lifecycle(early), lifecycle.allocate_batches(early))
    # committed, as an ingest would
    folder = work_dir(spark, "registry")
    rows(first).write.parquet(folder)
    registry = spark.read.parquet(folder)
    late = events.where(F.col("seq") >= half)
    second = lifecycle.with_batches(
        lifecycle.fold_lifecycle(late, registry), lifecycle.allocate_batches(late, registry)
    )
    merged = lifecycle.merge_registry(registry, rows(second))
    state = F.when(F.col("last_seq") % 17 == 0, "LOADING").otherwise(F.col("lifecycle_state"))
    return merged.withColumn("lifecycle_state", state).groupBy("target_table", "lifecycle_state").agg(
        F.count(F.lit(1)).alias("slices"), F.sum("last_seq").alias("sum_seq"), F.sum("batch_num").alias("sum_batch")
    )
