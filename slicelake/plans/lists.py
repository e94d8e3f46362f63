"""Queries over lists, pages, exports and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from slicelake.operators import audit, paging, quality
from slicelake.plans import views as v
from slicelake.plans.joins import VISIBLE
from slicelake.plans.registry import query
from slicelake.sinks import export

TIMED = """SELECT t.id, CAST(t.mapping_id AS BIGINT) AS mapping_id, t.target_database, t.target_table, event_action, event_status,
    coalesce(t.invocation_mode, r.invocation_mode, 'UNKNOWN') AS invocation_mode, created_at, r.received_at AS event_received_at,
    r.duration_ms AS event_duration_ms FROM tx t LEFT JOIN raw_event r ON r.id = t.object_event_id"""
SHOWN = [
    "id", "mapping_id", "target_database", "target_table", "event_action", "event_status", "invocation_mode",
    "created_at", "event_received_at", "event_duration_ms",
]


@query("O1_recent_all", v.sql(f"{TIMED} ORDER BY created_at DESC, t.id DESC LIMIT 50", "tx", "raw_event"))
def recent_all(spark, sf_dir):
    """Cut to the newest rows first, then look up their timing."""
    top = paging.recent(v.tx_log(spark, sf_dir), 50)
    return audit.with_timing(top, v.raw_event(spark, sf_dir)).select(*SHOWN)


@query(
    "O2_recent_target",
    v.sql(f"SELECT * FROM ({TIMED}) WHERE target_table = 'us_feed' ORDER BY created_at DESC, id DESC LIMIT 100", "tx", "raw_event"),
)
def recent_target(spark, sf_dir):
    top = paging.recent(v.tx_log(spark, sf_dir), 100, ("mart", "us_feed"))
    return audit.with_timing(top, v.raw_event(spark, sf_dir)).select(*SHOWN)


@query(
    "O3_transaction_page",
    v.sql(
        """SELECT id, event_action, created_at, (SELECT count(*) FROM tx WHERE target_table = 'eu_feed') AS total FROM tx
           WHERE target_table = 'eu_feed' ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 250""",
        "tx",
    ),
)
def transaction_page(spark, sf_dir):
    mine = v.tx_log(spark, sf_dir).where(F.col("target_table") == "eu_feed")
    rows, total = paging.page(mine, 11, 25, "created_at")
    return rows.select("id", "event_action", "created_at", F.lit(total).cast("bigint").alias("total"))


@query(
    "O3_last_page_clamped",
    v.sql(
        """SELECT id FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) - 1 AS p, count(*) OVER () AS n
           FROM tx WHERE target_table = 'eu_feed') WHERE p // 25 = (n - 1) // 25""",
        "tx",
    ),
)
def last_page(spark, sf_dir):
    mine = v.tx_log(spark, sf_dir).where(F.col("target_table") == "eu_feed")
    return paging.page(mine, 10**6, 25, "created_at")[0].select("id")


@query(
    "O4_event_page",
    v.sql("SELECT id, event_type, event_time FROM raw_event ORDER BY event_date DESC, id DESC LIMIT 40 OFFSET 400", "raw_event"),
)
def event_page(spark, sf_dir):
    return paging.event_page(v.raw_event(spark, sf_dir), 11, 40, "no_such_column")[0].select("id", "event_type", "event_time")


@query(
    "O5_target_page",
    v.sql(
        f"SELECT l_partkey, l_linenumber, quantity, amount FROM ({VISIBLE}) WHERE target_table = 'all_feed' "
        "ORDER BY amount, l_partkey LIMIT 20 OFFSET 20",
        "contents", "registry",
    ),
)
def target_page(spark, sf_dir):
    rows = audit.target_view(v.contents(spark, sf_dir), v.registry(spark, sf_dir), "mart", "all_feed")
    chosen, _ = paging.page(rows, 2, 20, "amount", descending=False, tie="l_partkey", clamp=False)
    return chosen.select("l_partkey", "l_linenumber", "quantity", "amount")


RECENT_ERRORS = """SELECT id, CAST(mapping_id AS BIGINT) AS mapping_id, event_action, error_code, error_message, created_at FROM errs"""


@query(
    "O6_recent_errors",
    v.sql(
        f"""(SELECT * FROM ({RECENT_ERRORS}) ORDER BY created_at DESC, id DESC LIMIT 30)
            UNION (SELECT * FROM ({RECENT_ERRORS}) WHERE id = 40)""",
        "errs",
    ),
)
def recent_errors(spark, sf_dir):
    return paging.recent_errors(v.errors(spark, sf_dir), 30, 40).select(
        "id", "mapping_id", "event_action", "error_code", "error_message", "created_at"
    )


EXPORT = ["id", "event_date", "event_type", "bucket_name", "compartment_name", "resource_name", "received_at"]


@query(
    "O7_event_export",
    v.sql(f"SELECT {', '.join(EXPORT)}, completed_at, duration_ms, event_time FROM raw_event ORDER BY event_date DESC, id DESC", "raw_event"),
)
def event_export(spark, sf_dir):
    return paging.export_view(v.raw_event(spark, sf_dir))


@query(
    "K8_export_guard",
    """SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, CASE WHEN regexp_matches(label, '^[-=+@]') THEN concat('''', label) ELSE label END AS label,
       CASE WHEN x IS NULL THEN '' WHEN x < 0 THEN concat('''', x) ELSE CAST(x AS VARCHAR) END AS x FROM
       (SELECT s_suppkey, concat(CASE s_suppkey % 6 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN ' =' ELSE '' END, s_name) AS label,
        CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey - 12 END AS x FROM supplier)""",
)
def export_guard(spark, sf_dir):
    s = v.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey",
        "concat(CASE s_suppkey % 6 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN ' =' ELSE '' END, s_name) AS label",
        "CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey - 12 END AS x",
    )
    return export.export_rows(s)


@query(
    "O8_mapping_list",
    v.sql("SELECT * FROM customer_mapping ORDER BY compartment_name, bucket_name, resource_name_pattern, id", "customer_mapping"),
)
def mapping_list(spark, sf_dir):
    return paging.list_mappings(v.customer_mappings(spark, sf_dir))


@query(
    "U1_prepend_if_absent",
    v.sql("(SELECT id FROM raw_event ORDER BY event_date DESC, id DESC LIMIT 10) UNION (SELECT id FROM raw_event WHERE id IN (3, 995))", "raw_event"),
)
def prepend_if_absent(spark, sf_dir):
    raw = v.raw_event(spark, sf_dir).select("id", "event_date")
    top = raw.orderBy(F.desc("event_date"), F.desc("id")).limit(10)
    return paging.prepend_if_absent(top, raw.where(F.col("id").isin(3, 995))).select("id")


HEADER = """concat(CASE object_event_id % 3 WHEN 0 THEN 'L_ORDERKEY' WHEN 1 THEN 'l_orderkey' ELSE 'Order' END, ',', 'Quantity', ',',
    CASE WHEN object_event_id % 5 = 0 THEN 'QUANTITY' WHEN object_event_id % 5 = 1 THEN 'extra' ELSE 'amount' END)"""
EXPECTED = ["l_orderkey", "quantity", "amount"]


def headers(spark, sf_dir):
    e = v.obj_event(spark, sf_dir)
    return e.select(F.col("object_event_id").alias("file"), F.split(F.expr(HEADER), ",").alias("header"))


HEADERS = f"SELECT object_event_id AS file, string_split({HEADER}, ',') AS header FROM obj_event"
DIFF = """SELECT file, header, list_filter(['l_orderkey', 'quantity', 'amount'], lambda x: NOT list_contains(list_transform(header, lambda h: lower(h)), x)) AS missing,
    list_filter(header, lambda h: NOT list_contains(['l_orderkey', 'quantity', 'amount'], lower(h))) AS unknown FROM headers"""


@query(
    "U2_header_difference",
    v.sql("SELECT file, array_to_string(missing, ',') AS missing, array_to_string(unknown, ',') AS unknown FROM diff", "obj_event", headers=HEADERS, diff=DIFF),
)
def header_difference(spark, sf_dir):
    diff = quality.header_diff(F.col("header"), F.array(*[F.lit(c) for c in EXPECTED]))
    return headers(spark, sf_dir).withColumn("d", diff).select(
        "file", F.array_join("d.missing", ",").alias("missing"), F.array_join("d.unknown", ",").alias("unknown")
    )
