"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slicelake.functions import events as ev
from slicelake.functions import names
from slicelake.operators import metrics, paging, routing
from slicelake.plans import views as v
from slicelake.plans.registry import query
from slicelake.session import work_dir
from slicelake.sources import messages

# ---------------------------------------------------------------- messages

MESSAGE_TIME = """CASE WHEN object_event_id % 31 = 0 THEN 'soon'
    WHEN object_event_id % 3 = 0 THEN concat(date_format(event_time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), 'Z')
    WHEN object_event_id % 3 = 1 THEN concat(date_format(event_time + INTERVAL 2 HOUR, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '+02:00')
    ELSE date_format(event_time, "yyyy-MM-dd HH:mm:ss.SSSSSS") END"""


def message_texts(spark, sf_dir) -> DataFrame:
    """Every event as the JSON text a feed would deliver; some incomplete, some no object at all."""
    e = v.obj_event(spark, sf_dir)
    i = F.col("object_event_id")
    body = F.to_json(
        F.struct(
            F.col("event_type").alias("eventType"),
            F.expr(MESSAGE_TIME).alias("eventTime"),
            F.concat(F.lit("id-"), i).alias("eventID"),
            F.struct(
                F.when(i % 50 != 0, F.col("compartment_name")).otherwise("").alias("compartmentName"),
                F.when(i % 4 != 0, F.col("resource_name")).alias("resourceName"),
                F.when(i % 6 == 0, "ns-data").alias("namespace"),
                F.struct(
                    "bucket_name",
                    F.when(i % 8 != 1, F.col("resource_name")).alias("objectName"),
                    F.when(i % 10 == 0, "ns-details").alias("namespace"),
                    F.col("version_id").alias("versionId"),
                    F.col("etag").alias("eTag"),
                ).alias("additionalDetails"),
            ).alias("data"),
        )
    )
    body = F.replace(body, F.lit('"bucket_name"'), F.lit('"bucketName"'))
    text = F.when(i % 53 == 0, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return e.select(i, F.col("received_at").alias("ingest_ts"), text.alias("event_message"))


def parsed(spark, sf_dir) -> DataFrame:
    return messages.parse_messages(message_texts(spark, sf_dir), F.col("ingest_ts"))


OBJECT = "object_event_id % 53 <> 0"
# what the message says, read straight from the table
MSG = f"""SELECT object_event_id, event_type,
    CASE WHEN object_event_id % 31 = 0 THEN received_at ELSE event_time END AS event_time,
    CASE WHEN object_event_id % 50 <> 0 THEN compartment_name END AS compartment_name, bucket_name, resource_name,
    {OBJECT} AND object_event_id % 50 <> 0 AS complete,
    CASE WHEN version_id <> '' THEN version_id WHEN etag <> '' THEN etag ELSE concat('id-', object_event_id) END AS object_version,
    CASE WHEN object_event_id % 10 = 0 THEN 'ns-details' WHEN object_event_id % 6 = 0 THEN 'ns-data' END AS namespace
    FROM obj_event"""


@query(
    "S1_read_events",
    v.sql(
        """SELECT CASE WHEN NOT (object_event_id % 53 <> 0) THEN 'Expected an Object Storage CloudEvent JSON object.'
             WHEN NOT complete THEN 'Event must contain data.compartmentName, bucketName, and resourceName/objectName.'
             END AS reject, count(*) AS messages FROM msg GROUP BY ALL""",
        "obj_event", msg=MSG,
    ),
)
def read_events(spark, sf_dir):
    folder = work_dir(spark, "messages")
    message_texts(spark, sf_dir).select("event_message").write.text(folder)
    events = messages.read_events(spark, folder)
    return events.groupBy("reject").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "P1_event_action",
    v.sql("SELECT object_event_id, event_type, action FROM acted", "acted"),
)
def event_action(spark, sf_dir):
    e = v.obj_event(spark, sf_dir)
    return e.select("object_event_id", "event_type", ev.event_action(F.col("event_type"), "UNKNOWN").alias("action"))


def _objects(spark, sf_dir):
    return parsed(spark, sf_dir).where(F.col("object_event_id") % 53 != 0)


@query("P2_event_time", v.sql(f"SELECT object_event_id, event_time FROM msg WHERE {OBJECT}", "obj_event", msg=MSG))
def event_time(spark, sf_dir):
    return _objects(spark, sf_dir).select("object_event_id", "event_time")


@query("P3_object_version", v.sql(f"SELECT object_event_id, object_version FROM msg WHERE {OBJECT}", "obj_event", msg=MSG))
def object_version(spark, sf_dir):
    return _objects(spark, sf_dir).select("object_event_id", "object_version")


@query(
    "P4_source_identity",
    v.sql(
        "SELECT object_event_id, compartment_name, bucket_name, resource_name FROM msg WHERE complete",
        "obj_event", msg=MSG,
    ),
)
def source_identity(spark, sf_dir):
    done = parsed(spark, sf_dir).where(F.col("reject").isNull())
    return done.select("object_event_id", "compartment_name", "bucket_name", "resource_name")


@query("P5_object_name", v.sql("SELECT object_event_id, resource_name AS object_name FROM msg WHERE complete", "obj_event", msg=MSG))
def object_name(spark, sf_dir):
    return parsed(spark, sf_dir).where(F.col("reject").isNull()).select("object_event_id", "object_name")


@query("P6_namespace", v.sql(f"SELECT object_event_id, namespace, coalesce(namespace, 'default') AS load_namespace FROM msg WHERE {OBJECT}", "obj_event", msg=MSG))
def namespace(spark, sf_dir):
    load = ev.namespace(F.col("namespace"), F.lit(None).cast("string"), F.lit("default"))
    return _objects(spark, sf_dir).select("object_event_id", "namespace", load.alias("load_namespace"))


# ---------------------------------------------------------------- names

@query(
    "P7_source_key",
    v.sql(
        """SELECT object_event_id, sha256(concat(mapping_id, chr(31), bucket_name, chr(31), resource_name)) AS source_key
           FROM routed WHERE mapping_id IS NOT NULL""",
        "routed",
    ),
)
def source_key(spark, sf_dir):
    key = ev.source_key(F.col("mapping_id"), F.col("bucket_name"), F.col("resource_name"))
    routed = v.routed(spark, sf_dir).where(F.col("mapping_id").isNotNull())
    return routed.select("object_event_id", key.alias("source_key"))


@query(
    "P8_glob_match",
    v.sql(
        """SELECT e.object_event_id, m.id AS mapping_id FROM obj_event e JOIN mapping m
           ON e.bucket_name = m.bucket_name AND e.resource_name GLOB m.resource_name_pattern""",
        "obj_event", "mapping",
    ),
)
def glob_match(spark, sf_dir):
    e = v.obj_event(spark, sf_dir)
    m = v.mapping(spark).select(
        "bucket_name", F.col("id").alias("mapping_id"), names.glob_regex(F.col("resource_name_pattern")).alias("regex")
    )
    hits = e.join(m, "bucket_name").where(names.glob_match(F.col("resource_name"), F.col("regex")))
    return hits.select("object_event_id", F.col("mapping_id").cast("int").alias("mapping_id"))


@query(
    "P9_prefix_and_folder",
    v.sql(
        r"""SELECT id, regexp_extract(resource_name_pattern, '^[^*?\[]*') AS prefix,
            CASE WHEN regexp_matches(regexp_extract(resource_name_pattern, '^(.*)/[^/]*$', 1), '[*?\[]') THEN ''
              ELSE regexp_extract(resource_name_pattern, '^(.*)/[^/]*$', 1) END AS folder FROM forms""",
        "forms",
    ),
)
def prefix_and_folder(spark, sf_dir):
    pattern = F.col("resource_name_pattern")
    return v.mapping_forms(spark, sf_dir).select(
        "id", names.static_prefix(pattern).alias("prefix"), names.default_folder(pattern).alias("folder")
    )


UPLOADS = [
    "id",
    "CASE id % 5 WHEN 0 THEN '/feed/../x' WHEN 1 THEN concat('/feed/', c_nationkey, '/') WHEN 2 THEN 'feed' "
    "WHEN 3 THEN 'a\\\\b' ELSE concat('feed/', c_nationkey) END AS folder",
    "concat('part ', id, CASE WHEN id % 4 = 0 THEN '.txt' ELSE '.CSV' END) AS filename",
    "concat('feed/', c_nationkey, '/*.CSV') AS pattern",
]


@query(
    "P10_object_path",
    r"""WITH u AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '/feed/../x' WHEN 1 THEN concat('/feed/', c_nationkey, '/')
          WHEN 2 THEN 'feed' WHEN 3 THEN 'a\b' ELSE concat('feed/', c_nationkey) END AS folder,
          concat('part_', c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '.txt' ELSE '.CSV' END) AS filename,
          concat('feed/', c_nationkey, '/*.CSV') AS pattern FROM customer),
        p AS (SELECT *, concat(trim(folder, '/'), '/', filename) AS path FROM u)
        SELECT id, path, concat_ws(',', CASE WHEN id % 5 IN (0, 3) THEN 'unsafe folder' END,
          CASE WHEN NOT lower(filename) LIKE '%.csv' THEN 'not a csv file' END,
          CASE WHEN NOT path GLOB pattern THEN 'outside the pattern' END) AS findings FROM p""",
)
def object_path(spark, sf_dir):
    u = v.table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey")).selectExpr(*UPLOADS)
    regex = names.glob_regex(F.col("pattern"))
    return u.select(
        "id",
        names.object_path(F.col("folder"), F.col("filename")).alias("path"),
        F.array_join(names.object_path_findings(F.col("folder"), F.col("filename"), regex), ",").alias("findings"),
    )


@query(
    "P11_sanitize_header",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
        n AS (SELECT doc_id, line, trim(regexp_replace(regexp_replace(lower(line), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') AS name FROM l)
        SELECT doc_id, CASE WHEN name = '' THEN 'column' WHEN regexp_matches(name, '^[0-9]') THEN concat('column_', name) ELSE name END AS header,
          count(*) AS lines FROM n GROUP BY ALL""",
)
def sanitize_header(spark, sf_dir):
    lines = v.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id", names.sanitize_header(F.col("line")).alias("header")).agg(
        F.count(F.lit(1)).alias("lines")
    )


@query(
    "P12_table_from_filename",
    r"""WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat(url, '/Sales_', page_id, '.CSV')
            WHEN 2 THEN concat('x/', page_id, ' report.final.csv') ELSE concat(url, '.tar.gz') END AS filename FROM pages),
        b AS (SELECT page_id, regexp_replace(filename, '^.*/', '') AS base FROM f),
        s AS (SELECT page_id, base, regexp_extract(base, '(?i)^([a-z][a-z0-9_]*)_[0-9]+\.csv$', 1) AS numbered,
              trim(lower(regexp_replace(regexp_replace(base, '\.[^.]*$', ''), '[^A-Za-z0-9_]+', '_', 'g')), '_') AS stem FROM b)
        SELECT page_id, CASE WHEN numbered <> '' THEN lower(numbered) WHEN stem = '' THEN 'table'
            WHEN regexp_matches(stem, '^[0-9]') THEN concat('table_', stem) ELSE stem END AS table_name FROM s""",
)
def table_from_filename(spark, sf_dir):
    f = v.table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat(url, '/Sales_', page_id, '.CSV') "
        "WHEN 2 THEN concat('x/', page_id, ' report.final.csv') ELSE concat(url, '.tar.gz') END AS filename",
    )
    return f.select("page_id", names.table_from_filename(F.col("filename")).alias("table_name"))


@query(
    "P13_identifier",
    """SELECT p_partkey, regexp_full_match(replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE ' ' END),
       '[A-Za-z][A-Za-z0-9_]{0,63}') AS valid FROM part""",
)
def identifier(spark, sf_dir):
    glue = F.when(F.col("p_partkey") % 2 == 0, "_").otherwise(" ")
    name = F.replace(F.col("p_name"), F.lit(" "), glue)
    return v.table(spark, sf_dir, "part").select("p_partkey", names.is_identifier(name).alias("valid"))


STAGES = """CASE WHEN o_orderkey % 5 = 0 THEN concat(repeat('t', 45), '_stage_', substr(md5(cast(o_orderkey AS varchar(20))), 1, 12))
    WHEN o_orderkey % 5 = 1 THEN concat('orders_stage_', substr(md5(cast(o_orderkey AS varchar(20))), 1, 12))
    WHEN o_orderkey % 5 = 2 THEN concat('orders_stage_', substr(md5(cast(o_orderkey AS varchar(20))), 1, 11))
    WHEN o_orderkey % 5 = 3 THEN concat('orders_stage_', substr(md5(cast(o_orderkey AS varchar(20))), 1, 11), 'g')
    ELSE concat('orders_old_stage_', substr(md5(cast(o_orderkey AS varchar(20))), 1, 12)) END"""
TABLE = "CASE WHEN o_orderkey % 5 = 0 THEN repeat('t', 60) ELSE 'orders' END"


@query(
    "P22_stage_name",
    f"""WITH s AS (SELECT o_orderkey, {TABLE} AS t, {STAGES} AS stage FROM orders)
        SELECT o_orderkey, starts_with(stage, concat(substr(t, 1, 45), '_stage_'))
          AND regexp_full_match(substr(stage, length(substr(t, 1, 45)) + 8), '[0-9a-fA-F]{{12}}') AS is_stage FROM s""",
)
def stage_name(spark, sf_dir):
    s = v.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{TABLE} AS t", f"{STAGES} AS stage")
    return s.select("o_orderkey", names.is_stage_name(F.col("t"), F.col("stage")).alias("is_stage"))


@query(
    "P23_feed_rule",
    v.sql(
        """SELECT object_event_id FROM obj_event WHERE action_known AND compartment_name = 'dept' AND bucket_name = 'bucket-0'
           AND resource_name GLOB 'feed/eu/*2*.csv'""",
        obj_event=v.SQL["obj_event"].replace("event_id AS object_event_id", "event_type IN ('signup', 'purchase', 'view', 'click') AS action_known, event_id AS object_event_id"),
    ),
)
def feed_rule(spark, sf_dir):
    rule = routing.feed_filter(v.obj_event(spark, sf_dir), "dept", "bucket-0", "feed/eu/*2*.csv")
    return rule.select("object_event_id")


_TYPES_JSON = "[" + ",".join(f'"{t}"' for t in routing.EVENT_TYPES) + "]"


@query(
    "P23_feed_condition_json",
    v.sql(
        f"""SELECT id, concat('{{"eventType":{_TYPES_JSON},"data":{{"compartmentId":"', compartment_name,
            '","resourceName":"', resource_name_pattern, '","additionalDetails":{{"bucketName":"', bucket_name, '"}}}}}}') AS condition
            FROM customer_mapping""",
        "customer_mapping",
    ),
)
def feed_condition_json(spark, sf_dir):
    m = v.customer_mappings(spark, sf_dir)
    return m.select("id", routing.feed_condition_json(m).alias("condition"))


# ---------------------------------------------------------------- modes, times, messages

@query(
    "P14_mode_snapshot",
    v.sql(
        """SELECT t.id, coalesce(t.invocation_mode, r.invocation_mode, 'UNKNOWN') AS invocation_mode
           FROM tx t LEFT JOIN raw_event r ON r.id = t.object_event_id""",
        "tx", "raw_event",
    ),
)
def mode_snapshot(spark, sf_dir):
    from slicelake.operators import audit

    return audit.with_timing(v.tx_log(spark, sf_dir), v.raw_event(spark, sf_dir)).select("id", "invocation_mode")


@query(
    "P15_new_event_mode",
    v.sql(
        """SELECT object_event_id, CASE WHEN m IN ('SYNC', 'DETACHED') THEN m END AS invocation_mode FROM
           (SELECT object_event_id, upper(CASE WHEN object_event_id % 2 = 0 THEN
              CASE object_event_id % 3 WHEN 0 THEN 'DETACHED' WHEN 1 THEN 'detached' ELSE 'later' END
              ELSE coalesce(mapping_mode, 'SYNC') END) AS m FROM routed)""",
        "routed",
    ),
)
def new_event_mode(spark, sf_dir):
    i = F.col("object_event_id")
    carried = F.when(i % 3 == 0, F.lit(None).cast("string")).when(i % 3 == 1, "detached").otherwise("later")
    mode = ev.new_event_mode(carried, F.col("mapping_mode"), i % 2 == 0)
    return v.routed(spark, sf_dir).select(i, mode.alias("invocation_mode"))


@query(
    "P16_raw_lifecycle",
    v.sql("SELECT id, CASE WHEN completed_at IS NULL THEN 'RECEIVED' ELSE 'COMPLETED' END AS lifecycle FROM raw_event", "raw_event"),
)
def raw_lifecycle(spark, sf_dir):
    return v.raw_event(spark, sf_dir).select("id", ev.raw_lifecycle(F.col("completed_at")).alias("lifecycle"))


@query(
    "P17_duration_ms",
    v.sql(
        "SELECT id, CAST(date_diff('microsecond', event_time, completed_at) / 1000.0 AS DECIMAL(16,3)) AS duration_ms FROM raw_event",
        "raw_event",
    ),
)
def duration_ms(spark, sf_dir):
    return v.raw_event(spark, sf_dir).select(
        "id", ev.duration_ms(F.col("event_time"), F.col("completed_at")).alias("duration_ms")
    )


@query(
    "P18_duration_seconds",
    v.sql("SELECT id, CAST(round(duration_ms / 1000.0, 3) AS DECIMAL(16,3)) AS duration_seconds FROM raw_event", "raw_event"),
)
def duration_seconds(spark, sf_dir):
    return v.raw_event(spark, sf_dir).select("id", ev.duration_seconds(F.col("duration_ms")).alias("duration_seconds"))


LOADED = """SELECT r.*, b.file_bytes, b.rows FROM raw_event r JOIN
    (SELECT l_orderkey AS id, sum(CAST(l_quantity AS BIGINT)) * 100000 AS file_bytes, count(*) AS rows
     FROM lineitem GROUP BY l_orderkey) b ON b.id = r.id"""


def loaded(spark, sf_dir) -> DataFrame:
    files = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        (F.sum(F.col("l_quantity").cast("bigint")) * 100000).alias("file_bytes"), F.count(F.lit(1)).alias("rows")
    )
    return v.raw_event(spark, sf_dir).join(files, "id")


def _dec(expression: str, name: str, digits: int = 6) -> str:
    return f"CAST(round({expression}, {digits}) AS DECIMAL(28,{digits})) AS {name}"


@query(
    "P19_load_rates",
    v.sql(
        "SELECT id, "
        + ", ".join(
            [
                _dec("date_diff('microsecond', event_time, received_at) / 1e6", "delivery_latency_seconds"),
                _dec("date_diff('microsecond', event_time, completed_at) / 1e6", "end_to_end_seconds"),
                _dec("file_bytes / 1048576.0::DOUBLE", "file_mib"),
                _dec("file_bytes / 1048576.0::DOUBLE / nullif(duration_ms::DOUBLE / 1000, 0)", "throughput_mib_per_second"),
                _dec("rows / nullif(duration_ms::DOUBLE / 1000, 0)", "rows_per_second"),
                _dec("nullif(duration_ms::DOUBLE / 1000, 0) / rows * 100", "seconds_per_100_rows"),
            ]
        )
        + " FROM loaded",
        "raw_event", loaded=LOADED,
    ),
)
def load_rates(spark, sf_dir):
    rates = metrics.load_rates(loaded(spark, sf_dir))
    return rates.select(
        "id",
        *[
            metrics.rate_column(c)
            for c in (
                "delivery_latency_seconds", "end_to_end_seconds", "file_mib", "throughput_mib_per_second",
                "rows_per_second", "seconds_per_100_rows",
            )
        ],
    )


@query(
    "P20_mode_filter",
    v.sql("SELECT id, invocation_mode FROM tx WHERE invocation_mode = 'DETACHED'", "tx"),
)
def mode_filter(spark, sf_dir):
    return paging.mode_filter(v.tx_log(spark, sf_dir), "detached").select("id", "invocation_mode")


@query(
    "P21_last_minutes",
    v.sql("SELECT id, created_at FROM tx WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 4320 MINUTE", "tx"),
)
def last_minutes(spark, sf_dir):
    return paging.since(v.tx_log(spark, sf_dir), v.AS_OF, 4320).select("id", "created_at")


@query(
    "P24_load_message",
    """SELECT l_orderkey, concat('Loaded ', count(*), ' row(s) by partition exchange.') AS message, count(*) AS parsed_rows
       FROM lineitem GROUP BY l_orderkey""",
)
def load_message(spark, sf_dir):
    counted = v.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").count()
    message = ev.load_message(F.col("count"))
    return counted.select("l_orderkey", message.alias("message"), ev.loaded_rows(message).alias("parsed_rows"))


ERRNO = "CASE event_id % 9 WHEN 0 THEN 1062 WHEN 1 THEN 1048 WHEN 2 THEN 1263 WHEN 3 THEN 1366 WHEN 4 THEN 1367 WHEN 5 THEN 1148 WHEN 6 THEN 3948 WHEN 7 THEN 1045 END"


@query(
    "P26_classify_error",
    f"""SELECT kind, count(*) AS errors FROM (SELECT CASE WHEN e = 1062 THEN 'duplicate key'
        WHEN e IN (1048, 1263, 1366, 1367) THEN 'missing or incompatible value' WHEN e IN (1148, 3948) THEN 'feature disabled'
        ELSE 'other' END AS kind FROM (SELECT {ERRNO} AS e FROM events)) GROUP BY kind""",
)
def classify_error(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").select(F.expr(ERRNO).alias("errno"))
    return e.groupBy(ev.classify_error(F.col("errno")).alias("kind")).agg(F.count(F.lit(1)).alias("errors"))
