"""Queries that go through files: CSV readers, row numbers, imports, the lake, logs.

Each writes data derived from the given tables to a fresh shared folder and reads it back
through the library.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from slicelake.operators import metrics
from slicelake.operators.lifecycle import TARGET
from slicelake.plans import views as v
from slicelake.plans.aggregates import LOG, invocation_log
from slicelake.plans.joins import VISIBLE
from slicelake.plans.registry import query
from slicelake.plans.scalars import LOADED, _dec, loaded
from slicelake.session import work_dir
from slicelake.sinks import export, imports
from slicelake.sinks.lake import Lake
from slicelake.sources import csvfiles, messages

PLAIN = {  # what a CSV must keep: blanks, quotes, line breaks
    "header": True, "quote": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, folder: str, **options) -> list[str]:
    df.write.options(**{**PLAIN, "escape": '"', **options}).csv(folder)
    return df.sparkSession.read.text(folder).inputFiles()


@query(
    "S2_object_csv",
    r"""SELECT doc_id, lang, CAST(length(t) AS BIGINT) AS length, md5(t) AS digest FROM
        (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)""",
)
def object_csv(spark, sf_dir):
    """Whole documents, with their quotes, commas and line breaks, under upper-case headers in another order."""
    docs = v.table(spark, sf_dir, "documents").select(F.col("lang").alias("LANG"), F.col("text").alias("Text"), F.col("doc_id").alias("DOC_ID"))
    paths = write_csv(docs.repartition(8, "DOC_ID"), work_dir(spark, "objects"))
    rows = csvfiles.read_object_csv(spark, paths, ["doc_id", "lang", "text"])
    return rows.select("doc_id", "lang", F.length("text").cast("bigint").alias("length"), F.md5("text").alias("digest"))


def _import_file(spark, sf_dir) -> tuple[str, list[str]]:
    lines = v.object_rows(spark, sf_dir).select(
        F.col("object_event_id").alias("Order Key"), F.col("l_partkey").alias("Part-Key"), F.col("quantity").alias("QUANTITY"),
        F.when(F.col("amount") > 50000, F.col("amount")).alias("Amount"),
        F.concat(F.col("l_returnflag"), F.lit(';"x'), ).alias("flag"),
    )
    folder = work_dir(spark, "import")
    write_csv(lines, folder, sep=";", escape="\\", emptyValue="")
    return folder, ["order_key", "part_key", "quantity", "amount", "flag"]


@query(
    "S3_import_csv",
    v.sql(
        """SELECT concat(l_returnflag, ';"x') AS flag, count(*) AS rows, count(*) FILTER (amount > 50000) AS amounts,
           CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(CASE WHEN amount > 50000 THEN amount END) AS DECIMAL(28,2)) AS amount
           FROM object_rows GROUP BY ALL""",
        "object_rows",
    ),
)
def import_csv(spark, sf_dir):
    folder, header = _import_file(spark, sf_dir)
    rows = csvfiles.read_import_csv(spark, folder, header, ";")
    return rows.groupBy("flag").agg(
        F.count(F.lit(1)).alias("rows"), F.count("amount").alias("amounts"),
        F.sum(F.col("quantity").cast("bigint")).alias("quantity"),
        F.sum(F.col("amount").cast("decimal(14,2)")).cast("decimal(28,2)").alias("amount"),
    )


def _ordered_files(spark, sf_dir) -> tuple[list[str], list[str]]:
    """Orders cut into files by key range, in key order inside each file."""
    orders = v.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    paths = write_csv(orders.repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey"), work_dir(spark, "rows"))
    return paths, ["o_orderkey", "o_custkey", "o_orderpriority"]


@query("W5_row_numbers", "SELECT count(*) AS rows, count(*) AS in_order, CAST(2 AS BIGINT) AS first FROM orders")
def row_numbers(spark, sf_dir):
    paths, columns = _ordered_files(spark, sf_dir)
    rows = csvfiles.with_row_numbers(csvfiles.read_object_csv(spark, paths, columns))
    # keys ascend inside a file, so numbers must be consecutive in key order
    position = F.row_number().over(Window.partitionBy("file").orderBy(F.col("o_orderkey").cast("bigint"))) + 1
    return rows.withColumn("_p", position).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_p") == F.col("row_no")).alias("in_order"),
        F.min("row_no").alias("first"),
    )


@query("W6_row_id", "SELECT count(*) AS rows, count(*) AS distinct_ids, CAST(min(1) AS BIGINT) AS lowest, count(*) AS highest FROM orders")
def row_id(spark, sf_dir):
    paths, columns = _ordered_files(spark, sf_dir)
    rows = csvfiles.with_row_numbers(csvfiles.read_object_csv(spark, paths, columns))
    return csvfiles.with_row_id(rows).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("ROW_ID").alias("distinct_ids"),
        F.min("ROW_ID").alias("lowest"), F.max("ROW_ID").alias("highest"),
    )


SPEC_TYPES = {
    "order_key": "BIGINT", "part_key": "INT", "quantity": "BIGINT", "amount": "DECIMAL(38, 10)", "flag": "VARCHAR(8)",
}


@query(
    "K10_import_rows",
    v.sql(
        """SELECT count(*) AS rows, count(DISTINCT object_event_id) AS orders, CAST(sum(l_partkey) AS BIGINT) AS part_keys,
           CAST(sum(CASE WHEN amount > 50000 THEN amount END) AS DECIMAL(38,2)) AS amount, CAST(0 AS BIGINT) AS batch_num,
           count(*) AS highest_id FROM object_rows""",
        "object_rows",
    ),
)
def import_rows(spark, sf_dir):
    folder, header = _import_file(spark, sf_dir)
    spec = imports.ImportSpec("mart", "imported", SPEC_TYPES, add_row_id=True, partition_by_batch=True, delimiter=";")
    rows = csvfiles.with_row_numbers(csvfiles.read_import_csv(spark, folder, header, ";"))
    return imports.import_rows(rows, spec).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("order_key").alias("orders"), F.sum("part_key").alias("part_keys"),
        F.sum("amount").cast("decimal(38,2)").alias("amount"), F.max("batch_num").alias("batch_num"),
        F.max("ROW_ID").alias("highest_id"),
    )


@query(
    "K9_create_target",
    v.sql("SELECT count(*) AS rows, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(0 AS BIGINT) AS batch_num FROM object_rows", "object_rows"),
)
def create_target(spark, sf_dir):
    """Create the reviewed target in a database of its own, import the file, read the table."""
    folder, _ = _import_file(spark, sf_dir)
    database = f"import_{uuid.uuid4().hex[:10]}"
    spec = imports.ImportSpec(
        database, "order_rows", SPEC_TYPES, nullable={"amount"}, partition_by_batch=True, delimiter=";"
    )
    spark.sql(f"CREATE DATABASE {database} LOCATION '{work_dir(spark, 'warehouse')}'")
    imports.import_csv(spark, folder, spec)
    return spark.table(f"{database}.order_rows").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("quantity"), F.max("batch_num").alias("batch_num")
    )


@query("S5_list_objects", """SELECT concat('kind=', p_type) AS folder, TRUE AS found FROM part WHERE p_type GLOB '*[AE]L*' GROUP BY p_type""")
def list_objects(spark, sf_dir):
    folder = work_dir(spark, "listing")
    parts = v.table(spark, sf_dir, "part").withColumnsRenamed({"p_type": "kind"})
    parts.select("kind", "p_partkey").write.partitionBy("kind").options(header=True).csv(f"{folder}/feed")
    found = csvfiles.list_objects(spark, folder, "feed/kind=*[AE]L*/*.csv", limit=100_000)
    return found.groupBy(F.regexp_extract("name", r"^feed/(kind=[^/]*)/", 1).alias("folder")).agg(
        (F.count(F.lit(1)) > 0).alias("found")
    )


@query(
    "S7_invocation_log",
    v.sql("SELECT request_id, time, message FROM log WHERE time >= '2024-01-28T00:00:00' AND time <= '2024-01-31T00:00:00.000000Z'", log=LOG),
)
def invocation_log_scan(spark, sf_dir):
    log = invocation_log(spark, sf_dir)
    folder = work_dir(spark, "log")
    log.select(
        F.concat(F.lit("id-"), "request_id").alias("id"), "time",
        F.struct(
            F.when(F.col("message").startswith("c"), F.lit(None)).otherwise(F.col("request_id")).alias("opcRequestId"),
            F.col("request_id").alias("requestId"), "message",
        ).alias("data"),
    ).write.json(folder)
    return messages.read_invocation_log(spark, folder, v.AS_OF, 4320)


@query(
    "K11_metrics_lines",
    v.sql(f"SELECT id, rows, {_dec('file_bytes / 1048576.0::DOUBLE', 'file_mib')} FROM loaded", "raw_event", loaded=LOADED),
)
def metrics_lines(spark, sf_dir):
    folder = work_dir(spark, "metrics")
    export.write_metrics(metrics.load_rates(loaded(spark, sf_dir)).select("id", "rows", "file_mib"), folder)
    lines = spark.read.schema("id bigint, rows bigint, file_mib double").json(folder)
    return lines.select("id", "rows", metrics.rate_column("file_mib"))


# ---------------------------------------------------------------- the lake

CONTENT = T.StructType(
    [
        T.StructField("l_linenumber", T.IntegerType()), T.StructField("l_partkey", T.LongType()),
        T.StructField("quantity", T.LongType()), T.StructField("amount", T.DecimalType(14, 2)),
    ]
)
TABLES = ("all_feed", "eu_feed", "us_feed")


def staged_lake(spark, sf_dir) -> Lake:
    """Every successful load staged in one write per target, nothing published."""
    lake = Lake(spark, work_dir(spark, "lake"))
    # several targets are written from it, so it is computed once
    rows = v.contents(spark, sf_dir).select(*TARGET, *CONTENT.names, "batch_num", "attempt")
    folder = f"{lake.root}/contents"
    rows.write.partitionBy("target_table").parquet(folder)
    for table in TABLES:
        mine = spark.read.parquet(folder).where(F.col("target_table") == table)
        lake.stage(mine.select(*CONTENT.names, "batch_num", "attempt"), "mart", table, 0)
    return lake


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@query(
    "K1_stage_write",
    v.sql(
        """SELECT target_table, CAST(batch_num AS BIGINT) AS batch_num, attempt, count(*) AS rows, CAST(0 AS BIGINT) AS visible
           FROM contents GROUP BY ALL""",
        "contents",
    ),
)
def stage_write(spark, sf_dir):
    """Staged rows per attempt, and that none of them is visible yet."""
    lake = staged_lake(spark, sf_dir)
    staged = _union([lake.attempts("mart", t) for t in TABLES])
    seen = _union([lake.visible("mart", t, CONTENT).select(F.lit(t).alias("target_table")) for t in TABLES])
    shown = seen.groupBy("target_table").agg(F.count(F.lit(1)).alias("visible"))
    return staged.join(shown, "target_table", "left").select(
        "target_table", "batch_num", "attempt", "rows", F.coalesce("visible", F.lit(0)).cast("bigint").alias("visible")
    )


@query(
    "K3_publish",
    v.sql(
        f"""SELECT target_table, count(*) AS rows, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(amount) AS DECIMAL(28,2)) AS amount
            FROM ({VISIBLE}) WHERE batch_num % 5 <> 0 GROUP BY target_table""",
        "contents", "registry",
    ),
)
def publish(spark, sf_dir):
    """Publish all slices, then in a second commit empty every fifth one; read what is visible."""
    lake = staged_lake(spark, sf_dir)
    registry = v.registry(spark, sf_dir).withColumn(
        "visible_load", F.when(F.col("visible_attempt").isNotNull(), F.lit(0).cast("bigint"))
    )
    lake.commit(registry, ("load", 0))
    gone = lake.registry().where(F.col("batch_num") % 5 == 0)
    lake.commit(
        gone.withColumns(
            {
                "lifecycle_state": F.lit("DELETED"),
                "visible_attempt": F.lit(None).cast("bigint"),
                "visible_load": F.lit(None).cast("bigint"),
            }
        ),
        ("load", 1),
    )
    frames = [lake.visible("mart", t, CONTENT).withColumn("target_table", F.lit(t)) for t in TABLES]
    return _union(frames).groupBy("target_table").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("quantity"),
        F.sum("amount").cast("decimal(28,2)").alias("amount"),
    )
