"""Queries that run a stream to its end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from slicelake.operators.lifecycle import SOURCE
from slicelake.plans import views as v
from slicelake.plans.registry import query
from slicelake.paths import filesystem
from slicelake.session import ROCKSDB, work_dir
from slicelake.sinks.lake import Lake
from slicelake.streaming.ingest import Ingest, Target
from slicelake.streaming.state import lifecycle_stream

COLUMNS = {"l_linenumber": "int", "l_partkey": "bigint", "quantity": "bigint", "amount": "decimal(14,2)", "l_returnflag": "string"}
TARGETS = [Target("mart", t, COLUMNS) for t in ("all_feed", "eu_feed", "us_feed", "eu_copy")]


def write_objects(rows: DataFrame, path: str, columns: list[str]) -> int:
    """One CSV object per value of the ``path`` column; returns how many.

    Rows are grouped by sorting inside each task and streamed out batch by batch.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, stream = None, None
        for batch in batches:
            done = []
            for name, part in batch.groupby("_path", sort=False):
                if name != current:
                    if stream is not None:
                        stream.close()
                    system, inner = filesystem(name)
                    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    current, stream = name, system.open_output_stream(inner)
                    stream.write((",".join(columns) + "\n").encode())
                    done.append(name)
                stream.write(part[columns].to_csv(header=False, index=False).encode())
            if done:      # none if an object goes on through the whole batch; Spark takes no frame without rows
                yield pd.DataFrame({"path": done})
        if stream is not None:
            stream.close()

    grouped = rows.select(F.col(path).alias("_path"), *columns).repartition("_path").sortWithinPartitions("_path")
    return grouped.mapInPandas(write, "path string").count()


def object_texts(spark, sf_dir, root: str) -> DataFrame:
    """The rows of all events of an object, as its current contents."""
    events = v.obj_event(spark, sf_dir).select(
        "object_event_id", F.concat_ws("/", F.lit(root), "bucket_name", "resource_name").alias("path")
    )
    text = [F.col(c).cast("string").alias(c) for c in COLUMNS]
    return v.object_rows(spark, sf_dir).join(events, "object_event_id").select("path", *text)


def event_messages(spark, sf_dir) -> DataFrame:
    return v.obj_event(spark, sf_dir).select(
        F.to_json(
            F.struct(
                F.col("event_type").alias("eventType"),
                F.concat(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("eventTime"),
                F.concat(F.lit("id-"), "object_event_id").alias("eventID"),
                F.struct(
                    F.col("compartment_name").alias("compartmentName"), F.col("resource_name").alias("resourceName"),
                    F.struct(
                        F.col("bucket_name").alias("bucketName"), F.col("version_id").alias("versionId"),
                        F.col("etag").alias("eTag"),
                    ).alias("additionalDetails"),
                ).alias("data"),
            )
        ).alias("value")
    )


INGESTED = """SELECT s.target_table, s.bucket_name, s.resource_name, s.state AS lifecycle_state,
      CASE WHEN s.visible_seq IS NOT NULL THEN coalesce(c.rows, 0) ELSE 0 END AS rows,
      CAST(CASE WHEN s.visible_seq IS NOT NULL THEN coalesce(c.quantity, 0) ELSE 0 END AS BIGINT) AS quantity
    FROM (SELECT * FROM fold WHERE state <> 'ABSENT' QUALIFY row_number() OVER (PARTITION BY mapping_id, bucket_name, resource_name ORDER BY seq DESC) = 1) s
    LEFT JOIN (SELECT e.bucket_name, e.resource_name, count(*) AS rows, sum(r.quantity) AS quantity
               FROM object_rows r JOIN obj_event e USING (object_event_id) GROUP BY ALL) c
      ON c.bucket_name = s.bucket_name AND c.resource_name = s.resource_name"""


@query(
    "X1_ingest_stream",
    # every object is readable, so every accepted load works
    v.sql(INGESTED, "fold", "object_rows").replace("load_ok AS ok FROM routed", "true AS ok FROM routed"),
)
def ingest_stream(spark, sf_dir):
    """Messages and objects written out, worked off by both streams; slices and what they show."""
    root = work_dir(spark, "ingest")
    write_objects(object_texts(spark, sf_dir, f"{root}/objects"), "path", list(COLUMNS))
    event_messages(spark, sf_dir).write.text(f"{root}/events")
    ingest = Ingest(spark, Lake(spark, f"{root}/lake"), v.mapping(spark), TARGETS, f"{root}/objects")
    ingest.run(f"{root}/events", f"{root}/checkpoint")
    shown = None
    for target in TARGETS:
        rows = ingest.lake.visible(target.database, target.table, target.schema, keep_slice=True)
        part = rows.select(F.lit(target.table).alias("target_table"), "batch_num", "quantity")
        shown = part if shown is None else shown.unionByName(part)
    sums = shown.groupBy("target_table", "batch_num").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("quantity")
    )
    return ingest.lake.registry().join(sums, ["target_table", "batch_num"], "left").select(
        "target_table", "bucket_name", "resource_name", "lifecycle_state",
        F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce("quantity", F.lit(0)).cast("bigint").alias("quantity"),
    )


@query(
    "X3_keyed_state",
    v.sql("SELECT object_event_id AS seq, action, prev_state, state, success, visible_seq FROM fold", "fold"),
)
def keyed_state(spark, sf_dir):
    """The lifecycle as a stateful stream over the same events."""
    root = work_dir(spark, "state")
    columns = [*SOURCE, "seq", "action", "ok"]
    events = v.lifecycle_events(spark, sf_dir).select(*columns)
    events.write.parquet(f"{root}/events")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    try:
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/events")
        (
            lifecycle_stream(stream)
            .writeStream.format("parquet")
            .option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{root}/out").select("seq", "action", "prev_state", "state", "success", "visible_seq")
