"""Lifecycle event messages (S1, P1-P6) and invocation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slicelake import schemas
from slicelake.functions import events as ev


def read_messages(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """One message per line, as text."""
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).select(F.col("value").alias("event_message"))


def parse_messages(df: DataFrame, ingest_ts: Column) -> DataFrame:
    """Messages as event columns; ``reject`` says why a message cannot be processed.

    The text must be a JSON object; the source must be complete.
    """
    parsed = F.from_json(
        "event_message", f"{schemas.MESSAGE}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    m = F.col("_m")
    data, details = m["data"], m["data"]["additionalDetails"]
    is_object = F.coalesce(F.col("event_message").rlike(r"^\s*\{"), F.lit(False)) & m["_bad"].isNull()
    identity = ev.source_identity(data)
    return (
        df.withColumn("_m", parsed)
        .withColumn("_object", is_object)
        .withColumn("_id", F.when(F.col("_object"), identity))
        .select(
            *df.columns,
            m["eventID"].alias("event_id"),
            F.coalesce(ev.non_empty(m["eventType"]), F.lit("unknown")).alias("event_type"),
            ev.event_action(m["eventType"], "UNKNOWN").alias("action"),
            ev.event_time(m["eventTime"], ingest_ts).alias("event_time"),
            F.col("_id.compartment_name").alias("compartment_name"),
            F.col("_id.bucket_name").alias("bucket_name"),
            F.col("_id.resource_name").alias("resource_name"),
            ev.object_name(details["objectName"], F.col("_id.resource_name")).alias("object_name"),
            ev.namespace(details["namespace"], data["namespace"]).alias("namespace"),
            ev.object_version(details["versionId"], details["eTag"], m["eventID"]).alias("object_version"),
            F.when(~F.col("_object"), "Expected an Object Storage CloudEvent JSON object.")
            .when(
                F.col("_id").isNull(),
                "Event must contain data.compartmentName, bucketName, and resourceName/objectName.",
            )
            .alias("reject"),
        )
    )


def read_events(
    spark: SparkSession, path: str, streaming: bool = False, ingest_ts: Column | None = None, max_files: int | None = None
) -> DataFrame:
    ingest = F.localtimestamp() if ingest_ts is None else ingest_ts
    return parse_messages(read_messages(spark, path, streaming, max_files), ingest)


def read_invocation_log(spark: SparkSession, path: str, as_of: str | None = None, minutes: int | None = None) -> DataFrame:
    """Log records (``request_id``, ``time``, ``message``), optionally of the last minutes before ``as_of``."""
    schema = (
        "id string, time string, data struct<opcRequestId:string, requestId:string, message:string>"
    )
    log = spark.read.schema(schema).json(path).select(
        F.coalesce("data.opcRequestId", "data.requestId", "id").alias("request_id"),
        F.coalesce("time", F.lit("")).alias("time"),
        F.coalesce("data.message", F.lit("")).alias("message"),
    )
    if minutes is None:
        return log
    at = ev.iso_timestamp(F.col("time"))
    end = F.lit(as_of).cast("timestamp_ntz")
    return log.where((at >= end - F.expr(f"INTERVAL '{int(minutes)}' MINUTE")) & (at <= end))
