"""Expressions that normalise one lifecycle event."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Lower-case suffix of an event type -> action.
ACTIONS = {"createobject": "CREATE", "updateobject": "UPDATE", "deleteobject": "DELETE"}
MODES = ("SYNC", "DETACHED")

# Extended ISO-8601: a date, optionally a time with fraction and zone.
ISO_DATETIME = (
    r"^\d{4}-\d{2}-\d{2}([T ]([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d{1,9})?)?)?"
    r"(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
_OFFSET = r"[T ].*(Z|[+-]\d{2}(:?\d{2})?)$"


def non_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def event_action(event_type: Column, default: str | None = None) -> Column:
    """CREATE / UPDATE / DELETE from the type's suffix, any letter case; else ``default``."""
    folded = F.lower(F.coalesce(event_type, F.lit("")))
    result = None
    for suffix, action in ACTIONS.items():
        test = folded.endswith(suffix)
        result = F.when(test, action) if result is None else result.when(test, action)
    return result.otherwise(F.lit(default).cast("string"))


def iso_timestamp(raw: Column) -> Column:
    """ISO-8601 text as a UTC wall-clock timestamp, NULL if it is none.

    Text without an offset is taken as UTC.
    """
    shaped = F.when(raw.rlike(ISO_DATETIME), F.replace(raw, F.lit(","), F.lit(".")))
    zoned = F.when(shaped.rlike(_OFFSET), F.regexp_replace(shaped, r"([+-]\d{2})(\d{2})$", "$1:$2"))
    instant = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), zoned.try_cast("timestamp").cast("timestamp_ntz")
    )
    # hour-only times are legal ISO but not castable
    local = F.when(zoned.isNull(), F.regexp_replace(shaped, r"^(.{10}[T ]\d{2})$", "$1:00"))
    return F.coalesce(instant, local.try_cast("timestamp_ntz"))


def event_time(raw: Column, ingest_ts: Column) -> Column:
    """The event's own time in UTC, or the ingest time where it cannot be read."""
    return F.coalesce(iso_timestamp(raw), ingest_ts)


def object_version(version_id: Column, etag: Column, event_id: Column) -> Column:
    return F.coalesce(non_empty(version_id), non_empty(etag), non_empty(event_id), F.lit(""))


def source_identity(data: Column) -> Column:
    """struct(compartment_name, bucket_name, resource_name); NULL if a part is missing."""
    details = data["additionalDetails"]
    compartment = non_empty(data["compartmentName"])
    bucket = non_empty(details["bucketName"])
    resource = F.coalesce(non_empty(data["resourceName"]), non_empty(details["objectName"]))
    return F.when(
        compartment.isNotNull() & bucket.isNotNull() & resource.isNotNull(),
        F.struct(
            compartment.alias("compartment_name"),
            bucket.alias("bucket_name"),
            resource.alias("resource_name"),
        ),
    )


def object_name(details_object_name: Column, resource_name: Column) -> Column:
    return F.coalesce(non_empty(details_object_name), resource_name)


def namespace(details_namespace: Column, data_namespace: Column, default: Column | None = None) -> Column:
    """For the event log the event's own value; for loads also the configured default."""
    options = [non_empty(details_namespace), non_empty(data_namespace)]
    return F.coalesce(*options, *([] if default is None else [non_empty(default)]))


def source_key(mapping_id: Column, bucket: Column, resource: Column) -> Column:
    """Hex sha-256 of the three parts joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", mapping_id.cast("string"), bucket, resource), 256)


def mode_snapshot(tx_mode: Column, event_mode: Column) -> Column:
    return F.coalesce(tx_mode, event_mode, F.lit("UNKNOWN"))


def new_event_mode(carried: Column, mapping_mode: Column, detached_worker: Column) -> Column:
    """Mode recorded for a new event; NULL where the mode is outside the domain."""
    mode = F.when(
        detached_worker, F.upper(F.coalesce(non_empty(carried), F.lit("DETACHED")))
    ).otherwise(F.upper(F.coalesce(non_empty(mapping_mode), F.lit("SYNC"))))
    return F.when(mode.isin(*MODES), mode)


def raw_lifecycle(completed_at: Column) -> Column:
    return F.when(completed_at.isNotNull(), "COMPLETED").otherwise("RECEIVED")


def duration_ms(received_at: Column, completed_at: Column) -> Column:
    micros = F.timestamp_diff("MICROSECOND", received_at, completed_at)
    return (micros.cast("decimal(20,0)") / F.lit(1000).cast("decimal(5,0)")).cast("decimal(16,3)")


def duration_seconds(ms: Column) -> Column:
    return F.round(ms.cast("decimal(16,3)") / F.lit(1000).cast("decimal(5,0)"), 3).cast("decimal(16,3)")


def load_message(rows: Column) -> Column:
    return F.concat(F.lit("Loaded "), rows.cast("string"), F.lit(" row(s) by partition exchange."))


def loaded_rows(message: Column) -> Column:
    """The row count back out of a success message, NULL for other messages."""
    return non_empty(F.regexp_extract(message, r"^Loaded (\d+) row\(s\)", 1)).cast("bigint")


def error_code(error_class: Column) -> Column:
    """Missing-target errors have their own code; others use the class name, at most 64 characters."""
    return F.when(error_class == "TargetTableError", "TARGET_TABLE_NOT_FOUND").otherwise(
        F.substring(F.upper(error_class), 1, 64)
    )


def classify_error(errno: Column) -> Column:
    """Import failures grouped by the database's error number (fixed values)."""
    return (
        F.when(errno == 1062, "duplicate key")
        .when(errno.isin(1048, 1263, 1366, 1367), "missing or incompatible value")
        .when(errno.isin(1148, 3948), "feature disabled")
        .otherwise("other")
    )
