"""Fixed schemas of the event message, the control tables and the audit logs."""

from __future__ import annotations

from pyspark.sql import types as T

# Message fields that are read, as a from_json schema.
MESSAGE = (
    "eventType string, eventTime string, eventID string, "
    "data struct<compartmentName:string, resourceName:string, namespace:string, "
    "additionalDetails:struct<bucketName:string, objectName:string, namespace:string,"
    " versionId:string, eTag:string>>"
)

_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "decimal(16,3)": T.DecimalType(16, 3),
}


def schema_of(columns: str) -> T.StructType:
    """``name type, name type`` as a schema; unlike fromDDL it needs no session."""
    pairs = [c.strip().rsplit(" ", 1) for c in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CONTROL = {
    "object_event": schema_of(
        "id bigint, event_date timestamp_ntz, event_type string, event_message string, "
        "bucket_name string, compartment_name string, resource_name string, namespace string, "
        "event_time timestamp_ntz, received_at timestamp_ntz, completed_at timestamp_ntz, "
        "duration_ms decimal(16,3), invocation_mode string"
    ),
    "object_storage_mappings": schema_of(
        "id bigint, compartment_name string, bucket_name string, resource_name_pattern string, "
        "target_database string, target_table string, invocation_mode string, worker_threads int, "
        "event_rule_id string, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "source_object_batches": schema_of(
        "mapping_id bigint, bucket_name string, resource_name string, target_database string, "
        "target_table string, batch_num bigint, source_key string, object_version string, "
        "lifecycle_state string, visible_attempt bigint, last_seq bigint, updated_at timestamp_ntz"
    ),
    "event_tx_log": schema_of(
        "id bigint, object_event_id bigint, mapping_id bigint, target_database string, "
        "target_table string, batch_num bigint, event_action string, event_status string, "
        "bucket_name string, resource_name string, object_version string, invocation_mode string, "
        "message string, created_at timestamp_ntz"
    ),
    "event_errors": schema_of(
        "id bigint, event_log_id bigint, mapping_id bigint, target_database string, "
        "target_table string, event_action string, error_code string, error_message string, "
        "created_at timestamp_ntz"
    ),
}

# Defaults given to columns that an older table lacks.
UPGRADE_DEFAULTS = {
    "object_storage_mappings": {"invocation_mode": "SYNC", "worker_threads": 4},
    "object_event": {},
    "event_tx_log": {},
}

# The types an import may declare besides VARCHAR(1..65535), and their Spark types.
IMPORT_TYPES = {
    "TINYINT": "tinyint",
    "INT": "int",
    "BIGINT": "bigint",
    "DECIMAL(38, 10)": "decimal(38,10)",
    "DATE": "date",
    "DATETIME": "timestamp_ntz",
    "TEXT": "string",
}
