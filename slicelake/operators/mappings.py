"""Maintenance of control tables as batch merges (M1, M6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from slicelake.operators import skew

VALUES = [
    "compartment_name", "bucket_name", "resource_name_pattern", "target_database", "target_table",
    "invocation_mode", "worker_threads",
]


def _edits(changes: DataFrame) -> DataFrame:
    """Per id: its first delete, and its last update before that delete."""
    deletes = F.min(F.when(F.col("op") == "delete", F.col("change_no"))).alias("deleted_at")
    gone = changes.where(F.col("op") != "insert").groupBy("id").agg(deletes)
    last = (
        changes.where(F.col("op") == "update")
        .join(gone.where(F.col("deleted_at").isNotNull()), "id", "left")
        .where(F.col("deleted_at").isNull() | (F.col("change_no") < F.col("deleted_at")))
        .select("id", "change_no", *VALUES)
    )
    updates = last.groupBy("id").agg(F.max(F.struct("change_no", *VALUES)).alias("edit"))
    return gone.join(updates, "id", "left")


def apply_mapping_changes(mappings: DataFrame, changes: DataFrame) -> DataFrame:
    """Mappings after an ordered feed of ``op`` insert / update / delete (``change_no`` unique).

    New rows are numbered above the highest id, in feed order.
    """
    edits = _edits(changes)
    kept = (
        mappings.join(edits, "id", "left")
        .where(F.col("deleted_at").isNull())
        .select("id", *[F.when(F.col("edit").isNotNull(), F.col(f"edit.{c}")).otherwise(F.col(c)).alias(c) for c in VALUES])
    )
    top = mappings.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    added = skew.rank_rows(
        changes.where(F.col("op") == "insert"), [], [F.col("change_no")], skew.seq_block("change_no"), "_n"
    )
    return kept.unionByName(added.select((F.col("_n") + top).cast("bigint").alias("id"), *VALUES))


def change_outcomes(mappings: DataFrame, changes: DataFrame) -> DataFrame:
    """Whether each change hit a row: an unknown or already deleted id does not."""
    known = mappings.select("id", F.lit(True).alias("_known"))
    gone = _edits(changes).select("id", "deleted_at")
    late = F.coalesce(F.col("deleted_at") < F.col("change_no"), F.lit(False))
    edits = (
        changes.where(F.col("op") != "insert")
        .join(known, "id", "left")
        .join(gone, "id", "left")
        .select("change_no", "op", (F.coalesce("_known", F.lit(False)) & ~late).alias("affected"))
    )
    # inserts carry no id, so they take no part in the joins
    inserts = changes.where(F.col("op") == "insert").select("change_no", "op", F.lit(True).alias("affected"))
    return edits.unionByName(inserts)


def upgrade_schema(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """``df`` with the columns it lacks added, and defaults put in for missing values."""
    defaults = defaults or {}
    columns = []
    for field in schema.fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)
