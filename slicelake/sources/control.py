"""Control tables by name; a missing one reads as empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slicelake import schemas
from slicelake.operators.mappings import upgrade_schema


def control(spark: SparkSession, name: str, database: str) -> DataFrame:
    """The table in today's schema: absent columns are added, an absent table is empty."""
    schema = schemas.CONTROL[name]
    if not spark.catalog.tableExists(f"{database}.{name}"):
        return spark.createDataFrame([], schema)
    return upgrade(spark.table(f"{database}.{name}"), name)


def upgrade(df: DataFrame, name: str) -> DataFrame:
    """Rows of an older version of a control table in today's schema."""
    return upgrade_schema(df, schemas.CONTROL[name], schemas.UPGRADE_DEFAULTS.get(name))
