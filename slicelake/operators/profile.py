"""Column profile and type inference of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slicelake.functions import events as ev
from slicelake.functions import names

SAMPLE_ROWS = 25
INTEGER = r"^[-+]?\d+\z"
# What a Python Decimal accepts, after underscores are taken out.
DECIMAL = r"(?i)^[-+]?((\d+(\.\d*)?|\.\d+)(e[-+]?\d+)?|inf|infinity|s?nan\d*)\z"
VARCHAR_LIMIT = 1024


def column_stats(df: DataFrame, columns: list[str], sample_rows: int | None = None) -> DataFrame:
    """One row per column: filled cells, which formats all of them have, longest value.

    A single aggregation over all columns; only its one result row is unpivoted.
    ``sample_rows`` looks at the first rows of each file (``row_no`` <= that) only.
    """
    if sample_rows is not None:
        df = df.where(F.col("row_no") <= sample_rows)
    # each cell is stripped once; the formats are then tested on the result
    values = df.select(*[ev.non_empty(names.strip(F.col(c).cast("string"))).alias(c) for c in columns])
    structs = []
    for column in columns:
        value = F.col(column)
        number = F.replace(value, F.lit("_"), F.lit("")).rlike(DECIMAL)
        day = F.left(value, F.lit(10)).try_cast("date").isNotNull()
        tests = {
            "integers": value.rlike(INTEGER),
            "decimals": number,
            "datetimes": value.rlike(ev.ISO_DATETIME) & day,
            "dates": value.rlike(r"^\d{4}-\d{2}-\d{2}\z") & day,
        }
        structs.append(
            F.struct(
                F.lit(column).alias("column"),
                F.count(value).alias("filled"),
                # NULL for empty cells, which the aggregate passes over
                *[F.coalesce(F.bool_and(test), F.lit(False)).alias(name) for name, test in tests.items()],
                F.max(F.length(value)).cast("bigint").alias("longest"),
            )
        )
    return values.agg(F.array(*structs).alias("_s")).select(F.inline("_s"))


def inferred_type(prefer_date: bool = False) -> Column:
    """Type name from the statistics. Plain dates count as datetimes unless ``prefer_date``."""
    varchar = F.concat(F.lit("VARCHAR("), F.col("longest").cast("string"), F.lit(")"))
    chosen = (
        F.when(F.col("filled") == 0, "TEXT")
        .when(F.col("integers"), "BIGINT")
        .when(F.col("decimals"), "DECIMAL(38, 10)")
    )
    if prefer_date:
        chosen = chosen.when(F.col("dates"), "DATE")
    return (
        chosen.when(F.col("datetimes"), "DATETIME")
        .when(F.col("longest") <= VARCHAR_LIMIT, varchar)
        .otherwise("TEXT")
    )


def infer_types(
    df: DataFrame, columns: list[str], sample_rows: int | None = None, prefer_date: bool = False
) -> DataFrame:
    return column_stats(df, columns, sample_rows).select("column", inferred_type(prefer_date).alias("type"))
