"""Guarded CSV export and JSON-lines metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def guard(value: Column) -> Column:
    """Text safe to open in a spreadsheet: NULL is empty, formula starters get an apostrophe."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def export_rows(df: DataFrame) -> DataFrame:
    return df.select(*[guard(F.col(c)).alias(c) for c in df.columns])


def export_csv(df: DataFrame, path: str) -> None:
    export_rows(df).write.mode("overwrite").options(
        header=True, quote='"', escape='"', emptyValue="", encoding="UTF-8",
        # the writer's own stripping would let a guarded cell lose the blank before a formula
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """One JSON line per measured load."""
    df.write.mode("append").json(path)
