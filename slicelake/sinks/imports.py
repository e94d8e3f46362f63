"""Reviewed imports: target definition and load."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from slicelake import schemas
from slicelake.operators import quality
from slicelake.session import stored
from slicelake.sources import csvfiles

_IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,63}")
_VARCHAR = re.compile(r"VARCHAR\((\d+)\)")


@dataclass
class ImportSpec:
    """A reviewed definition. ``columns`` maps a name to its declared type."""

    database: str
    table: str
    columns: dict[str, str]
    primary_key: list[str] = field(default_factory=list)
    nullable: set[str] = field(default_factory=set)
    add_row_id: bool = False
    partition_by_batch: bool = False
    delimiter: str = ","

    def __post_init__(self) -> None:
        for name in (self.database, self.table, *self.columns):
            if not _IDENTIFIER.fullmatch(name):
                raise ValueError("Invalid identifier: use letters, numbers, and underscores; start with a letter.")
        # a sliced table needs a key, and a generated key replaces any chosen one
        self.add_row_id = self.add_row_id or (self.partition_by_batch and not self.primary_key)
        if self.add_row_id:
            self.primary_key = ["ROW_ID"]
        elif not set(self.primary_key) <= set(self.columns):
            raise ValueError(f"The key names columns that are not declared: {sorted(set(self.primary_key) - set(self.columns))}.")
        self.spark_types = {c: spark_type(t) for c, t in self.columns.items()}

    @property
    def limits(self) -> dict[str, int]:
        found = {c: _VARCHAR.fullmatch(t.strip().upper()) for c, t in self.columns.items()}
        return {c: int(m.group(1)) for c, m in found.items() if m}

    @property
    def schema(self) -> T.StructType:
        fields = [("ROW_ID", "bigint", False)] if self.add_row_id else []
        fields += [(c, t, c in self.nullable and c not in self.primary_key) for c, t in self.spark_types.items()]
        if self.partition_by_batch:
            fields.append(("batch_num", "bigint", False))
        return T.StructType([T.StructField(n, T._parse_datatype_string(t), null) for n, t, null in fields])


def spark_type(declared: str) -> str:
    name = declared.strip().upper()
    if name in schemas.IMPORT_TYPES:
        return schemas.IMPORT_TYPES[name]
    size = _VARCHAR.fullmatch(name)
    if size and 1 <= int(size.group(1)) <= 65535:
        return "string"
    raise ValueError(f"Columns cannot be declared {declared}; known are VARCHAR with a length and {', '.join(schemas.IMPORT_TYPES)}.")


def create_target(spark: SparkSession, spec: ImportSpec) -> str:
    """Create the target if absent; key columns are recorded as a table property."""
    name = f"`{spec.database}`.`{spec.table}`"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{spec.database}`")
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in spec.schema
    )
    key = ",".join([*spec.primary_key, *(["batch_num"] if spec.partition_by_batch and spec.primary_key else [])])
    parts = " PARTITIONED BY (batch_num)" if spec.partition_by_batch else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{parts} "
        f"TBLPROPERTIES ('slicelake.primary_key' = '{key}')"
    )
    return name


def import_rows(rows: DataFrame, spec: ImportSpec, last_id: int = 0) -> DataFrame:
    """Text rows as typed rows of the target; slice 0, empty cells NULL. Generated ids follow ``last_id``."""
    typed = [F.col(c).cast(t).alias(c) for c, t in spec.spark_types.items()]
    out = csvfiles.with_row_id(rows) if spec.add_row_id else rows
    head = [(F.col("ROW_ID") + last_id).alias("ROW_ID")] if spec.add_row_id else []
    tail = [F.lit(0).cast("bigint").alias("batch_num")] if spec.partition_by_batch else []
    return out.select(*head, *typed, *tail)


def import_findings(rows: DataFrame, spec: ImportSpec) -> DataFrame:
    """Everything that makes an import fail: surplus cells, blank keys, missing or unfit values, repeated keys.

    ``rows``: what ``read_import_csv`` gives, with ``row_no``. Keys are compared as values of their type, all files
    of an import together.
    """
    keep = ["file", "row_no"]
    shape = ["file", "row_no", "finding"]
    surplus = quality.arity_findings(rows, F.lit(len(spec.columns)), spec.delimiter).where(
        F.col("finding") == "surplus"
    )
    found = surplus.select("file", "row_no", F.lit("CSV row has more values than its header.").alias("finding"))
    casts = quality.cast_findings(rows, {c: t for c, t in spec.spark_types.items() if t != "string"}, keep)
    found = found.unionByName(
        casts.select(*keep, F.concat(F.lit("incompatible value in "), "column").alias("finding"))
    )
    if spec.limits:
        found = found.unionByName(
            quality.length_findings(rows, spec.limits, keep).select(
                *keep, F.concat(F.lit("value too long in "), "column").alias("finding")
            )
        )
    needed = [c for c in spec.columns if c not in spec.nullable and c not in spec.primary_key]
    blank = {c: F.col(c).isNull() for c in needed}    # the scan has made empty cells NULL; blanks are text
    found = found.unionByName(
        quality._per_column(rows, keep, blank).select(*keep, F.concat(F.lit("no value in "), "column").alias("finding"))
    )
    if spec.primary_key and not spec.add_row_id:
        found = found.unionByName(
            quality.blank_key_findings(rows, spec.primary_key).select(
                "file", "row_no", F.col("message").alias("finding")
            )
        )
        typed = rows.select("file", *[F.col(c).try_cast(spec.spark_types[c]).alias(c) for c in spec.primary_key])
        keys = (
            typed.dropna(subset=spec.primary_key).groupBy(*spec.primary_key)
            .agg(F.count(F.lit(1)).alias("copies"), F.min("file").alias("file")).where("copies > 1")
        )
        found = found.unionByName(
            keys.select("file", F.lit(None).cast("bigint").alias("row_no"), F.lit("duplicate primary-key value").alias("finding"))
        )
    return found.select(*shape)


def import_csv(spark: SparkSession, path: str, spec: ImportSpec) -> int:
    """Check the file, create the target and append the rows; returns their number.

    The first finding, in row order, fails the import before anything is written; so does a key that the target has.
    """
    # the text is looked through once for its quotes and once for its cells; all checks read what was stored
    scan = stored(csvfiles.read_import_csv(spark, path, list(spec.columns), spec.delimiter), "import-rows")
    rows = csvfiles.with_row_numbers(scan)
    worst = import_findings(rows, spec).orderBy(F.asc_nulls_last("row_no"), "finding").limit(1).collect()
    if worst:
        raise ValueError(f"Import failed: {worst[0]['finding']} (row {worst[0]['row_no']}).")
    name = create_target(spark, spec)
    target = spark.table(name)
    last_id = 0
    if spec.add_row_id:
        last_id = target.agg(F.max("ROW_ID")).first()[0] or 0
    elif spec.primary_key:
        if not import_rows(rows, spec).join(target.select(*spec.primary_key), spec.primary_key, "left_semi").isEmpty():
            raise ValueError("Import failed: a primary-key value is in the target already.")
    out = import_rows(rows, spec, last_id)
    from pyspark.sql import Observation

    seen = Observation()
    out.observe(seen, F.count(F.lit(1)).alias("rows")).write.insertInto(name)
    return seen.get["rows"]
