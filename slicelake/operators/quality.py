"""Checks on files, rows, slices and mappings; each returns findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slicelake.functions import events as ev
from slicelake.functions import names

DELIMITERS = (",", ";", "\t", "|")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _compared(header: Column, expected: Column, body) -> Column:
    """``body`` of a struct with both lists and their folded names (``folded``, ``wanted``)."""
    fold = lambda names_: F.transform(names_, names.fold)
    return _let(header, lambda h: _let(expected, lambda e: _let(
        F.struct(h.alias("header"), e.alias("expected"), fold(h).alias("folded"), fold(e).alias("wanted")), body
    )))


def _diff(lists: Column) -> Column:
    return F.struct(
        F.filter(lists["expected"], lambda e, i: ~F.array_contains(lists["folded"], F.get(lists["wanted"], i))).alias("missing"),
        F.filter(lists["header"], lambda h, i: ~F.array_contains(lists["wanted"], F.get(lists["folded"], i))).alias("unknown"),
    )


def header_diff(header: Column, expected: Column) -> Column:
    """struct(missing, unknown): names compared without regard to case."""
    return _compared(header, expected, _diff)


def first_repeat(folded: Column) -> Column:
    """1-based position of the first name that occurred before, NULL if none."""
    return F.get(
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(folded), F.lit(1))),
            lambda i: F.array_position(folded, F.try_element_at(folded, i)) < i,
        ),
        F.lit(0),
    )


def header_findings(headers: DataFrame, expected: Column) -> DataFrame:
    """Loader headers (``file``, ``header``): repeated names, else missing and unknown ones.

    Names are folded once for each header.
    """
    listed = lambda label, part: F.when(F.size(part) > 0, F.concat(F.lit(label), F.array_join(part, ", ")))

    def repeated(lists: Column, at: Column) -> Column:
        earlier = F.array_position(lists["folded"], F.try_element_at(lists["folded"], at)).cast("int")
        return F.concat(
            F.lit("CSV has duplicate column names when compared case-insensitively: "),
            F.try_element_at(lists["header"], earlier),
            F.lit(", "),
            F.try_element_at(lists["header"], at),
            F.lit("."),
        )

    def different(lists: Column) -> Column:
        details = _let(_diff(lists), lambda d: F.concat_ws("; ", listed("missing: ", d["missing"]), listed("unknown: ", d["unknown"])))
        text = lambda d: F.when(d != "", F.concat(F.lit("CSV columns do not match target table ("), d, F.lit(").")))
        return _let(details, text)

    message = _compared(
        F.col("header"), expected,
        lambda lists: _let(first_repeat(lists["folded"]), lambda at: F.when(at.isNotNull(), repeated(lists, at)).otherwise(different(lists))),
    )
    # a generated column: a filter on it is not worked out a second time before it
    found = headers.select("file", F.explode(F.array(message)).alias("message"))
    return found.where(F.col("message").isNotNull())


def import_header_findings(headers: DataFrame) -> DataFrame:
    """Import headers: none at all, repeated after normalisation, or not usable as a column name."""
    clean = F.transform("header", names.sanitize_header)
    message = (
        F.when(F.size("header") == 0, "CSV must contain a header row.")
        .when(
            F.exists(clean, lambda n: ~names.is_identifier(n)),
            "Invalid CSV column name: use letters, numbers, and underscores; start with a letter.",
        )
        .when(F.size(F.array_distinct(clean)) < F.size(clean), "CSV headers become duplicates after normalization.")
    )
    return headers.withColumn("message", message).where(F.col("message").isNotNull()).select("file", "message")


def count_cells(line: Column, delimiter: str = ",") -> Column:
    """Cells of one raw CSV record: quoted stretches are blanked, then delimiters counted."""
    bare = F.regexp_replace(line, r'(?s)"([^"\\]|""|\\.)*"', "q")
    return F.size(F.split(bare, r"\Q" + delimiter + r"\E", -1))


def arity_findings(df: DataFrame, width: Column, delimiter: str = ",") -> DataFrame:
    """Rows with more or fewer cells than the header. ``_record`` holds the raw text of rows
    whose cell count differs (NULL elsewhere), so only those are looked at again."""
    cells = count_cells(F.col("_record"), delimiter)
    return (
        df.where(F.col("_record").isNotNull())
        .withColumn("cells", cells.cast("bigint"))
        .withColumn("width", width.cast("bigint"))
        .where(F.col("cells") != F.col("width"))
        .withColumn("finding", F.when(F.col("cells") > F.col("width"), "surplus").otherwise("short"))
    )


def blank_key_findings(df: DataFrame, keys: list[str], group: str = "file") -> DataFrame:
    """Per file the first row, and in it the first key column, without a value."""
    blanks = F.filter(
        F.array(
            *[
                F.struct(
                    F.col("row_no").alias("row_no"),
                    F.lit(i).alias("position"),
                    F.lit(key).alias("column"),
                    (names.strip(F.coalesce(F.col(key).cast("string"), F.lit(""))) == "").alias("blank"),
                )
                for i, key in enumerate(keys)
            ]
        ),
        lambda k: k["blank"],
    )
    first = df.select(group, F.get(blanks, F.lit(0)).alias("_f")).where(F.col("_f").isNotNull())
    return first.groupBy(group).agg(F.min("_f").alias("_f")).select(
        group,
        F.col("_f.row_no").alias("row_no"),
        F.col("_f.column").alias("column"),
        F.concat(
            F.lit("CSV row "), F.col("_f.row_no").cast("string"), F.lit(" has no value for primary-key column '"),
            F.col("_f.column"), F.lit("'. Primary-key values must not be null."),
        ).alias("message"),
    )


def _per_column(df: DataFrame, keep: list[str], tests: dict[str, Column]) -> DataFrame:
    """One row per (row, column) whose test is true; none for no tests."""
    if not tests:
        return df.select(*keep, F.lit("").alias("column"), F.lit("").alias("value")).where(F.lit(False))
    found = F.filter(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), test.alias("bad"))
                for c, test in tests.items()
            ]
        ),
        lambda f: f["bad"],
    )
    return df.select(*keep, F.inline(found)).drop("bad")


def cast_findings(df: DataFrame, types: dict[str, str], keep: list[str]) -> DataFrame:
    """Cells that are not empty and do not convert to the declared type."""
    bad = {c: (F.col(c) != "") & F.col(c).try_cast(t).isNull() for c, t in types.items()}
    return _per_column(df, keep, {c: F.coalesce(t, F.lit(False)) for c, t in bad.items()})


def length_findings(df: DataFrame, limits: dict[str, int], keep: list[str]) -> DataFrame:
    """Cells longer than the declared length."""
    return _per_column(df, keep, {c: F.coalesce(F.length(c) > n, F.lit(False)) for c, n in limits.items()})


def stage_purity(staged: DataFrame, expected: str = "expected_batch") -> DataFrame:
    """Staged rows per attempt that carry another batch number than the one they were staged for."""
    return (
        staged.where(F.col("batch_num") != F.col(expected))
        .groupBy("attempt")
        .agg(F.count(F.lit(1)).alias("foreign_rows"))
    )


def validate_stage(staged: DataFrame, batch_num: int) -> bool:
    return staged.where(F.col("batch_num") != batch_num).limit(1).count() == 0


def duplicate_keys(df: DataFrame, keys: list[str], slice_columns: list[str]) -> DataFrame:
    """Keys that occur more than once within one slice."""
    return (
        df.groupBy(*slice_columns, *keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    )


def overlapping_records(visible: DataFrame, keys: list[str]) -> DataFrame:
    """Keys visible in more than one slice of a target.

    Smallest and largest slice differ exactly when there are several, so a combining
    min / max does instead of a distinct count.
    """
    return (
        visible.groupBy("target_database", "target_table", *keys)
        .agg(F.min("batch_num").alias("lowest_batch"), F.max("batch_num").alias("highest_batch"))
        .where(F.col("lowest_batch") < F.col("highest_batch"))
    )


def unique_key_findings(index_columns: DataFrame) -> DataFrame:
    """Unique indexes of targets that lack the slice column."""
    return (
        index_columns.groupBy("target_database", "target_table", "index_name")
        .agg(F.bool_or(F.lower("column_name") == "batch_num").alias("has_batch"))
        .where(~F.col("has_batch"))
        .drop("has_batch")
    )


def target_findings(mappings: DataFrame, catalog: DataFrame, indexes: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Contract of every mapped target, one row per broken rule.

    ``catalog``: one row per column (``column_name``, ``hidden``, ``generated``,
    ``partition_column``). ``indexes``: one row per unique-index column.
    """
    target = ["target_database", "target_table"]
    batch = F.lower("column_name") == "batch_num"
    hidden, generated = F.coalesce("hidden", F.lit(False)), F.coalesce("generated", F.lit(False))
    facts = catalog.groupBy(*target).agg(
        F.bool_or(batch & hidden).alias("_hidden"),
        F.bool_or(batch & F.coalesce("partition_column", F.lit(False))).alias("_partitioned"),
        F.count_if(~batch & ~hidden & ~generated).alias("_loadable"),
    )
    bad_keys = unique_key_findings(indexes).select(*target).distinct().withColumn("_bad_key", F.lit(True))
    joined = mappings.select(*target).distinct().join(facts, target, "left").join(bad_keys, target, "left")
    rules = F.array_compact(
        F.array(
            F.when(F.col("_loadable").isNull(), "does not exist"),
            F.when(~F.col("_hidden"), "must have an invisible batch_num column"),
            F.when(~F.col("_partitioned"), "must use LIST partitioning by batch_num"),
            F.when(F.col("_bad_key"), "every unique key must include batch_num"),
            F.when(F.col("_loadable") == 0, "has no CSV-loadable columns"),
        )
    )
    found = joined.select(*target, F.explode(rules).alias("finding"))
    if registry is None:
        return found
    current = mappings.select(F.col("id").alias("mapping_id"), *[F.col(c).alias(f"_{c}") for c in target])
    moved = (
        registry.join(current, "mapping_id")
        .where((F.col("target_database") != F.col("_target_database")) | (F.col("target_table") != F.col("_target_table")))
        .select(*target, F.lit("mapping now points elsewhere").alias("finding"))
        .distinct()
    )
    return found.unionByName(moved)


def count_findings(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose row counts differ."""
    return (
        expected.withColumnRenamed("rows", "expected_rows")
        .join(actual.withColumnRenamed("rows", "actual_rows"), keys, "full_outer")
        .withColumns(
            {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("expected_rows", "actual_rows")}
        )
        .where(F.col("expected_rows") != F.col("actual_rows"))
    )


def normalize_mapping(forms: DataFrame) -> DataFrame:
    """Mapping forms with their fields cleaned and ``reasons`` listing what is wrong (empty: valid)."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    mode = F.upper(F.trim(F.coalesce(ev.non_empty(F.col("invocation_mode")), F.lit("SYNC"))))
    workers = F.trim(F.coalesce(ev.non_empty(F.col("worker_threads").cast("string")), F.lit("4"))).try_cast("int")
    clean = forms.withColumns(
        {
            "compartment_name": text("compartment_name"),
            "bucket_name": text("bucket_name"),
            "resource_name_pattern": text("resource_name_pattern"),
            "target_database": text("target_database"),
            "target_table": F.regexp_replace(text("target_table"), r"^\.+", ""),
            "invocation_mode": mode,
            "worker_threads": workers,
        }
    )

    def required(column: str, label: str, maximum: int) -> list[Column]:
        return [
            F.when(F.col(column) == "", f"{label} is required."),
            F.when(F.length(column) > maximum, f"{label} must be {maximum} characters or fewer."),
        ]

    reasons = F.array_compact(
        F.array(
            F.when(~F.col("invocation_mode").isin(*ev.MODES), "Invocation mode must be SYNC or DETACHED."),
            F.when(F.col("worker_threads").isNull(), "Worker threads must be a whole number from 1 to 64."),
            F.when(~F.col("worker_threads").between(1, 64), "Worker threads must be from 1 to 64."),
            *required("compartment_name", "Compartment name", 255),
            *required("bucket_name", "Bucket name", 255),
            *required("resource_name_pattern", "Resource name pattern", 1024),
            F.when(~names.is_identifier(F.col("target_database")), "Invalid target database."),
            F.when(~names.is_identifier(F.col("target_table")), "Invalid target table."),
        )
    )
    return clean.withColumn("reasons", reasons)


def mapping_findings(forms: DataFrame) -> DataFrame:
    return normalize_mapping(forms).select("id", F.explode("reasons").alias("finding"))


def delimiter_profile(lines: DataFrame) -> DataFrame:
    """Delimiter of each file from its first lines (``file``, ``line``).

    The candidate that occurs equally often, at least once, on every line; the most
    frequent of several; comma if there is none.
    """
    bare = F.regexp_replace("line", r'"([^"]|"")*"', "q")
    counted = lines.select(
        "file",
        *[(F.size(F.split(bare, r"\Q" + d + r"\E", -1)) - 1).alias(f"_n{i}") for i, d in enumerate(DELIMITERS)],
    )
    stats = counted.groupBy("file").agg(
        *[F.struct(F.min(f"_n{i}").alias("low"), F.max(f"_n{i}").alias("high")).alias(f"_s{i}") for i in range(len(DELIMITERS))]
    )
    candidates = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col(f"_s{i}.low") == F.col(f"_s{i}.high")) & (F.col(f"_s{i}.low") > 0),
                    F.struct(F.col(f"_s{i}.low").alias("n"), F.lit(-i).alias("rank"), F.lit(d).alias("delimiter")),
                )
                for i, d in enumerate(DELIMITERS)
            ]
        )
    )
    best = F.get(F.sort_array(candidates, asc=False), F.lit(0))
    return stats.select("file", F.coalesce(best["delimiter"], F.lit(",")).alias("delimiter"))
