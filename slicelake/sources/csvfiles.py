"""CSV objects: loader flavour (S2), import flavour (S3), headers, row numbers (W5, W6), listing."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from slicelake.functions import names
from slicelake.operators import quality
from slicelake.paths import filesystem
from slicelake.session import local_frame, stored
from slicelake.sources import records

PROBE_LINES = 50
HEADER_SCHEMA = "file string, size bigint, header array<string>, lines array<string>, error string"


def probe_headers(files: DataFrame, delimiter: str | None = ",", encoding: str = "utf-8") -> DataFrame:
    """Header record, first lines and size of each file (``file``), read on the executors.

    Only the start of a file is fetched. A file that cannot be opened or decoded comes back
    with ``error``. ``delimiter=None`` returns the lines and leaves the header empty.
    """

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["file"]:
                header, lines, error, size = [], [], None, 0
                try:
                    system, inner = filesystem(path)
                    size = system.get_file_info(inner).size or 0
                    with system.open_input_stream(inner) as stream:
                        text = io.TextIOWrapper(stream, encoding=encoding, newline="")
                        kept: list[str] = []
                        source = _keep(text, kept)
                        if delimiter is not None:
                            header = next(csv.reader(source, delimiter=delimiter), [])
                        else:
                            for _ in zip(range(PROBE_LINES), source):
                                pass
                            lines = [line.rstrip("\r\n") for line in kept if line.strip("\r\n")]
                except Exception as problem:  # noqa: BLE001 - reported as the file's load error
                    error = f"{type(problem).__name__}: {problem}"
                out.append((path, size, header, lines, error))
            yield pd.DataFrame(out, columns=["file", "size", "header", "lines", "error"])

    return files.select("file").mapInPandas(probe, HEADER_SCHEMA)


def file_frame(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Paths as rows, spread over the cluster a few hundred per task at most."""
    frame = local_frame(spark, [(p,) for p in paths], {"file": "string"})
    return frame.repartition(min(len(paths), max(spark.sparkContext.defaultParallelism, len(paths) // 256)) or 1)


def _keep(text, kept: list[str]):
    for line in text:
        kept.append(line)
        yield line


path_key = records.path_key


def _cells(records: DataFrame, width: int, delimiter: str, escape: str) -> DataFrame:
    """``file``, ``block_start``, ``place`` and the cells ``c0``.. of records; ``_record`` is the text of those that are too short or long."""
    schema = ", ".join([*[f"c{i} string" for i in range(width)], "_record string"])
    options = dict(
        sep=delimiter, quote='"', escape=escape, mode="PERMISSIVE", columnNameOfCorruptRecord="_record",
        # a pruned parse would not see how many cells a row has
        columnPruning="false",
    )
    parsed = records.withColumn("_cells", F.from_csv("value", schema, options))
    return parsed.select("file", "block_start", "place", "_cells.*")


def signatures(headers: DataFrame) -> list[tuple[list[str], list[str]]]:
    """Distinct headers of files without an error, and the files having each."""
    rows = headers.where(F.col("error").isNull()).groupBy("header").agg(F.collect_list("file").alias("files")).collect()
    return [(list(r["header"]), sorted(r["files"])) for r in rows]


def check_files(spark: SparkSession, headers: DataFrame) -> tuple[DataFrame, records.Splits]:
    """Read the text of the files without an error once: ``headers`` with an error for those that are not UTF-8, and how splits begin."""
    good = [r["file"] for r in headers.where(F.col("error").isNull()).select("file").collect()]
    if not good:
        return headers, records.Splits({})
    states = stored(records.split_states(spark, good), "csv-splits")   # one row for each split
    invalid = states.where("invalid > 0").select("_file").distinct().join(records.path_table(spark, good), "_file")
    marks = invalid.select(F.col("file").alias("_plain"), F.lit("UnicodeDecodeError: the file is not valid UTF-8").alias("_invalid"))
    checked = headers.join(marks, path_key(F.col("file")) == F.col("_plain"), "left")
    return (
        checked.withColumn("error", F.coalesce("error", "_invalid")).drop("_plain", "_invalid"),
        records.Splits.read(states),
    )


def checked_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``probe_headers``, with an error for files that are not UTF-8 anywhere."""
    return check_files(spark, probe_headers(file_frame(spark, paths)))[0]


def bind_columns(header: list[str], columns: list[str]) -> dict[str, int] | None:
    """Position of every wanted column by case-folded name; None if the header does not fit."""
    folded = [h.casefold() for h in header]
    wanted = {c.casefold() for c in columns}
    if len(set(folded)) != len(folded) or set(folded) != wanted:
        return None
    return {c: folded.index(c.casefold()) for c in columns}


def read_object_csv(
    spark: SparkSession,
    paths: list[str],
    columns: list[str],
    headers: DataFrame | None = None,
    splits: records.Splits | None = None,
) -> DataFrame:
    """Rows of loader CSVs as text columns plus ``file``; files with other headers are left out.

    Columns are found by name in any letter case and order, cells are stripped, missing cells
    are ``''``, surplus cells are ignored. Files sharing a header are one scan in splits, whatever line breaks their
    cells have (see ``records``). ``headers``: what ``probe_headers`` or ``check_files`` gives; files with an error there are left
    out, too. ``splits``: what ``check_files`` gives, or ``Splits()`` to read the text only once, with the guess
    that no record goes over a split's end; ``splits.held()`` tells afterwards whether it was right.
    """
    if headers is None:
        headers, splits = check_files(spark, probe_headers(file_frame(spark, paths)))
    parts = []
    for header, files in signatures(headers):
        position = bind_columns(header, columns)
        if position is None:
            continue
        cells = [names.strip(F.coalesce(F.col(f"c{i}"), F.lit(""))).alias(c) for c, i in position.items()]
        raw = _cells(records.cut(spark, files, splits=splits), len(header), ",", '"')
        parts.append(raw.select("file", "block_start", "place", *cells))
    if not parts:
        fields = ", ".join(["file string", "block_start bigint", "place bigint", *[f"`{c}` string" for c in columns]])
        return spark.createDataFrame([], fields)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_import_csv(spark: SparkSession, path: str, header: list[str], delimiter: str = ",") -> DataFrame:
    """Rows of an import CSV under its normalised column names; empty cells are NULL.

    ``_record`` keeps the raw text of rows with too many or too few cells. Text that is not UTF-8 is refused.
    """
    if delimiter not in quality.DELIMITERS:
        raise ValueError(f"{delimiter!r} does not separate cells; these do: {', '.join(map(repr, quality.DELIMITERS))}.")
    states = stored(records.split_states(spark, [path], delimiter, "\\"), "csv-splits")
    if not states.where("invalid > 0").isEmpty():
        raise ValueError("CSV must be valid UTF-8.")
    raw = _cells(records.cut(spark, [path], delimiter, "\\", records.Splits.read(states)), len(header), delimiter, "\\")
    return raw.select(
        "file", "block_start", "place",
        *[F.nullif(F.col(f"c{i}"), F.lit("")).alias(h) for i, h in enumerate(header)],
        "_record",
    )


def profile_csv(spark: SparkSession, path: str) -> dict:
    """Delimiter, raw and normalised header of one import file."""
    files = local_frame(spark, [(path,)], {"file": "string"})
    lines = probe_headers(files, None, "utf-8-sig")
    delimiter = (
        quality.delimiter_profile(lines.select("file", F.explode("lines").alias("line"))).collect()
    )
    chosen = delimiter[0]["delimiter"] if delimiter else ","
    probed = probe_headers(files, chosen, "utf-8-sig")
    found = probed.select("error", "header", F.transform("header", names.sanitize_header).alias("clean")).first()
    if found["error"] or not found["header"]:
        raise ValueError(found["error"] or "CSV must contain a header row.")
    return {"delimiter": chosen, "raw_header": list(found["header"]), "header": list(found["clean"])}


def with_row_numbers(df: DataFrame, name: str = "row_no", first: int = 2) -> DataFrame:
    """Number the rows of each file in file order: a row's place in its split plus the rows of earlier splits. No rows are sorted."""
    splits = df.groupBy("file", "block_start").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (
        df.join(placed, ["file", "block_start"]).withColumn(name, F.col("place") + F.col("_before") + first).drop("_before")
    )


def with_row_id(df: DataFrame, name: str = "ROW_ID") -> DataFrame:
    """A gap-free surrogate key in (file, row_no) order over all files."""
    per_file = df.groupBy("file").agg(F.count(F.lit(1)).alias("_n"), F.min("row_no").alias("_first"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    offset = per_file.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (
        df.join(offset, "file")
        .withColumn(name, F.col("row_no") - F.col("_first") + F.col("_before") + 1)
        .drop("_first", "_before")
    )


def list_objects(spark: SparkSession, root: str, pattern: str, limit: int = 500) -> DataFrame:
    """Objects under ``root`` whose name matches a glob, at most ``limit``; contents are not read.

    The literal folder of the pattern becomes the listed path, so other folders are never visited.
    """
    literal = re.match(r"[^*?\[]*", pattern).group(0)
    folder = literal.rsplit("/", 1)[0] + "/" if "/" in literal else ""
    base = f"{root.rstrip('/')}/"
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(base + folder)
        .select("path", "length", "modificationTime")
    )
    anchor = path_key(F.lit(base))
    name = F.substring(path_key(F.col("path")), F.length(anchor) + 1, F.lit(2147483647))
    return (
        listing.withColumn("name", name)
        .where(names.glob_match(F.col("name"), names.glob_regex(F.lit(pattern))))
        .select("name", F.col("length").alias("size"), F.col("modificationTime").alias("time_modified"))
        .limit(limit)
    )
