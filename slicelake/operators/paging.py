"""Newest-first lists, pages and exports."""

from __future__ import annotations

import bisect
import itertools
import math

from pyspark.sql import Column, DataFrame, functions as F

from slicelake.operators.skew import BLOCK_ROWS

MAX_RECENT = 500
SAMPLE = 4096   # rows, as expected, that splitters are taken from
RANGES = 64     # ranges counted in one pass


def recent(df: DataFrame, limit: int = 10, target: tuple[str, str] | None = None) -> DataFrame:
    """Top-N by creation time, newest first; a top-N per task, never a full sort."""
    if target is not None:
        df = df.where((F.col("target_database") == target[0]) & (F.col("target_table") == target[1]))
    return df.orderBy(F.desc("created_at"), F.desc("id")).limit(min(max(limit, 1), MAX_RECENT))


def clamp_page(page: int, total: int, size: int) -> int:
    return min(max(page, 1), max(1, math.ceil(total / max(size, 1))))


def page(
    df: DataFrame,
    page_number: int,
    size: int,
    sort_column: str,
    descending: bool = True,
    tie: str = "id",
    clamp: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, int]:
    """One page in sort order, and the total. However deep it lies, about ``block_rows`` rows are sorted for it."""
    size = max(size, 1)
    total = df.count()
    number = clamp_page(page_number, total, size) if clamp else max(page_number, 1)
    first = (number - 1) * size
    if first >= total:
        return df.limit(0), total
    last = min(first + size, total)
    low, high = (total - last, total - first) if descending else (first, last)
    chosen, before, rows = narrow(df, [sort_column, tie], low, high, total, block_rows)
    offset = before + rows - high if descending else low - before
    order = [F.desc(c) if descending else F.asc(c) for c in (sort_column, tie)]
    return chosen.orderBy(*order).offset(int(offset)).limit(last - first), total


def narrow(
    df: DataFrame, order: list[str], low: int, high: int, total: int, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, int, int]:
    """Rows around the positions ``low`` to ``high`` (0-based, ascending, NULLs first), how many rows come before them, and their number.

    For columns of any type that can be ordered and written as text: a sample gives splitters, one pass counts the rows
    between them, and the ranges with the wanted positions are looked at again until they are small. Each round
    divides the rows by some ``RANGES``; sample and counts have a few thousand rows whatever the table's size.
    """
    kinds = [df.schema[c].dataType for c in order]
    key = F.struct(*[F.col(c) for c in order])
    rest, before, rows = df, 0, total
    while rows > block_rows:
        step = max(rows // SAMPLE, 1)
        # equal keys are sampled together and counted, so that a frequent one is one row
        sample = (
            rest.where(F.pmod(F.xxhash64(*order), F.lit(step)) == 0).groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
            .orderBy(*[F.asc(c) for c in order])
            .select(*[F.col(c).cast("string") for c in order], "_n").collect()
        )
        weight = list(itertools.accumulate(r["_n"] for r in sample))
        places = {bisect.bisect_right(weight, weight[-1] * i // RANGES) for i in range(1, RANGES)} if sample else set()
        splitters = [
            F.struct(*[F.lit(sample[i][c]).cast(kind).alias(c) for c, kind in zip(order, kinds)]) for i in sorted(places) if i < len(sample)
        ]

        def place(a: int, b: int) -> Column:
            """The number of splitters up to the key, known to lie between a and b, by halving."""
            if a == b:
                return F.lit(a)
            middle = (a + b) // 2
            return F.when(key < splitters[middle], place(a, middle)).otherwise(place(middle + 1, b))

        counts = dict(rest.groupBy(place(0, len(splitters)).alias("_range")).count().collect())
        ends = list(itertools.accumulate(counts.get(i, 0) for i in range(len(splitters) + 1)))
        a = bisect.bisect_right(ends, low - before)
        b = bisect.bisect_left(ends, high - before)
        start = ends[a - 1] if a else 0
        if ends[b] - start == rows:
            break       # one key has more rows than a block
        rest = rest.where((key >= splitters[a - 1] if a else F.lit(True)) & (key < splitters[b] if b < len(splitters) else F.lit(True)))
        before, rows = before + start, ends[b] - start
    return rest, before, rows


def event_page(
    raw: DataFrame, page_number: int, size: int, sort_column: str | None = None, direction: str = "desc"
) -> tuple[DataFrame, int]:
    """A page of raw events; unknown sort columns fall back to the event date."""
    if direction.lower() not in ("asc", "desc"):
        raise ValueError("Object event sort direction must be ascending or descending.")
    column = sort_order(raw, sort_column)
    return page(raw, page_number, size, column, direction.lower() == "desc", clamp=False)


def sort_order(raw: DataFrame, sort_column: str | None) -> str:
    columns = [c for c in raw.columns if c != "invocation_mode"]
    if sort_column in columns:
        return sort_column
    return "event_date" if "event_date" in columns else columns[0]


def export_view(raw: DataFrame, sort_column: str | None = None, descending: bool = True) -> DataFrame:
    """All raw events in order, without the mode column."""
    column = sort_order(raw, sort_column)
    order = [F.desc(column), F.desc("id")] if descending else [F.asc(column), F.asc("id")]
    return raw.orderBy(*order).drop("invocation_mode")


def prepend_if_absent(page_rows: DataFrame, row: DataFrame) -> DataFrame:
    """The page plus a single looked-up row, once."""
    return page_rows.unionByName(row).dropDuplicates(["id"])


def recent_errors(errors: DataFrame, limit: int, error_id: int | None = None) -> DataFrame:
    top = recent(errors, limit)
    if error_id is None:
        return top
    return prepend_if_absent(top, errors.where(F.col("id") == error_id))


def list_mappings(mappings: DataFrame) -> DataFrame:
    return mappings.orderBy("compartment_name", "bucket_name", "resource_name_pattern", "id")


def mode_filter(df: DataFrame, mode: str) -> DataFrame:
    return df if mode.upper() == "ALL" else df.where(F.col("invocation_mode") == mode.upper())


def since(df: DataFrame, as_of: str, minutes: int, column: str = "created_at") -> DataFrame:
    start = F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{int(minutes)}' MINUTE")
    return df.where(F.col(column) >= start)
