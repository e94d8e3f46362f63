"""Ordered computations that do not put one hot key into one task.

A window over ``PARTITION BY key`` sends every row of a key to one task. Here the
rows of a key are cut into blocks of consecutive rows, each block is scanned on its
own, one summary row per block is carried from block to block, and the carried value
is joined back. The results equal those of the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from slicelake.session import stored

MIN_HOT_ROWS = 2_000_000  # rows of a key that one task copes with
BLOCK_ROWS = 1 << 20      # rows of a block
FIRST_BLOCK = -(1 << 63)  # the block of rows whose order is NULL; they sort first


@dataclass(frozen=True)
class HotKeys:
    """Keys whose groups are too large for one task, as a table; there can be as many as the data have."""

    keys: tuple[str, ...]
    frame: DataFrame | None = None

    def __bool__(self) -> bool:
        return self.frame is not None

    def same(self) -> list[Column]:
        return [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in self.keys]


def find_hot(df: DataFrame, keys: list[str], min_rows: int = MIN_HOT_ROWS) -> HotKeys:
    """One counting job; a second one writes the keys if there are any."""
    counts = df.groupBy(*[F.col(k).alias(f"_hot_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.where(F.col("_n") >= min_rows).drop("_n")
    return HotKeys(tuple(keys), None if found.isEmpty() else stored(found, "hot-keys"))


def with_block(df: DataFrame, hot: HotKeys, seq: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_block``: 0 for ordinary keys, 1.. for consecutive pieces of hot keys.

    Rows of hot keys are numbered by key and ``seq``, so a piece holds at most ``block_rows`` rows, however the
    values of ``seq`` lie. The rows are written once, as both halves and the numbering read them.
    """
    if not hot:
        return df.withColumn("_block", F.lit(0).cast("bigint"))
    rows = stored(df, "hot-rows")
    ordinary = rows.join(hot.frame, hot.same(), "left_anti").withColumn("_block", F.lit(0).cast("bigint"))
    many = numbered(rows.join(hot.frame, hot.same(), "left_semi"), [F.col(c) for c in (*hot.keys, seq)], "_number")
    return ordinary.unionByName(many.withColumn("_block", seq_block("_number", block_rows) + 1).drop("_number"))


def seq_block(seq: str, block_rows: int = BLOCK_ROWS) -> Column:
    """Block number of a dense unique sequence: no block holds more than ``block_rows`` rows."""
    return F.floor(F.col(seq) / F.lit(block_rows)).cast("bigint")


def numbered(df: DataFrame, order: list[Column], name: str, purpose: str = "numbered") -> DataFrame:
    """Add the gapless position, from 0, of every row in the whole order.

    Ranges of the order tuple go to tasks, whatever its types and however close its values are; each range
    counts its rows, the sums of the ranges before are added. The rows are written once, so that
    counts and positions come from the same ranges also when a task is repeated.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        purpose,
    )
    # the id holds the number of the range in its upper bits, the place inside the range in the lower ones
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # as many rows as shuffle partitions
        .withColumn(name, F.col("_before") + place)
        .drop("_part", "_before", "_at")
    )


_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    block: Column,
    outputs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running sum / max / min of each key in ``order``, scanned block by block.

    ``block`` must not decrease along ``order``, where it is NULL the row comes first.
    ``inclusive=False`` leaves the row itself out. NULL keys are one key.
    """
    staged = df.withColumn("_block", F.coalesce(block, F.lit(FIRST_BLOCK)))
    for name, (_, value) in outputs.items():
        staged = staged.withColumn(f"_v_{name}", value)

    totals = staged.groupBy(*keys, "_block").agg(
        *[_MERGE[kind](f"_v_{name}").alias(f"_t_{name}") for name, (kind, _) in outputs.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = [*keys, "_block"]
    carry = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(parts)],
        *[_MERGE[kind](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in outputs.items()],
    )

    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(parts)]
    scanned = staged.join(carry, same)
    for name, (kind, _) in outputs.items():
        local = _MERGE[kind](f"_v_{name}").over(inside)
        carried = F.col(f"_c_{name}")
        if kind == "sum":
            merged = F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
        else:
            merged = (F.greatest if kind == "max" else F.least)(local, carried)
        scanned = scanned.withColumn(name, merged)
    spare = [f"_{p}_{name}" for name in outputs for p in "vc"]
    return scanned.drop("_block", *[f"_k{i}" for i in range(len(parts))], *spare)


def rank_rows(
    df: DataFrame, keys: list[str], order: list[Column], block: Column, name: str = "rank"
) -> DataFrame:
    """Gap-free 1-based position of each row within its key."""
    ranked = running(df, keys, order, block, {name: ("sum", F.lit(1).cast("bigint"))})
    return ranked.withColumn(name, F.col(name).cast("bigint"))


def running_numbered(
    df: DataFrame, keys: list[str], order: list[str], outputs: dict[str, tuple[str, Column]],
    block_rows: int = BLOCK_ROWS, inclusive: bool = True,
) -> DataFrame:
    """:func:`running` for any order: blocks are cut by position in it, so none holds more than ``block_rows`` rows."""
    placed = numbered(df, [F.col(c) for c in order], "_number")
    return running(placed, keys, [F.col("_number")], seq_block("_number", block_rows), outputs, inclusive).drop("_number")


def rank_numbered(
    df: DataFrame, keys: list[str], order: list[str], name: str = "rank", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """:func:`rank_rows` for any order."""
    ranked = running_numbered(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, block_rows)
    return ranked.withColumn(name, F.col(name).cast("bigint"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as an aggregate with map-side combine.

    No window: a hot key is reduced before it is shuffled.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(
        *[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns]
    )
