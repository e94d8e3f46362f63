"""Slice states, visible versions and batch numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from slicelake.functions import events as ev
from slicelake.operators import skew

SOURCE = ["mapping_id", "bucket_name", "resource_name"]
TARGET = ["target_database", "target_table"]
LEASE_SECONDS = 120
STALE_LOADING_SECONDS = 600

# The texts the audit log shows.
ALREADY_ACTIVE = "This object already has an active batch; use the update scenario for a replacement."
NO_BATCH = "No batch exists for this object; run the create scenario first."
ABSENT_DELETE = "Object batch already absent."
TRUNCATED = "Truncated mapped batch partition."
NO_MAPPING = "No Resource Mappings entry matches this compartment, bucket, and resource name."
UNSUPPORTED = "Unsupported Object Storage event type."
IMPURE = "Stage table contains a row with an unexpected batch number."
IN_PROGRESS = "This source object already has a load in progress."
DELETE_IN_PROGRESS = (
    "This source object has a load in progress; retry the delete after it completes or is recovered."
)


class _Facts:
    """What the past of a source says about it: three values that merge left to right.

    ``first``: its first CREATE. ``last``: its last event that fixes a state, with that
    state. ``failed``: its last CREATE whose load failed.
    """

    def __init__(self, first: Column, last: Column, failed: Column):
        self.first, self.last, self.failed = first, last, failed

    def then(self, later: "_Facts") -> "_Facts":
        return _Facts(
            F.coalesce(self.first, later.first),
            F.coalesce(later.last, self.last),
            F.coalesce(later.failed, self.failed),
        )

    def over(self, window) -> "_Facts":
        return _Facts(
            F.min(self.first).over(window), F.max(self.last).over(window), F.max(self.failed).over(window)
        )

    def state(self) -> Column:
        # a mark set before the first CREATE belongs to an event that was refused
        valid = self.last["seq"] >= self.first
        mark = F.when(valid, self.last["state"])
        return (
            F.when(self.first.isNull(), "ABSENT")
            .when(mark == "ACTIVE", "ACTIVE")
            .when(self.failed > F.coalesce(F.when(valid, self.last["seq"]), F.lit(-2)), "ERROR")
            .otherwise(mark)
        )


def _mark(seq: Column, state) -> Column:
    return F.struct(seq.cast("bigint").alias("seq"), state.alias("state"))


def _known(exists: Column, state: Column) -> _Facts:
    """Facts standing for a source already in ``state``, older than every event (seq -1)."""
    minus = F.lit(-1).cast("bigint")
    return _Facts(
        F.when(exists, minus), F.when(exists, _mark(minus, state)), F.lit(None).cast("bigint")
    )


def _own(action: Column, ok: Column, seq: Column) -> _Facts:
    load = action.isin("CREATE", "UPDATE")
    state = (
        F.when(load & ok, "ACTIVE")
        .when(action == "UPDATE", "ERROR")
        .when(action == "DELETE", "DELETED")
    )
    return _Facts(
        F.when(action == "CREATE", seq),
        F.when(state.isNotNull(), _mark(seq, state)),
        F.when((action == "CREATE") & ~ok, seq),
    )


def _success(action: Column, ok: Column, before: Column) -> Column:
    return (
        F.when(action == "CREATE", (before != "ACTIVE") & ok)
        .when(action == "UPDATE", (before != "ABSENT") & ok)
        .otherwise(F.lit(True))
    )


def _published(action: Column, ok: Column, seq: Column, before: Column) -> Column:
    """The version an event makes visible, -1 where it empties the slice, NULL if no change."""
    return F.when(action == "DELETE", F.lit(-1).cast("bigint")).when(_success(action, ok, before), seq)


# What may be known about a source when a block of its events begins.
_ENTRIES = {"absent": (False, "ACTIVE"), "active": (True, "ACTIVE"), "other": (True, "DELETED")}


def fold_lifecycle(
    events: DataFrame,
    registry: DataFrame | None = None,
    hot: skew.HotKeys | None = None,
    min_hot_rows: int = skew.MIN_HOT_ROWS,
    block_rows: int = skew.BLOCK_ROWS,
) -> DataFrame:
    """State of each source before and after each of its events, and its visible version.

    ``events``: routed rows with SOURCE, ``seq`` (unique, >= 0, arrival order), ``action``
    and ``ok`` (whether the load works). ``registry``: states left by earlier batches.
    Adds ``prev_state``, ``state``, ``success``, ``visible_seq`` (NULL: slice is empty).

    All running values are maxima, so the fold is a set of windows. Sources holding
    more than ``min_hot_rows`` rows are folded in blocks of ``block_rows``: a block is first
    summarised for each state it could start from, then the right one is carried in.
    """
    if hot is None:
        hot = skew.find_hot(events, SOURCE, min_hot_rows)
    rows = skew.with_block(events, hot, "seq", block_rows)
    action, ok, seq = F.col("action"), F.col("ok"), F.col("seq").cast("bigint")
    own = _own(action, ok, seq)
    inside = Window.partitionBy(*SOURCE, "_block").orderBy("seq")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    past = own.over(earlier)
    rows = rows.withColumns({"_p_first": past.first, "_p_last": past.last, "_p_failed": past.failed})
    local = _Facts(F.col("_p_first"), F.col("_p_last"), F.col("_p_failed"))

    start, carried = _known(F.lit(False), F.lit("ACTIVE")), F.lit(None).cast("bigint")
    if registry is not None:
        known = registry.select(
            *SOURCE, F.col("lifecycle_state").alias("_r_state"), F.col("visible_attempt").alias("_r_visible")
        )
        rows = rows.join(known, SOURCE, "left")
        start, carried = _known(F.col("_r_state").isNotNull(), F.col("_r_state")), F.col("_r_visible")
    if hot:
        entry = _block_entries(rows, start, carried, local)
        rows = rows.join(entry, [*SOURCE, "_block"], "left")
        start = start.then(_Facts(F.col("_e_first"), F.col("_e_last"), F.col("_e_failed")))
        carried = F.coalesce(F.col("_e_visible"), carried)

    before = start.then(local)
    rows = rows.withColumns({"prev_state": before.state(), "state": before.then(own).state()})
    rows = rows.withColumns(
        {
            "success": _success(action, ok, F.col("prev_state")),
            "_published": _published(action, ok, seq, F.col("prev_state")),
        }
    )
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    visible = F.coalesce(F.last("_published", ignorenulls=True).over(upto), carried)
    rows = rows.withColumn("visible_seq", F.when(visible >= 0, visible))
    return rows.select(*events.columns, "prev_state", "state", "success", "visible_seq")


def _block_entries(rows: DataFrame, start: _Facts, visible: Column, local: _Facts) -> DataFrame:
    """What is carried into each block of the hot sources."""
    action, ok, seq = F.col("action"), F.col("ok"), F.col("seq").cast("bigint")
    own = _own(action, ok, seq)
    outcomes = {}
    for name, (exists, state) in _ENTRIES.items():
        assumed = _known(F.lit(exists), F.lit(state)).then(local).state()
        shown = _published(action, ok, seq, assumed)
        outcomes[name] = F.max(F.when(shown.isNotNull(), F.struct(seq, shown.alias("shown"))))
    summary = (
        rows.where(F.col("_block") > 0)
        .groupBy(*SOURCE, "_block")
        .agg(
            F.min(own.first).alias("first"),
            F.max(own.last).alias("last"),
            F.max(own.failed).alias("failed"),
            F.first(start.first).alias("s_first"),
            F.first(start.last).alias("s_last"),
            F.first(visible).alias("s_visible"),
            *[value.alias(f"v_{name}") for name, value in outcomes.items()],
        )
    )
    chain = Window.partitionBy(*SOURCE).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = _Facts(F.col("first"), F.col("last"), F.col("failed")).over(chain)
    base = _Facts(F.col("s_first"), F.col("s_last"), F.lit(None).cast("bigint"))
    entry_state = base.then(carried).state()
    shown = (
        F.when(F.col("_state") == "ABSENT", F.col("v_absent.shown"))
        .when(F.col("_state") == "ACTIVE", F.col("v_active.shown"))
        .otherwise(F.col("v_other.shown"))
    )
    return (
        summary.withColumns(
            {"_e_first": carried.first, "_e_last": carried.last, "_e_failed": carried.failed, "_state": entry_state}
        )
        .withColumn("_e_visible", F.last(shown, ignorenulls=True).over(chain))
        .select(*SOURCE, "_block", "_e_first", "_e_last", "_e_failed", "_e_visible")
    )


def highest_batch(registry: DataFrame) -> DataFrame:
    """Next free batch number of each target."""
    return registry.groupBy(*TARGET).agg(
        (F.coalesce(F.max("batch_num"), F.lit(0)) + 1).cast("bigint").alias("next_batch_num")
    )


def next_batch(registry: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """The same, never below a number already promised in ``sequences``."""
    found = highest_batch(registry)
    if sequences is None:
        return found
    promised = sequences.select(*TARGET, F.col("next_batch_num").alias("_promised"))
    return found.join(promised, TARGET, "full_outer").select(
        *TARGET, F.greatest("next_batch_num", "_promised").alias("next_batch_num")
    )


def allocate_batches(
    events: DataFrame,
    registry: DataFrame | None = None,
    sequences: DataFrame | None = None,
    block_rows: int = skew.BLOCK_ROWS,
) -> DataFrame:
    """One row per source with its ``batch_num``: a source keeps the number of its first CREATE.

    Numbers are positions of first CREATEs within the target, from its next free number on: the
    one in ``sequences``, or above the registry's highest. With ``sequences``, ``registry`` need
    only hold the sources of ``events``.
    """
    fresh = (
        events.where(F.col("action") == "CREATE")
        .groupBy(*SOURCE, *TARGET)
        .agg(F.min("seq").alias("_first"))
    )
    if registry is not None:
        fresh = fresh.join(registry.select(*SOURCE), SOURCE, "left_anti")
    ranked = skew.rank_rows(fresh, TARGET, [F.col("_first")], skew.seq_block("_first", block_rows), "batch_num")
    if registry is None:
        return ranked.drop("_first")
    following = highest_batch(registry) if sequences is None else sequences
    offset = following.withColumn("_base", F.col("next_batch_num") - 1).drop("next_batch_num")
    numbered = ranked.join(offset, TARGET, "left").select(
        *SOURCE, *TARGET, (F.col("batch_num") + F.coalesce("_base", F.lit(0))).alias("batch_num")
    )
    return numbered.unionByName(registry.select(*SOURCE, *TARGET, "batch_num"))


def with_batches(folded: DataFrame, batches: DataFrame) -> DataFrame:
    """Attach ``slice_batch`` (the source's number) and the ``batch_num`` the audit log shows."""
    numbers = batches.select(*SOURCE, F.col("batch_num").alias("slice_batch"))
    logged = (
        F.when((F.col("action") == "CREATE") & (F.col("prev_state") != "ACTIVE"), F.col("slice_batch"))
        .when((F.col("action") == "UPDATE") & (F.col("prev_state") != "ABSENT"), F.col("slice_batch"))
        .when(
            (F.col("action") == "DELETE") & ~F.col("prev_state").isin("ABSENT", "DELETED"),
            F.col("slice_batch"),
        )
    )
    return folded.join(numbers, SOURCE, "left").withColumn("batch_num", logged)


def outcome_message(rows: Column, failure: Column) -> Column:
    """Audit text of a folded event; ``rows`` loaded, or the ``failure`` of its load."""
    action, prev = F.col("action"), F.col("prev_state")
    return (
        F.when((action == "CREATE") & (prev == "ACTIVE"), ALREADY_ACTIVE)
        .when((action == "UPDATE") & (prev == "ABSENT"), NO_BATCH)
        .when((action == "DELETE") & prev.isin("ABSENT", "DELETED"), ABSENT_DELETE)
        .when(action == "DELETE", TRUNCATED)
        .when(F.col("success"), ev.load_message(rows))
        .otherwise(failure)
    )


def last_states(folded: DataFrame) -> DataFrame:
    """Last folded row per source that has a slice: the registry's new rows."""
    return skew.latest_per_key(folded, SOURCE, ["seq"]).where(F.col("state") != "ABSENT")


def merge_registry(registry: DataFrame, changed: DataFrame) -> DataFrame:
    """Upsert ``changed`` (one row per source, registry columns) into the registry.

    A source keeps its target and batch number for life.
    """
    keep = [*TARGET, "batch_num"]
    old = registry.alias("o")
    new = changed.alias("n")
    condition = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in SOURCE]
    both = old.join(new, condition, "full_outer")
    touched = F.col("n.mapping_id").isNotNull()
    return both.select(
        *[
            F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
            if c in keep or c in SOURCE
            else F.when(touched, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
            for c in registry.columns
        ]
    )


def retire(registry: DataFrame, deleted: DataFrame) -> DataFrame:
    """Mark the slices of ``deleted`` sources DELETED with nothing visible."""
    marks = deleted.select(*SOURCE).distinct().withColumn("_gone", F.lit(True))
    live = F.col("_gone") & F.col("lifecycle_state").isin("ACTIVE", "ERROR")
    return (
        registry.join(marks, SOURCE, "left")
        .withColumn("_hit", F.coalesce(live, F.lit(False)))
        .withColumn("lifecycle_state", F.when(F.col("_hit"), "DELETED").otherwise(F.col("lifecycle_state")))
        .withColumn("visible_attempt", F.when(~F.col("_hit"), F.col("visible_attempt")))
        .drop("_gone", "_hit")
    )


def reset_target(registry: DataFrame, database: str, table: str) -> DataFrame:
    """Forget the slices of one target; the audit tables are left alone."""
    return registry.where(~((F.col("target_database") == database) & (F.col("target_table") == table)))


def stale_leases(registry: DataFrame, as_of, seconds: int = LEASE_SECONDS) -> DataFrame:
    """LOADING slices whose age at ``as_of`` reaches the lease (a Column or a timestamp)."""
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    age = F.timestamp_diff("SECOND", F.col("updated_at"), as_of)
    return (
        registry.where(F.col("lifecycle_state") == "LOADING")
        .withColumn("age_seconds", age)
        .where(F.col("age_seconds") >= seconds)
    )
