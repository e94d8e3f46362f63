"""Events to target tables: exact scope, longest matching glob."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slicelake.functions import names

SCOPE = ["compartment_name", "bucket_name"]
ROUTED = {
    "mapping_id": "id",
    "target_database": "target_database",
    "target_table": "target_table",
    "mapping_mode": "invocation_mode",
    "worker_threads": "worker_threads",
}
# Patterns of one scope that are tried row by row; above it the join form is used.
MAX_RULES_PER_SCOPE = 2000
# Mapping rows up to which the table is broadcast on request.
MAX_BROADCAST_RULES = 100_000

EVENT_TYPES = [  # fixed values of the feed rule
    "com.oraclecloud.objectstorage.createobject",
    "com.oraclecloud.objectstorage.updateobject",
    "com.oraclecloud.objectstorage.deleteobject",
]


def rules(mappings: DataFrame) -> DataFrame:
    """Mappings with their regex; the struct sorts longest pattern first, then lowest id."""
    pattern = F.col("resource_name_pattern")
    return mappings.select(
        *SCOPE,
        F.struct(
            (-F.length(pattern)).alias("rank"),
            F.col("id").cast("bigint").alias("id"),
            *names.glob_parts(pattern),
            "target_database",
            "target_table",
            F.coalesce("invocation_mode", F.lit("SYNC")).alias("invocation_mode"),
            F.coalesce("worker_threads", F.lit(4)).alias("worker_threads"),
        ).alias("rule"),
    )


def _matches(name: Column, rule: Column) -> Column:
    return names.parts_match(name, rule["prefix"], rule["suffix"], rule["regex"])


def _scope_condition(left: DataFrame, right: DataFrame, collation: str | None) -> Column:
    tests = []
    for column in SCOPE:
        a, b = left[column], right[f"_{column}"]
        if collation:
            a, b = F.collate(a, collation), F.collate(b, collation)
        tests.append(a == b)
    return tests[0] & tests[1]


def strategy(mappings: DataFrame) -> dict[str, bool]:
    """How ``route`` should treat this mapping table, from its row counts: one small job."""
    sizes = mappings.groupBy(*SCOPE).count().agg(F.sum("count").alias("all"), F.max("count").alias("widest")).first()
    return {
        "small": (sizes["all"] or 0) <= MAX_BROADCAST_RULES,
        "join_form": (sizes["widest"] or 0) > MAX_RULES_PER_SCOPE,
    }


def route(
    events: DataFrame,
    mappings: DataFrame,
    collation: str | None = None,
    join_form: bool = False,
    small: bool = False,
    key: str = "object_event_id",
) -> DataFrame:
    """Each event once, with its winning mapping or NULLs.

    The usual form packs the patterns of a scope into one sorted array, joins on the
    scope and takes the first match: with the mappings broadcast, events are never
    shuffled. Catalyst broadcasts them by its own size estimate; ``small`` says that
    ``strategy`` has counted them, for tables without an estimate. ``join_form`` is for
    tables with very many patterns per scope: matches are joined and reduced per event
    with a combining minimum.
    """
    ruled = rules(mappings).withColumnsRenamed({c: f"_{c}" for c in SCOPE})
    name = events["resource_name"]
    if join_form:
        condition = _scope_condition(events, ruled, collation) & _matches(name, ruled["rule"])
        winners = events.join(ruled, condition).groupBy(events[key]).agg(F.min("rule").alias("_rule"))
        joined = events.join(winners, key, "left")
    else:
        packed = ruled.groupBy(*[f"_{c}" for c in SCOPE]).agg(F.sort_array(F.collect_list("rule")).alias("_rules"))
        packed = F.broadcast(packed) if small else packed
        first = F.slice(F.filter("_rules", lambda r: _matches(F.col("resource_name"), r)), 1, 1)
        # generated, so that the match is evaluated once however often the rule is used
        joined = events.join(packed, _scope_condition(events, packed, collation), "left").select(
            *[events[c] for c in events.columns], F.explode_outer(first).alias("_rule")
        )
    return joined.select(
        *[events[c] for c in events.columns],
        *[F.col(f"_rule.{source}").alias(target) for target, source in ROUTED.items()],
    )


def pattern_conflicts(mappings: DataFrame) -> DataFrame:
    """Mappings that share scope and pattern with another one, and the lowest such other id.

    The two lowest ids of a group answer for every member, so no pairs are formed.
    """
    keys = [*SCOPE, "resource_name_pattern"]
    lowest = mappings.groupBy(*keys).agg(
        F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.max("id").alias("_last")
    ).where(F.col("_n") > 1)
    second = (
        mappings.join(lowest, keys)
        .where(F.col("id") > F.col("_first"))
        .groupBy(*keys)
        .agg(F.first("_first").alias("_first"), F.min("id").alias("_second"))
    )
    return mappings.join(second, keys).select(
        "id",
        *keys,
        F.when(F.col("id") == F.col("_first"), F.col("_second")).otherwise(F.col("_first")).alias("conflict_id"),
    )


def feed_filter(events: DataFrame, compartment: str, bucket: str, pattern: str) -> DataFrame:
    """The events a subscription of one mapping lets through."""
    return events.where(
        F.lower("event_type").isin(EVENT_TYPES)
        & (F.col("compartment_name") == compartment)
        & (F.col("bucket_name") == bucket)
        & names.glob_match(F.col("resource_name"), names.glob_regex(F.lit(pattern)))
    )


def feed_condition_json(mappings: DataFrame) -> Column:
    """The subscription condition of each mapping as JSON; blank members are left out."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.to_json(
        F.struct(
            F.array(*[F.lit(t) for t in EVENT_TYPES]).alias("eventType"),
            F.struct(
                blank("compartment_name").alias("compartmentId"),
                blank("resource_name_pattern").alias("resourceName"),
                F.struct(blank("bucket_name").alias("bucketName")).alias("additionalDetails"),
            ).alias("data"),
        )
    )
