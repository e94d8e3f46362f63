"""The set-based folds against row-by-row models on random histories."""

import datetime
import random

from pyspark.sql import functions as F

from slicelake import schemas
from slicelake.operators import lifecycle, skew
from slicelake.operators.lifecycle import SOURCE
from slicelake.streaming.state import step

EVENT = (
    "mapping_id bigint, bucket_name string, resource_name string, target_database string, target_table string, "
    "seq bigint, action string, ok boolean"
)


def history(seed, sources=40, events=600, hot_share=0.4):
    rng = random.Random(seed)
    out = []
    for seq in range(events):
        s = 0 if rng.random() < hot_share else rng.randrange(sources)
        action = rng.choice(["CREATE", "UPDATE", "DELETE", "UPDATE"])
        out.append((1 + s % 2, "b", f"f{s}", "mart", f"t{s % 2}", seq, action, rng.random() < 0.7))
    return out


def model(events):
    state, out = {}, {}
    for mapping, bucket, name, _, _, seq, action, ok in events:
        before, visible = state.get(name, ("ABSENT", None))
        # the first CREATE registers the source even if its load fails
        after, visible, success = step(before, visible, seq, action, ok)
        state[name] = (after, visible)
        out[seq] = (before, after, success, visible)
    return out


def folded(frame):
    return {
        r["seq"]: (r["prev_state"], r["state"], r["success"], r["visible_seq"])
        for r in frame.select("seq", "prev_state", "state", "success", "visible_seq").collect()
    }


def test_fold_matches_model(spark):
    for seed in range(3):
        events = history(seed)
        frame = spark.createDataFrame(events, EVENT)
        want = model(events)
        assert folded(lifecycle.fold_lifecycle(frame)) == want
        # every source above 20 events in blocks
        assert folded(lifecycle.fold_lifecycle(frame, min_hot_rows=20, block_rows=16)) == want


def test_fold_of_bursts_in_blocks_of_equal_size(spark):
    """Numbers with a gap of 10^12 in the middle, all sources hot: no block holds more rows than asked."""
    events = [(*e[:5], e[5] if e[5] < 450 else e[5] + 10**12, *e[6:]) for e in history(11, sources=5, events=900)]
    frame = spark.createDataFrame(events, EVENT)
    hot = skew.find_hot(frame, SOURCE, min_rows=50)
    assert hot.frame.count() >= 4
    sizes = skew.with_block(frame, hot, "seq", 64).where("_block > 0").groupBy("_block").count().collect()
    assert max(r["count"] for r in sizes) == 64 and len(sizes) >= 10
    assert folded(lifecycle.fold_lifecycle(frame, hot=hot, block_rows=64)) == model(events)


def test_more_hot_keys_than_a_driver_should_hold(spark):
    frame = spark.range(12_000).select((F.col("id") % 3000).alias("k"), "id")
    hot = skew.find_hot(frame, ["k"], min_rows=4)
    assert hot.frame.count() == 3000
    placed = skew.with_block(frame, hot, "id", 500)
    assert placed.count() == 12_000 and placed.where("_block = 0").isEmpty()
    assert not skew.find_hot(frame, ["k"], min_rows=5)


def registry_rows(spark, frame, batches):
    rows = lifecycle.with_batches(frame, batches)
    schema = schemas.CONTROL["source_object_batches"]
    last = lifecycle.last_states(rows).select(
        *SOURCE, "target_database", "target_table", F.col("slice_batch").alias("batch_num"), F.lit("k").alias("source_key"),
        F.lit("v").alias("object_version"), F.col("state").alias("lifecycle_state"), F.col("visible_seq").alias("visible_attempt"),
        F.col("seq").alias("last_seq"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )
    # cut lineage, as a committed registry does
    return spark.createDataFrame(last.select(*schema.names).collect(), schema)


def test_batches_split_anywhere_give_the_same_result(spark):
    events = history(5, events=400)
    want = model(events)
    whole = spark.createDataFrame(events, EVENT)
    numbers = {(r["mapping_id"], r["resource_name"]): r["batch_num"] for r in lifecycle.allocate_batches(whole).collect()}
    registry = spark.createDataFrame([], schemas.CONTROL["source_object_batches"])
    got = {}
    for low, high in ((0, 90), (90, 250), (250, 400)):
        part = spark.createDataFrame(events[low:high], EVENT)
        for options in ({}, {"min_hot_rows": 10, "block_rows": 8}):
            frame = lifecycle.fold_lifecycle(part, registry, **options)
            got.update(folded(frame))
            assert {k: got[k] for k in range(low, high)} == {k: want[k] for k in range(low, high)}
        batches = lifecycle.allocate_batches(part, registry, block_rows=16)
        found = {(r["mapping_id"], r["resource_name"]): r["batch_num"] for r in batches.collect()}
        changed = registry_rows(spark, frame, batches)
        merged = lifecycle.merge_registry(registry, changed).collect()
        registry = spark.createDataFrame(merged, schemas.CONTROL["source_object_batches"])
    assert found == numbers


def test_batch_numbers_are_dense_per_target(spark):
    frame = spark.createDataFrame(history(3), EVENT)
    for block in (1 << 20, 8):
        rows = lifecycle.allocate_batches(frame, block_rows=block).collect()
        for target in ("t0", "t1"):
            numbers = sorted(r["batch_num"] for r in rows if r["target_table"] == target)
            assert numbers == list(range(1, len(numbers) + 1))


def test_running_equals_window(spark):
    from pyspark.sql import Window

    frame = spark.range(500).select((F.col("id") % 3).alias("k"), "id", ((F.col("id") * 37) % 101).alias("x"))
    w = Window.partitionBy("k").orderBy("id")
    for inclusive, end in ((True, 0), (False, -1)):
        frames = w.rowsBetween(Window.unboundedPreceding, end)
        want = frame.select("id", F.coalesce(F.sum("x").over(frames), F.lit(0)), F.max("x").over(frames), F.min("x").over(frames))
        got = skew.running(
            frame, ["k"], [F.col("id")], skew.seq_block("id", 32),
            {"s": ("sum", F.col("x")), "a": ("max", F.col("x")), "b": ("min", F.col("x"))}, inclusive,
        ).select("id", "s", "a", "b")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
