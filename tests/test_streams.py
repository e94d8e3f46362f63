"""Streaming forms against their batch forms."""

import os

from pyspark.sql import functions as F

from slicelake.operators import lifecycle, metrics, ordering
from slicelake.operators.lifecycle import SOURCE
from slicelake.sources import records
from slicelake.streaming.state import lifecycle_stream
from test_lifecycle import EVENT, history


def test_keyed_state_over_micro_batches(spark, tmp_path, rows):
    frame = spark.createDataFrame(history(4, events=300), EVENT).select(*SOURCE, "seq", "action", "ok")
    source = str(tmp_path / "events")
    for i in range(3):
        part = frame.where((F.col("seq") >= i * 100) & (F.col("seq") < (i + 1) * 100))
        part.coalesce(1).write.mode("append").parquet(source)
        # oldest file first
        for name in os.listdir(source):
            if name.endswith(".parquet") and not os.path.exists(f"{tmp_path}/{name}.seen"):
                os.utime(f"{source}/{name}", (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
                open(f"{tmp_path}/{name}.seen", "w").close()
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    (
        lifecycle_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    )
    columns = ["seq", "action", "prev_state", "state", "success", "visible_seq"]
    got = rows(spark.read.parquet(str(tmp_path / "out")).select(*columns))
    assert got == rows(lifecycle.fold_lifecycle(frame).select(*columns))


def test_stream_deduplication(spark, tmp_path):
    data = [(i % 40, "v", "CREATE", f"2024-01-01 00:{i % 40:02d}:00") for i in range(100)]
    schema = "event_id bigint, version string, action string, event_time timestamp"
    frame = spark.createDataFrame(data, "event_id bigint, version string, action string, t string").select(
        "event_id", "version", "action", F.col("t").cast("timestamp").alias("event_time")
    )
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = (
        ordering.dedup_events(stream, ("event_time", "1 hour")).writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40 == ordering.dedup_events(frame).count()


def test_streamed_rates(spark, tmp_path, rows):
    frame = spark.range(600).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("created_at"), F.lit("mart").alias("target_database"),
        F.concat(F.lit("t"), F.col("id") % 2).alias("target_table"),
        F.when(F.col("id") % 5 == 0, "ERROR").otherwise("SUCCESS").alias("event_status"),
    )
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = (
        metrics.event_rates(stream, "1 hour", "0 seconds").writeStream.format("memory").queryName("rates")
        .outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    want = rows(metrics.event_rates(frame, "1 hour"))
    got = rows(spark.table("rates"))
    assert set(got) <= set(want) and len(got) >= len(want) - 2  # the last window is still open


def test_an_object_may_fill_whole_batches(spark, tmp_path):
    """Batches of 10,000 rows: the second and the last begin no object."""
    from slicelake.plans.streams import write_objects

    path = f"{tmp_path}/objects/long.csv"
    rows = spark.range(25_000).select(F.lit(path).alias("path"), F.col("id").cast("string").alias("a"))
    assert write_objects(rows, "path", ["a"]) == 1
    with open(path) as file:
        assert sorted(file.read().split()) == sorted(["a", *map(str, range(25_000))])


def test_paths_are_listed_by_few_tasks(spark, tmp_path):
    """Not by one task for each, of which an ingest of many objects had 10,000 for every read."""
    paths = [f"{tmp_path}/{i}.csv" for i in range(150)]
    for path in paths:
        with open(path, "w") as file:
            file.write("a\n1\n")
    spark.sparkContext.setJobGroup("listing", "")
    try:
        assert records.path_table(spark, paths).count() == 150
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    seen = spark.sparkContext.statusTracker()
    stages = [s for job in seen.getJobIdsForGroup("listing") for s in seen.getJobInfo(job).stageIds]
    tasks = [seen.getStageInfo(s).numTasks for s in stages if seen.getStageInfo(s)]
    assert len(tasks) > 1 and max(tasks) <= 64
