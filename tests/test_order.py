"""Positions in a whole order, and lanes cut into blocks of equal size."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window, functions as F

from slicelake.operators import ordering, paging, skew


@pytest.mark.parametrize("kind", ["bigint", "string", "decimal(20,4)", "double"])
def test_numbered_is_the_position_in_the_order(spark, kind):
    random.seed(3)
    values = [random.choice([None, 7, random.randrange(10**9)]) for _ in range(2000)]
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v bigint, i int")
    frame = frame.select(F.col("v").cast(kind).alias("v"), "i")
    got = {r["i"]: r["n"] for r in skew.numbered(frame, [F.col("v"), F.col("i")], "n").collect()}
    plain = frame.withColumn("n", F.row_number().over(Window.orderBy("v", "i")) - 1)
    assert got == {r["i"]: r["n"] for r in plain.collect()}


def test_numbered_takes_no_rows_and_equal_rows(spark):
    empty = spark.createDataFrame([], "v bigint")
    assert skew.numbered(empty, [F.col("v")], "n").count() == 0
    same = spark.createDataFrame([(1,)] * 50, "v bigint")
    assert sorted(r["n"] for r in skew.numbered(same, [F.col("v")], "n").collect()) == list(range(50))


def test_one_moment_is_cut_into_blocks(spark):
    """All entries of a lane have one time: positions are cut by number, and results equal the plain window."""
    random.seed(5)
    rows = [
        (i, random.choice(["a", "a", "a", "b", None]), random.choice([0, 0, 0, 5]), random.choice([0, 9]), random.choice(["SUCCESS", "RECEIVED"]))
        for i in range(600)
    ]
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, "id bigint, lane string, e bigint, r bigint, status string").select(
        "id", "lane", "status", F.timestamp_seconds("e").alias("event_time"), F.timestamp_seconds("r").alias("received_at")
    )
    order = Window.partitionBy("lane").orderBy("event_time", "received_at", "id")
    arrival = Window.partitionBy("lane").orderBy("received_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    plain = frame.select(
        "id", F.row_number().over(order).alias("p"),
        F.coalesce(F.max("event_time").over(arrival) > F.col("event_time"), F.lit(False)).alias("late"),
        (F.coalesce(F.max((F.col("status") != "SUCCESS").cast("int")).over(before), F.lit(0)) == 1).alias("blocked"),
    )
    want = {r["id"]: (r["p"], r["late"], r["blocked"]) for r in plain.collect()}
    positions = {r["id"]: r["lane_position"] for r in ordering.lane_order(frame, block_rows=32).collect()}
    late = {r["id"]: r["late"] for r in ordering.grace_flags(frame, 1, block_rows=32).collect()}
    blocked = {r["id"]: r["blocked"] for r in ordering.head_of_line(frame, block_rows=32).collect()}
    assert {i: (positions[i], late[i], blocked[i]) for i in want} == want


def test_blocks_hold_no_more_rows_than_asked(spark):
    frame = spark.createDataFrame([(i, Decimal(i % 3)) for i in range(1000)], "i bigint, v decimal(10,0)")
    placed = skew.numbered(frame, [F.col("v"), F.col("i")], "n")
    sizes = placed.groupBy(skew.seq_block("n", 64).alias("b")).count().collect()
    assert max(r["count"] for r in sizes) == 64 and len(sizes) == 16


@pytest.mark.parametrize("kind", ["string", "decimal(20,4)", "bigint", "timestamp_ntz", "double"])
@pytest.mark.parametrize("descending", [True, False])
def test_deep_pages_sort_few_rows(spark, kind, descending):
    """Text, decimals, sparse numbers and times, with NULLs and a value that many rows have."""
    random.seed(9)
    made = {"bigint": "v * 1000000007", "timestamp_ntz": "timestamp_micros(v * 977)", "string": "concat('x', v % 700)"}
    values = [random.choice([None, 5, 5, random.randrange(10**6), random.randrange(10**6)]) for _ in range(3000)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, v bigint").select(
        "id", F.expr(made.get(kind, "v / 7")).cast(kind).alias("v")
    )
    order = [F.desc("v"), F.desc("id")] if descending else [F.asc("v"), F.asc("id")]
    want = [r["id"] for r in frame.orderBy(*order).collect()]
    for number in (1, 40, 75, 1000):
        got, total = paging.page(frame, number, 40, "v", descending, block_rows=100)
        first = (min(number, 75) - 1) * 40
        assert total == 3000 and [r["id"] for r in got.collect()] == want[first : first + 40]
    for low in (0, 1500, 2960):
        rest, before, rows = paging.narrow(frame, ["v", "id"], low, low + 40, 3000, 100)
        assert rest.count() == rows <= 300 and before <= low and low + 40 <= before + rows


def test_pages_of_equal_keys(spark):
    frame = spark.range(500).select(F.lit(1).alias("v"), F.lit(1).alias("id"))
    got, total = paging.page(frame, 3, 7, "v", block_rows=10)
    assert total == 500 and got.count() == 7
    assert paging.page(frame.limit(0), 3, 7, "v")[0].count() == 0
