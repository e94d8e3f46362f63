"""Load metrics against published measurements, and exact percentiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicelake.operators import audit, metrics, ordering

MIB = 1048576
# fixed values: measured loads of one benchmark series (label, bytes, rows, seconds)
MEASURED = [
    ("500MiB", 524288491, 985920, 33.474402), ("1GiB", 1073742000, 2017031, 69.076), ("2GiB", 2147484000, 4031976, 137.089),
    ("5GiB", 5368709500, 10076665, 343.368),
]


def measured(spark):
    rows = [(label, size, n, seconds * 1000) for label, size, n, seconds in MEASURED]
    frame = spark.createDataFrame(rows, "label string, file_bytes bigint, rows bigint, duration_ms double")
    start = F.lit("2026-07-19 14:11:06").cast("timestamp_ntz")
    return metrics.load_rates(
        frame.withColumns({"event_time": start, "received_at": start + F.expr("INTERVAL 8 SECONDS"), "completed_at": start + F.expr("INTERVAL 42 SECONDS")})
    )


def test_rates(spark):
    first = measured(spark).where("label = '500MiB'").first()
    assert first["throughput_mib_per_second"] == pytest.approx(14.936800611227925)
    assert first["seconds_per_100_rows"] == pytest.approx(0.0033952452531645573)
    assert first["delivery_latency_seconds"] == 8.0 and first["end_to_end_seconds"] == 42.0


def test_regression_and_projection(spark):
    fit = metrics.fit_duration(measured(spark)).first()
    assert round(fit["slope"], 6) == pytest.approx(0.067038, abs=3e-6)
    assert round(fit["intercept"], 2) == pytest.approx(0.08, abs=0.02)
    assert round(fit["r2"], 6) == pytest.approx(0.999996, abs=2e-6)
    scenarios = spark.createDataFrame([("wide", 14.917), ("narrow", 4.570)], "scenario string, mib_per_second double")
    found = {(r["scenario"], r["budget"]): round(r["max_gib"], 2) for r in metrics.project_capacity(scenarios).collect()}
    assert found[("wide", "detached hard")] == 52.44 and found[("wide", "sync 80%")] == 3.5
    assert found[("narrow", "detached hard")] == 16.07 and found[("narrow", "detached 80%")] == 12.85


def test_comparison(spark):
    schema = "case string, duration double, mib_per_second double"
    old = spark.createDataFrame([("5GiB", 1408.743, 3.634)], schema)
    new = spark.createDataFrame([("5GiB", 1120.274, 4.570)], schema)
    row = metrics.compare_runs(old, new, ["case"], ["duration", "mib_per_second"]).first()
    assert round(row["duration_change_pct"], 2) == -20.48 and round(row["mib_per_second_change_pct"], 2) == pytest.approx(25.77, abs=0.02)


@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.95, 1.0])
def test_exact_percentile(spark, fraction):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=997), "b": rng.integers(0, 5, size=400).astype(float), "c": np.array([3.5]), "d": np.array([1.0, 2.0])}
    frame = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "k string, v double")
    found = {r["k"]: r["p"] for r in metrics.exact_percentile(frame, ["k"], "v", fraction, "p").collect()}
    assert found == pytest.approx({k: float(np.quantile(v, fraction)) for k, v in values.items()})


def test_invocation_summary(spark):
    log = spark.createDataFrame(
        [("r1", "2026-01-01T00:00:02Z", "Served function invocation request in 5 ms"), ("r1", "2026-01-01T00:00:00Z", metrics.RECEIVED),
         ("r1", "2026-01-01T00:00:01Z", "b\tline"), ("r1", "2026-01-01T00:00:00.5Z", "a"), ("r2", "2026-01-01T01:00:00Z", metrics.RECEIVED), ("r3", None, None)],
        "request_id string, time string, message string",
    )
    first, second, third = metrics.invocation_summary(log).collect()
    assert second["request_id"] == "r1" and second["function_output"] == "a | b line" and second["completed"] == "2026-01-01T00:00:02Z"
    assert first["request_id"] == "r2" and first["completed"] == ""
    assert third["started"] == "" and third["function_output"] == ""


def test_lifecycle_link_falls_back_null_safely(spark):
    raw = spark.createDataFrame(
        [(1, "x.createobject", "b", "f", None, None), (2, "x.createobject", None, "g", None, "SYNC"), (3, "x.other", "b", "f", None, None), (4, "x.deleteobject", "b", "f", None, None)],
        "id bigint, event_type string, bucket_name string, resource_name string, completed_at timestamp_ntz, invocation_mode string",
    )
    tx = spark.createDataFrame(
        [(10, 1, "b", "f", "CREATE", "ERROR", "2024-01-01", None), (11, 1, "b", "f", "CREATE", "SUCCESS", "2024-01-01", "SYNC"), (12, None, None, "g", "CREATE", "ERROR", "2024-01-02", None),
         (13, None, None, "g", "CREATE", "SUCCESS", "2024-01-01", None)],
        "id bigint, object_event_id bigint, bucket_name string, resource_name string, event_action string, event_status string, created_at string, invocation_mode string",
    )
    errors = spark.createDataFrame([(100, 10), (101, 12), (102, 12)], "id bigint, event_log_id bigint")
    found = {r["id"]: (r["lifecycle_status"], r["error_id"], r["invocation_mode"]) for r in audit.link_lifecycle(raw, tx, errors).collect()}
    assert found == {1: ("SUCCESS", None, "SYNC"), 2: ("ERROR", 102, "UNKNOWN"), 3: ("RECEIVED", None, "UNKNOWN"), 4: ("RECEIVED", None, "UNKNOWN")}


def test_manifest(spark):
    manifest = spark.createDataFrame(
        [("d", 1, 2, 5, "a"), ("d", 2, 2, 6, "b"), ("e", 1, 2, 5, "a"), ("f", 1, 1, 9, "a")], "dataset string, chunk int, chunks int, rows int, resource_name string"
    )
    outcomes = spark.createDataFrame([("a", "SUCCESS", 5), ("b", "SUCCESS", 6)], "resource_name string, event_status string, loaded_rows int")
    found = {r["dataset"]: r["complete"] for r in ordering.manifest_status(manifest, outcomes).collect()}
    assert found == {"d": True, "e": False, "f": False}


def test_running_keeps_null_keys_and_times(spark):
    """NULL keys are one key; NULL times come first and are a block of their own."""
    import datetime

    from slicelake.operators import ordering

    noon = datetime.datetime(2024, 1, 1, 12)
    given = [(1, "a", noon), (2, "a", None), (3, None, noon), (4, None, None), (5, None, noon + datetime.timedelta(hours=1))]
    df = spark.createDataFrame([(i, lane, t, t) for i, lane, t in given], "id bigint, lane string, event_time timestamp, received_at timestamp")
    assert {r["id"]: r["lane_position"] for r in ordering.lane_order(df).collect()} == {1: 2, 2: 1, 3: 2, 4: 1, 5: 3}
    assert ordering.grace_flags(df, 5).count() == 5
    assert ordering.head_of_line(df.withColumn("status", F.lit("RECEIVED"))).where("blocked").count() == 3
