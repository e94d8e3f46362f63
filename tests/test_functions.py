"""Column functions against known examples and against plain Python."""

import datetime
import decimal
import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from slicelake.functions import events as ev
from slicelake.functions import names
from slicelake.operators import profile, quality, routing
from slicelake.sinks import export


def column(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("v"))).collect()]


def test_event_types(spark):
    kinds = [f"com.oraclecloud.objectstorage.{k}" for k in ("createobject", "updateobject", "deleteobject", "UpdateObject")]
    assert column(spark, kinds, ev.event_action) == ["CREATE", "UPDATE", "DELETE", "UPDATE"]
    assert column(spark, ["restoreobject", None], lambda c: ev.event_action(c, "UNKNOWN")) == ["UNKNOWN"] * 2


def test_mode_snapshot_beats_mapping_mode(spark):
    frame = spark.sql("SELECT * FROM VALUES ('DETACHED', 'SYNC'), (NULL, 'SYNC'), (NULL, NULL) t(a, b)")
    found = [r[0] for r in frame.select(ev.mode_snapshot(F.col("a"), F.col("b"))).collect()]
    assert found == ["DETACHED", "SYNC", "UNKNOWN"]


def test_raw_lifecycle(spark):
    assert column(spark, ["x", None], ev.raw_lifecycle) == ["COMPLETED", "RECEIVED"]


def test_iso_time_matches_python(spark):
    texts = [
        "2024-01-02", "2024-01-02T03:04:05", "2024-01-02 03:04", "2024-01-02T03:04:05.123456Z", "2024-01-02T03:04:05+02:00",
        "2024-01-02T03:04:05.5-0530", "2024-02-30", "2024-13-01", "soon", "", "2024-01-02T25:00", "2024", "2024-01-02T03",
        "2024-01-02T03:04:05,25", "20240102x", "2024-01-02T03:04:60",
    ]

    def python(text):
        try:
            value = datetime.datetime.fromisoformat(text.replace("Z", "+00:00"))
        except ValueError:
            return None
        if value.tzinfo is None:
            return value
        return value.astimezone(datetime.timezone.utc).replace(tzinfo=None)

    assert column(spark, texts, ev.iso_timestamp) == [python(t) for t in texts]


GLOBS = [
    "feed/*", "feed/eu/*.csv", "feed/US/user-?.csv", "feed/[eU]*/*1*.csv", "[!a]*", "[]x]*", "[!]x]y", "a[b", "*", "?", "", "a.c",
    "a+b*", "[a-c]?*", "x{1}", "**", "a**b", "(a|b)", "[^a]*", "a\\b*", "feed/*/x*y", "*a", "a*", "a*a", "[&&a]*", "é*",
    "[z-a]", "[!z-a]*", "[a-c-e]*", "[-a]*", "[a-]*", "[b-a]b", "[!b-a]b", "[--a]*", "[a-cz-x]bc", "[", "[]", "[!]", "a]",
]
NAMES = [
    "feed/eu/user-1.csv", "feed/US/user-1.csv", "feed/US/user-12.csv", "feed/", "a", "b", "", "a.c", "abc", "a+bc", "a[b", "]", "xy", "]y",
    "x{1}", "a\nb", "feed/a\nb.csv", "(a|b)", "^abc", "a\\bc", "feed/q/xay", "aa", "a*a", "&z", "été", "ay",
]


def test_globs_match_like_fnmatch(spark):
    pairs = [(p, n) for p in GLOBS for n in NAMES]
    frame = spark.createDataFrame(pairs, "p string, n string").withColumn("r", names.glob_regex(F.col("p")))
    parts = frame.select("*", *names.glob_parts(F.col("p")))
    found = parts.select(
        "p", "n", names.glob_match(F.col("n"), F.col("r")).alias("whole"),
        names.parts_match(F.col("n"), F.col("prefix"), F.col("suffix"), F.col("regex")).alias("parts"),
    ).collect()
    wrong = [tuple(r) for r in found if not (r["whole"] == r["parts"] == fnmatch.fnmatchcase(r["n"], r["p"]))]
    assert wrong == []


def test_route_prefers_longest_pattern_and_lowest_id(spark, rows):
    mapping = spark.createDataFrame(
        [
            (7, "HWDemo", "test-bucket", "sync-folder/emp*.csv", "fntestdb", "employees", "SYNC", 4),
            (8, "HWDemo", "test-bucket", "*", "fntestdb", "rest", None, None),
            (9, "HWDemo", "test-bucket", "sync-folder/emp*.csv", "fntestdb", "copy", "SYNC", 4),
            (3, "HWDemo", "test-bucket", "sync-folder/emp9.csv", "fntestdb", "nine", "SYNC", 4),
        ],
        "id bigint, compartment_name string, bucket_name string, resource_name_pattern string, target_database string, "
        "target_table string, invocation_mode string, worker_threads int",
    )
    events = spark.createDataFrame(
        [(1, "HWDemo", "test-bucket", "sync-folder/emp1.csv"), (2, "HWDemo", "test-bucket", "x"), (3, "hwdemo", "test-bucket", "x"),
         (4, "HWDemo", "test-bucket", "sync-folder/emp9.csv")],
        "object_event_id bigint, compartment_name string, bucket_name string, resource_name string",
    )
    want = [(1, 7, "SYNC", 4), (2, 8, "SYNC", 4), (3, None, None, None), (4, 3, "SYNC", 4)]
    for options in ({}, {"join_form": True}, routing.strategy(mapping)):
        routed = routing.route(events, mapping, **options)
        assert rows(routed.select("object_event_id", "mapping_id", "mapping_mode", "worker_threads")) == want
    assert rows(routing.pattern_conflicts(mapping).select("id", "conflict_id")) == [(7, 9), (9, 7)]


def test_prefix_and_folder(spark):
    patterns = ["testing/new-folder/*.csv", "a/*/b.csv", "plain.csv", "*", "x/y?z", "a/b/c"]
    assert column(spark, patterns, names.static_prefix) == ["testing/new-folder/", "a/", "plain.csv", "", "x/y", "a/b/c"]
    assert column(spark, patterns, names.default_folder) == ["testing/new-folder", "", "", "", "x", "a/b"]


def test_object_path(spark):
    frame = spark.createDataFrame(
        [("testing/new-folder", "e.csv"), ("wrong-folder", "e.csv"), ("../x", "e.csv"), ("testing/new-folder/", "e f.txt")], "f string, n string"
    )
    regex = names.glob_regex(F.lit("testing/new-folder/*.csv"))
    found = frame.select(names.object_path(F.col("f"), F.col("n")), names.object_path_findings(F.col("f"), F.col("n"), regex)).collect()
    assert [tuple(r) for r in found] == [
        ("testing/new-folder/e.csv", []),
        ("wrong-folder/e.csv", ["outside the pattern"]),
        ("../x/e.csv", ["unsafe folder", "outside the pattern"]),
        ("testing/new-folder/e_f.txt", ["not a csv file", "outside the pattern"]),
    ]


def test_headers_and_table_names(spark):
    headers = ["  First Name ", "2nd", "", "__", "Straße", "a--b__c"]
    assert column(spark, headers, names.sanitize_header) == ["first_name", "column_2nd", "column", "column", "stra_e", "a_b_c"]
    files = ["dir/Sales_001.csv", "x/2024 report.csv", "plain", ".csv", "a.b.c"]
    assert column(spark, files, names.table_from_filename) == ["sales", "table_2024_report", "plain", "table", "a_b"]


def test_identifiers(spark):
    values = ["a", "a" * 64, "a" * 65, "1a", "a-b", "a\n", None]
    assert column(spark, values, names.is_identifier) == [True, True, False, False, False, False, False]


def test_strip_matches_python(spark):
    values = ["  x ", "\t x\n", " x ", "\x1cx\x1f", "x", "​x", "", " \t ", "﻿x"]
    assert column(spark, values, names.strip) == [v.strip() for v in values]


def test_export_guard(spark):
    assert column(spark, ["=1", "+1", "-1", "@x", " =", "x", None, ""], export.guard) == ["'=1", "'+1", "'-1", "'@x", " =", "x", "", ""]


def fits(parse):
    def test(text):
        try:
            parse(text)
        except (ValueError, ArithmeticError):
            return False
        return True

    return test


# the inference rule, said in Python: the first kind all cells fit
KINDS = {
    "BIGINT": re.compile(r"[-+]?\d+").fullmatch,
    "DECIMAL(38, 10)": fits(decimal.Decimal),
    "DATETIME": fits(datetime.datetime.fromisoformat),
}


def python_type(values):
    cells = list(filter(None, map(str.strip, values)))
    for kind, test in KINDS.items():
        if cells and all(map(test, cells)):
            return kind
    longest = max(map(len, cells), default=9999)
    return f"VARCHAR({longest})" if longest <= 1024 else "TEXT"


def test_type_inference_matches_python(spark):
    words = [
        "1", "-2", "+3", "1.5", ".5", "5.", "1e5", "1_000", "NaN", "Infinity", "-inf", "sNaN12", "1.2.3", "e5", "2024-01-01",
        "2024-01-01T10:00:00", "2024-01-01 10:00:00+02:00", "2024-02-30", "x", "", "  ", "y" * 1025, "12:30", "0x1", "--1", "1e", "$5",
    ]
    rng = random.Random(7)
    columns = {f"c{i}": [w] for i, w in enumerate(words)}
    for i in range(60):
        columns[f"m{i}"] = [rng.choice(words) for _ in range(3)]
    height = 3
    data = [tuple((v * height)[:height][k] if len(v) == 1 else v[k] for v in columns.values()) for k in range(height)]
    frame = spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns))
    found = {r["column"]: r["type"] for r in profile.infer_types(frame, list(columns)).collect()}
    assert found == {c: python_type(v) for c, v in columns.items()}
    assert profile.infer_types(frame.select("c14"), ["c14"], prefer_date=True).first()["type"] == "DATE"


@pytest.mark.parametrize(
    "form, reasons",
    [
        ({}, []),
        ({"worker_threads": "0"}, ["Worker threads must be from 1 to 64."]),
        ({"worker_threads": "65"}, ["Worker threads must be from 1 to 64."]),
        ({"worker_threads": "invalid"}, ["Worker threads must be a whole number from 1 to 64."]),
        ({"bucket_name": " "}, ["Bucket name is required."]),
        ({"target_table": "..perf", "invocation_mode": "detached"}, []),
        ({"target_table": "1perf"}, ["Invalid target table."]),
    ],
)
def test_mapping_form(spark, form, reasons):
    base = {
        "id": 1, "compartment_name": "HWDemo", "bucket_name": "test-bucket", "resource_name_pattern": "performance/*.csv",
        "target_database": "fntestdb", "target_table": "perf_t_001", "invocation_mode": "SYNC", "worker_threads": "4",
    }
    frame = spark.createDataFrame([tuple({**base, **form}.values())], ", ".join(f"{k} {'int' if k == 'id' else 'string'}" for k in base))
    assert quality.normalize_mapping(frame).first()["reasons"] == reasons


def test_feed_condition(spark):
    frame = spark.createDataFrame([("dept", "b", "detached-folder/emp*.csv"), ("", "b", "x")], "compartment_name string, bucket_name string, resource_name_pattern string")
    first, second = [r[0] for r in frame.select(routing.feed_condition_json(frame)).collect()]
    types = ",".join(f'"{t}"' for t in routing.EVENT_TYPES)
    assert first == f'{{"eventType":[{types}],"data":{{"compartmentId":"dept","resourceName":"detached-folder/emp*.csv","additionalDetails":{{"bucketName":"b"}}}}}}'
    assert "compartmentId" not in second
