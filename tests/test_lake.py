"""Publication: atomic, repeatable, complete; and the ingest built on it."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicelake.operators import audit
from slicelake.sinks.lake import REGISTRY, Lake
from slicelake.streaming.ingest import Ingest, Target

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
MAPPING = (
    "id bigint, compartment_name string, bucket_name string, resource_name_pattern string, target_database string, "
    "target_table string, invocation_mode string, worker_threads int"
)


def entry(spark, attempt, load, state="ACTIVE", batch=1, name="f"):
    row = (1, "b", name, "mart", "t", batch, "k", "v", state, attempt, attempt or 0, None, load)
    return spark.createDataFrame([row], REGISTRY)


def staged(spark, values, attempt, batch=1):
    return spark.createDataFrame(values, SCHEMA).select("*", F.lit(batch).cast("bigint").alias("batch_num"), F.lit(attempt).cast("bigint").alias("attempt"))


def test_publish_replace_retire(spark, tmp_path, rows):
    lake = Lake(spark, str(tmp_path / "lake"))
    seen = lambda: rows(lake.visible("mart", "t", SCHEMA))
    assert seen() == [] and lake.registry().count() == 0
    lake.stage(staged(spark, [(1, "a"), (2, "b")], 10), "mart", "t", 0)
    assert seen() == []  # staged, not published: a crash here changes nothing
    lake.commit(entry(spark, 10, 0))
    assert seen() == [(1, "a"), (2, "b")]
    lake.stage(staged(spark, [(3, "c")], 11), "mart", "t", 1)
    assert seen() == [(1, "a"), (2, "b")]
    lake.commit(entry(spark, 11, 1))
    assert seen() == [(3, "c")]
    # a replacement without rows empties the slice
    lake.stage(staged(spark, [], 12), "mart", "t", 2)
    lake.commit(entry(spark, 12, 2))
    assert seen() == []
    lake.stage(staged(spark, [(4, "d")], 13), "mart", "t", 3)
    lake.commit(entry(spark, 13, 3))
    lake.commit(entry(spark, None, None, "DELETED"))
    assert seen() == []
    orphans = lake.attempts("mart", "t")
    assert sorted(r["attempt"] for r in orphans.collect()) == [10, 11, 13]


def test_readers_see_committed_versions_only(spark, tmp_path, rows):
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.stage(staged(spark, [(1, "a")], 1), "mart", "t", 0)
    lake.commit(entry(spark, 1, 0))
    # a writer that died between writing its registry rows and swapping the pointer
    entry(spark, 99, 9).write.mode("overwrite").parquet(f"{lake.root}/registry/v=2")
    assert rows(lake.visible("mart", "t", SCHEMA)) == [(1, "a")]
    lake.stage(staged(spark, [(2, "b")], 2), "mart", "t", 1)
    assert lake.commit(entry(spark, 2, 1)) == 2
    assert rows(lake.visible("mart", "t", SCHEMA)) == [(2, "b")]


def test_compaction_and_cleanup(spark, tmp_path, rows):
    lake = Lake(spark, str(tmp_path / "lake"))
    for i in range(3):
        lake.stage(staged(spark, [(i, "x")], i + 1, batch=i + 1), "mart", "t", i)
        lake.commit(entry(spark, i + 1, i, batch=i + 1, name=f"f{i}"))
    lake.commit(entry(spark, None, None, "DELETED", batch=2, name="f1"))
    before = rows(lake.registry())
    lake.compact()
    assert lake.current()["base"] == lake.current()["version"] and rows(lake.registry()) == before
    assert lake.drop_loads("mart", "t") == [1]
    assert rows(lake.visible("mart", "t", SCHEMA)) == [(0, "x"), (2, "x")]


class World:
    """Objects, messages and a lake in one folder."""

    def __init__(self, spark, root, **options):
        self.spark, self.root = spark, str(root)
        os.makedirs(f"{self.root}/events")
        mapping = spark.createDataFrame(
            [(1, "dept", "b1", "feed/*", "mart", "t", "SYNC", 4), (2, "dept", "b1", "det/*", "mart", "t", "DETACHED", 4),
             (3, "dept", "b1", "lost/*", "mart", "nowhere", "SYNC", 4)],
            MAPPING,
        )
        target = Target("mart", "t", {"id": "bigint", "name": "string", "amount": "decimal(14,2)"}, ("id",), {"name": 5})
        self.lake = Lake(spark, f"{self.root}/lake")
        self.ingest = Ingest(spark, self.lake, mapping, [target], f"{self.root}/objects", **options)
        self.files = 0

    def put(self, name, text):
        path = f"{self.root}/objects/b1/{name}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as out:
            out.write(text)

    def send(self, *events):
        lines = []
        for kind, name, number in events:
            if kind == "raw":
                lines.append(name)
                continue
            body = {
                "eventType": f"com.oraclecloud.objectstorage.{kind}object", "eventTime": f"2024-01-01T00:00:{number:02d}Z",
                "eventID": f"e{number}",
                "data": {"compartmentName": "dept", "resourceName": name, "additionalDetails": {"bucketName": "b1", "eTag": f"t{number}"}},
            }
            lines.append(json.dumps(body))
        self.files += 1
        with open(f"{self.root}/events/{self.files}.json", "w") as out:
            out.write("\n".join(lines) + "\n")

    def run(self):
        self.ingest.run(f"{self.root}/events", f"{self.root}/checkpoint")

    def audit(self):
        log = self.lake.log("event_tx_log").orderBy("created_at", "id").collect()
        return [(r["resource_name"], r["event_action"], r["event_status"], r["batch_num"], r["message"]) for r in log]


@pytest.fixture
def world(spark, tmp_path):
    return World(spark, tmp_path / "w")


def test_ingest(spark, world, rows):
    world.put("feed/a.csv", 'ID,Name,Amount\n1,Ada,1.50\n2,"B,b",2\n')
    world.put("feed/bad.csv", "name,id,amount\nX,one,3\n")
    world.put("feed/long.csv", "name,id,amount\nToo long,1,3\n")
    world.put("feed/twice.csv", "name,id,amount\nX,5,3\nY,5,3\n")
    world.put("feed/head.csv", "name,id\nX,1\n")
    world.put("det/x.csv", "amount,name,id\n7,D,77\n")
    world.send(
        ("create", "feed/a.csv", 1), ("create", "feed/bad.csv", 2), ("create", "feed/long.csv", 3), ("create", "feed/twice.csv", 4),
        ("create", "feed/head.csv", 5), ("create", "feed/gone.csv", 6), ("create", "feed/a.csv", 7), ("update", "feed/new.csv", 8),
        ("restore", "feed/a.csv", 9), ("create", "nomatch", 10), ("create", "lost/a.csv", 11), ("raw", "[1]", 0), ("raw", '{"data": {}}', 0),
        ("create", "det/x.csv", 12), ("delete", "feed/never.csv", 13),
    )
    world.run()
    log = {(r[0], r[1]): r[2:] for r in world.audit() if r[2:] and (r[0], r[1]) != ("feed/a.csv", "CREATE")}
    twice = [r for r in world.audit() if r[0] == "feed/a.csv" and r[1] == "CREATE"]
    assert [r[2:] for r in twice] == [
        ("SUCCESS", 1, "Loaded 2 row(s) by partition exchange."),
        ("ERROR", None, "This object already has an active batch; use the update scenario for a replacement."),
    ]
    assert log[("feed/bad.csv", "CREATE")] == ("ERROR", 2, "Incorrect value for column 'id': one")
    assert log[("feed/long.csv", "CREATE")] == ("ERROR", 3, "Data too long for column 'name'")
    assert log[("feed/twice.csv", "CREATE")] == ("ERROR", 4, "Duplicate entry for a unique key.")
    assert log[("feed/head.csv", "CREATE")] == ("ERROR", 5, "CSV columns do not match target table (missing: amount).")
    assert log[("feed/gone.csv", "CREATE")][:2] == ("ERROR", 6)
    assert log[("feed/new.csv", "UPDATE")] == ("ERROR", None, "No batch exists for this object; run the create scenario first.")
    assert log[("feed/a.csv", "UNKNOWN")] == ("ERROR", None, "Unsupported Object Storage event type.")
    assert log[("nomatch", "CREATE")][0] == "ERROR"
    assert log[("lost/a.csv", "CREATE")] == ("ERROR", None, "Mapped target table mart.nowhere does not exist.")
    assert log[("det/x.csv", "CREATE")] == ("SUCCESS", 7, "Loaded 1 row(s) by partition exchange.")
    assert log[("feed/never.csv", "DELETE")] == ("SUCCESS", None, "Object batch already absent.")
    seen = lambda: rows(world.ingest.table("mart", "t").select("id", "name", F.col("amount").cast("string")))
    assert seen() == [(1, "Ada", "1.50"), (2, "B,b", "2.00"), (77, "D", "7.00")]
    codes = {(r["error_message"][:8], r["error_code"]) for r in world.lake.log("event_errors").collect()}
    assert ("Mapped t", "TARGET_TABLE_NOT_FOUND") in codes and ("Incorrec", "DATAERROR") in codes and ("CSV colu", "VALUEERROR") in codes
    raw = world.lake.log("object_event")
    assert raw.count() == 15  # messages that cannot be processed are kept too
    done = world.lake.events()
    assert done.where("completed_at IS NULL").count() == 2 and done.where("duration_ms < 0").count() == 0

    # a failed update keeps the old rows; a good one without rows empties the slice; delete retires
    world.put("feed/a.csv", "ID,Name,Amount\nx,Ada,1.50\n")
    world.send(("update", "feed/a.csv", 20))
    world.run()
    assert world.audit()[-1][2] == "ERROR" and seen()[0] == (1, "Ada", "1.50")
    world.put("feed/a.csv", "ID,Name,Amount\n")
    world.send(("update", "feed/a.csv", 21), ("delete", "det/x.csv", 22))
    world.run()
    assert seen() == []
    world.put("det/x.csv", "id,name,amount\n78,E,8\n")
    world.send(("update", "det/x.csv", 23))  # an update revives a deleted slice under its number
    world.run()
    assert seen() == [(78, "E", "8.00")] and world.audit()[-1][3] == 7


def test_foreign_rows_fail_the_load(spark, world, rows, monkeypatch):
    """Rows of another slice in a staged load: the load fails, and the slice keeps what it showed."""
    world.put("feed/a.csv", "id,name,amount\n1,A,1\n")
    world.send(("create", "feed/a.csv", 1))
    world.run()
    stage = Lake.stage
    slip = F.when(F.col("id") == 3, 99).otherwise(F.col("batch_num")).cast("bigint")
    monkeypatch.setattr(Lake, "stage", lambda self, df, *rest: stage(self, df.withColumn("batch_num", slip), *rest))
    world.put("feed/a.csv", "id,name,amount\n2,B,2\n3,C,3\n")
    world.send(("update", "feed/a.csv", 2))
    world.run()
    assert world.audit()[-1][2:] == ("ERROR", 1, "Stage table contains a row with an unexpected batch number.")
    assert rows(world.ingest.table("mart", "t").select("id")) == [(1,)]


def test_durations_over_the_lake(spark, world):
    """Completion and duration of events are seen on the lake's own logs, also of detached ones."""
    world.put("feed/a.csv", "id,name,amount\n1,A,1\n")
    world.put("det/b.csv", "id,name,amount\n2,B,2\n")
    world.send(("create", "feed/a.csv", 1), ("create", "det/b.csv", 2))
    world.run()
    assert world.lake.log("object_event").where("completed_at IS NOT NULL").count() == 0
    done = world.lake.events().select("resource_name", "received_at", "completed_at", "duration_ms").collect()
    assert len(done) == 2 and all(r["completed_at"] >= r["received_at"] and r["duration_ms"] > 0 for r in done)
    timed = audit.with_timing(world.lake.log("event_tx_log"), world.lake.events()).collect()
    assert len(timed) == 2 and all(r["event_duration_ms"] > 0 for r in timed)


def test_replayed_batch_is_skipped(spark, world, rows):
    world.put("feed/a.csv", "id,name,amount\n1,A,1\n")
    world.send(("create", "feed/a.csv", 1))
    world.run()
    before = (world.lake.current(), world.audit())
    batch = spark.read.text(f"{world.root}/events").select(F.col("value").alias("event_message"))
    world.ingest.intake(batch, 0)
    assert (world.lake.current(), world.audit()) == before


def test_batch_repeated_after_a_crash(spark, world, rows, monkeypatch):
    world.put("feed/a.csv", "id,name,amount\n1,A,1\n")
    world.send(("create", "feed/a.csv", 1))
    commit = Lake.commit

    def dies(self, *args, **kwargs):
        raise RuntimeError("lost before the commit")

    monkeypatch.setattr(Lake, "commit", dies)
    with pytest.raises(Exception):
        world.run()
    assert world.lake.registry().count() == 0 and world.ingest.table("mart", "t").count() == 0
    assert world.audit() == []  # no audit row before its slice
    monkeypatch.setattr(Lake, "commit", commit)
    world.run()
    assert [r[2] for r in world.audit()] == ["SUCCESS"]
    assert rows(world.ingest.table("mart", "t").select("id")) == [(1,)]


def test_deduplicated_deliveries(spark, tmp_path):
    world = World(spark, tmp_path / "d", deduplicate=True)
    world.put("feed/a.csv", "id,name,amount\n1,A,1\n")
    world.send(("create", "feed/a.csv", 1), ("create", "feed/a.csv", 1))
    world.run()
    assert [r[2] for r in world.audit()] == ["SUCCESS"]
    # delivered once more, in a later micro-batch, next to something older than all before
    world.put("feed/b.csv", "id,name,amount\n1,A,1\n")
    world.send(("create", "feed/a.csv", 1), ("create", "feed/b.csv", 0))
    world.run()
    assert [(r[0], r[2]) for r in world.audit()] == [("feed/a.csv", "SUCCESS"), ("feed/b.csv", "SUCCESS")]


def test_one_batch_or_many(spark, tmp_path, rows):
    """The same messages in one file or one by one lead to the same slices."""
    events = [
        ("create", "feed/a.csv", 1), ("create", "feed/b.csv", 2), ("delete", "feed/a.csv", 3), ("update", "feed/b.csv", 4),
        ("update", "feed/c.csv", 5), ("create", "feed/a.csv", 6),
    ]
    results = []
    for split in (False, True):
        world = World(spark, tmp_path / f"m{split}")
        for name in "abc":
            world.put(f"feed/{name}.csv", f"id,name,amount\n1,{name},1\n")
        for group in ([[e] for e in events] if split else [events]):
            world.send(*group)
            world.run()
        state = world.lake.registry().select("resource_name", "batch_num", "lifecycle_state", "object_version")
        results.append((rows(state), rows(world.ingest.table("mart", "t").select("name")), world.audit()))
    assert results[0] == results[1]


def test_detached_events_keep_their_order(spark, tmp_path, rows):
    """One message file per trigger, and one hand-off file per trigger of the other query."""
    world = World(spark, tmp_path / "o")
    for name in "ab":
        world.put(f"det/{name}.csv", f"id,name,amount\n1,{name},1\n")
    for group in (
        [("create", "det/a.csv", 1), ("create", "det/b.csv", 2), ("delete", "det/a.csv", 3)],
        [("update", "det/a.csv", 4), ("delete", "det/b.csv", 5)],
        [("delete", "det/a.csv", 6), ("update", "det/b.csv", 7)],
    ):
        world.send(*group)
        os.utime(f"{world.root}/events/{world.files}.json", (1_700_000_000 + world.files,) * 2)
    world.ingest.run(f"{world.root}/events", f"{world.root}/checkpoint", max_files=1)
    assert [r[2] for r in world.audit()] == ["SUCCESS"] * 7
    assert rows(world.ingest.table("mart", "t").select("name")) == [("b",)]
