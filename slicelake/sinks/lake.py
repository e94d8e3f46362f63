"""Slices on files: staging, atomic publication, registry snapshots, audit logs.

Layout under the lake's root::

    data/<database>.<table>/load=<id>/      staged rows with batch_num and attempt columns
    attempts/<database>.<table>/load=<id>/  the attempts among them, with row counts
    registry/v=<n>/                         registry rows changed by commit n
    object_event|event_tx_log|event_errors|handoff/batch_id=<id>/
    CURRENT                                 the committed version; replaced by one rename

A staged load is invisible until a registry row points at its (load, attempt). A commit writes
the changed registry rows and then swaps CURRENT, so readers see all of it or none. Every
folder is keyed by batch id and written in overwrite mode: a replayed batch rewrites the same
folders. One writer per lake.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from slicelake import schemas
from slicelake.functions import events as ev
from slicelake.operators import skew
from slicelake.operators.lifecycle import SOURCE, TARGET
from slicelake.paths import exists, filesystem
from slicelake.session import local_frame

REGISTRY = T.StructType(
    schemas.CONTROL["source_object_batches"].fields + [T.StructField("visible_load", T.LongType())]
)
COMPACT_EVERY = 32
MAX_BROADCAST_ATTEMPTS = 2_000_000  # three numbers each
_TAGS = schemas.schema_of("batch_num bigint, attempt bigint, load bigint").fields
_MANIFEST = schemas.schema_of("batch_num bigint, attempt bigint, rows bigint, load bigint")


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ------------------------------------------------------------ pointer

    def current(self) -> dict:
        system, path = filesystem(self.root)
        try:
            with system.open_input_stream(f"{path}/CURRENT") as stream:
                return json.loads(stream.read())
        except FileNotFoundError:
            # a writer that died in its first commit leaves version 1 only
            if exists(f"{self.root}/registry/v=2"):
                raise RuntimeError(f"{self.root} has commits but no pointer; it is being replaced or was lost.") from None
            return {"version": 0, "base": 0, "batch_id": {}, "next_seq": 0, "sequences": {}}

    def _swap(self, state: dict) -> None:
        system, path = filesystem(self.root)
        system.create_dir(path, recursive=True)
        temporary = f"{path}/CURRENT.{state['version']}"
        with system.open_output_stream(temporary) as stream:
            stream.write(json.dumps(state).encode())
        system.move(temporary, f"{path}/CURRENT")

    # ------------------------------------------------------------ registry

    def registry(
        self,
        state: dict | None = None,
        touched: DataFrame | None = None,
        target: tuple[str, str] | None = None,
        columns: list[str] | None = None,
    ) -> DataFrame:
        """Latest committed row of every source: the base snapshot and the changes after it.

        ``touched`` (SOURCE columns) keeps only those sources, ``target`` only those of one target (a
        source never changes its target), ``columns`` only these: all before anything is shuffled.
        """
        names = [f for f in REGISTRY.names if columns is None or f in columns]
        state = state or self.current()
        if state["version"] == 0:
            return self.spark.createDataFrame([], REGISTRY).select(*names)
        schema = T.StructType([*REGISTRY.fields, T.StructField("v", T.LongType())])
        rows = (
            self.spark.read.schema(schema)
            .parquet(f"{self.root}/registry")
            .where(F.col("v").between(state["base"], state["version"]))
        )
        if target is not None:
            rows = rows.where((F.col("target_database") == target[0]) & (F.col("target_table") == target[1]))
        if touched is not None:
            rows = rows.join(touched, SOURCE, "left_semi")
        rows = rows.select(*SOURCE, "v", *[n for n in names if n not in SOURCE])
        return skew.latest_per_key(rows, SOURCE, ["v"]).select(*names)

    def sequences(self, state: dict | None = None) -> DataFrame:
        """Next free batch number of each target."""
        found = (state or self.current())["sequences"]
        rows = [(*name.split("."), number) for name, number in sorted(found.items())]
        return local_frame(
            self.spark, rows, {"target_database": "string", "target_table": "string", "next_batch_num": "bigint"}
        )

    def commit(self, changed: DataFrame, batch: tuple[str, int] | None = None, next_seq: int | None = None) -> int:
        """Publish registry rows (publish, retire, state changes) in one step.

        ``batch`` names the query and its batch id, so that a replay can be recognised.
        """
        state = self.current()
        version = state["version"] + 1
        columns = [changed[f.name].cast(f.dataType).alias(f.name) for f in REGISTRY.fields]
        path = f"{self.root}/registry/v={version}"
        changed.select(*columns).write.mode("overwrite").parquet(path)
        highest = self.spark.read.schema(REGISTRY).parquet(path).groupBy(*TARGET).agg(F.max("batch_num"))
        sequences = dict(state["sequences"])
        for database, table, number in highest.collect():  # one row per target
            name = f"{database}.{table}"
            sequences[name] = max(sequences.get(name, 1), (number or 0) + 1)
        ids = dict(state["batch_id"])
        if batch is not None:
            ids[batch[0]] = batch[1]
        state = {
            "version": version,
            "base": state["base"] or version,
            "batch_id": ids,
            "next_seq": state["next_seq"] if next_seq is None else next_seq,
            "sequences": sequences,
        }
        self._swap(state)
        if version - state["base"] >= COMPACT_EVERY:
            self.compact()
        return version

    def compact(self) -> None:
        """Rewrite the registry as one snapshot, so that readers need fewer files."""
        state = self.current()
        version = state["version"] + 1
        self.registry(state).write.mode("overwrite").parquet(f"{self.root}/registry/v={version}")
        self._swap({**state, "version": version, "base": version})

    # ------------------------------------------------------------ target data

    def target_path(self, database: str, table: str) -> str:
        return f"{self.root}/data/{database}.{table}"

    def stage(self, rows: DataFrame, database: str, table: str, load: int) -> str:
        """Write rows (with ``batch_num``, ``attempt``) where no reader looks yet.

        Files keep the scan's partitioning: nothing is shuffled or sorted, and every split writes
        its own file. A split comes from one object, so the rows of a slice stay together and
        row-group statistics on ``batch_num`` let later reads skip the other slices.
        """
        path = f"{self.target_path(database, table)}/load={load}"
        rows.write.mode("overwrite").parquet(path)
        tags = T.StructType(_MANIFEST.fields[:2])
        counted = self.spark.read.schema(tags).parquet(path).groupBy("batch_num", "attempt")
        counted.agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(
            f"{self.root}/attempts/{database}.{table}/load={load}"
        )
        return path

    def target(self, database: str, table: str, schema: T.StructType) -> DataFrame:
        """Everything staged for a target, visible or not."""
        return self._read(f"data/{database}.{table}", T.StructType([*schema.fields, *_TAGS]))

    def manifest(self, database: str, table: str) -> DataFrame:
        """Staged (slice, attempt, load) of a target with their row counts."""
        return self._read(f"attempts/{database}.{table}", _MANIFEST)

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        if not exists(f"{self.root}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def visible(self, database: str, table: str, schema: T.StructType, keep_slice: bool = False) -> DataFrame:
        """Rows a reader of the target sees.

        Reading must not shuffle the target. Folders none of whose attempts is shown are not
        listed, by a filter on the partition column. From the others the attempts that are not
        shown are taken out: these are few (replaced, failed, deleted), so they are counted and
        broadcast, whatever the number of slices. Beyond MAX_BROADCAST_ATTEMPTS the plan is left
        to Catalyst; ``drop_loads`` brings the number down.
        """
        tag = ["load", "batch_num", "attempt"]
        shown = self._shown(database, table)
        loads = sorted(r["load"] for r in shown.select("load").distinct().collect())  # one per micro-batch
        live = F.col("load").isin(loads)
        rows = self.target(database, table, schema).where(live)
        hidden = self.manifest(database, table).where(live).join(shown, tag, "left_anti").select(*tag)
        count = hidden.limit(MAX_BROADCAST_ATTEMPTS + 1).count()
        if count:
            rows = rows.join(F.broadcast(hidden) if count <= MAX_BROADCAST_ATTEMPTS else hidden, tag, "left_anti")
        return rows if keep_slice else rows.select(*schema.names)

    def _shown(self, database: str, table: str) -> DataFrame:
        """(load, slice, attempt) of the slices that show rows."""
        kept = ["batch_num", "visible_attempt", "visible_load"]
        return (
            self.registry(target=(database, table), columns=kept)
            .where(F.col("visible_attempt").isNotNull())
            .select(F.col("visible_load").alias("load"), "batch_num", F.col("visible_attempt").alias("attempt"))
        )

    def attempts(self, database: str, table: str) -> DataFrame:
        """The manifest with its target, as ``orphan_attempts`` takes it."""
        return self.manifest(database, table).select(
            F.lit(database).alias("target_database"), F.lit(table).alias("target_table"), "*"
        )

    def drop_loads(self, database: str, table: str) -> list[int]:
        """Delete load folders none of whose attempts is shown; returns their ids."""
        used = self._shown(database, table).select("load").distinct()
        gone = self.manifest(database, table).select("load").distinct().join(used, "load", "left_anti")
        loads = sorted(r["load"] for r in gone.collect())  # one number per micro-batch
        for load in loads:
            for name in ("data", "attempts"):
                system, path = filesystem(f"{self.root}/{name}/{database}.{table}")
                system.delete_dir(f"{path}/load={load}")
        return loads

    # ------------------------------------------------------------ logs

    def append_log(self, name: str, rows: DataFrame, batch_id: int) -> None:
        """One folder per micro-batch; writing it again replaces it."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={batch_id}")

    def events(self) -> DataFrame:
        """The event log with completion times, merged when it is read.

        An event's row is written before it is loaded and never changed; when it ended stands in the
        transaction log, where the last row of an event counts.
        """
        return completed_events(self.log("object_event"), self.log("event_tx_log"))

    def log(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """Rows of committed micro-batches; those of one under way, or of a writer that died, are not read.

        Folders of the intake have even numbers, those of the detached query odd ones.
        """
        schema = schema or schemas.CONTROL[name]
        ids = self.current()["batch_id"]
        number = F.col("batch_id")
        intake = (number % 2 == 0) & (number <= 2 * ids.get("intake", -1))
        detached = (number % 2 == 1) & (number <= 2 * ids.get("detached", -1) + 1)
        folders = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
        return self._read(name, folders).where(intake | detached).select(*schema.names)


def completed_events(raw: DataFrame, tx: DataFrame) -> DataFrame:
    """Raw events with completion time and duration of their last transaction."""
    ends = tx.groupBy(F.col("object_event_id").alias("id")).agg(F.max("created_at").alias("_end"))
    return (
        raw.join(ends, "id", "left")
        .withColumn("completed_at", F.coalesce("_end", "completed_at"))
        .withColumn("duration_ms", ev.duration_ms(F.col("received_at"), F.col("completed_at")))
        .select(*raw.columns)
    )
