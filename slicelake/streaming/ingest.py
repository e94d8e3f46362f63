"""Continuous ingest: message -> log -> route -> load -> publish -> audit.

Two streaming queries share one lake and run in one application, one at a time:

* intake logs and routes every message, loads those of SYNC mappings at once and writes
  those of DETACHED mappings to a hand-off folder;
* the detached query loads what it finds there.

Each micro-batch is a handful of set operations whatever its number of objects: one scan per
target and header shape, one staged write per target, one registry commit. A micro-batch that
is replayed after a failure rewrites its own folders; one that was committed is skipped.
"""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.util import inheritable_thread_target

from slicelake import schemas
from slicelake.functions import events as ev
from slicelake.operators import audit, lifecycle, ordering, quality, routing, skew
from slicelake.operators.lifecycle import SOURCE, TARGET
from slicelake.session import local_frame
from slicelake.sinks.lake import Lake
from slicelake.sources import csvfiles, messages, records

PARALLEL_TARGETS = 8
MAX_FILES = 1000  # message files of one micro-batch
REMEMBER = "7 days"  # how long a delivery key is kept
_ONE_WRITER = threading.Lock()

ROUTED_LOG = T.StructType(
    [
        *schemas.CONTROL["object_event"].fields,
        *schemas.schema_of(
            "event_id string, action string, object_name string, object_version string, reject string, "
            "mapping_id bigint, target_database string, target_table string, worker_threads int"
        ).fields,
    ]
)
# An audit row as written: the control table's columns, then what later steps derive from it.
OUTCOME = T.StructType(
    [
        *schemas.CONTROL["event_tx_log"].fields,
        *schemas.schema_of(
            "error_class string, prev_state string, state string, visible_seq bigint, attempt bigint, "
            "slice_batch bigint, received_at timestamp_ntz"
        ).fields,
    ]
)
RESULTS = "mapping_id bigint, bucket_name string, resource_name string, attempt bigint, rows bigint, failure string, failure_class string"


@dataclass(frozen=True)
class Target:
    """A registered target: column types, unique key, declared lengths."""

    database: str
    table: str
    columns: dict[str, str]
    keys: tuple[str, ...] = ()
    limits: dict[str, int] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, t in self.columns.items()])


def split_by_mode(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(handled now, handed to the detached query). Rows without a mode are errors, handled now."""
    detached = F.coalesce(F.col("invocation_mode") == "DETACHED", F.lit(False))
    return events.where(~detached), events.where(detached)


class Ingest:
    def __init__(
        self,
        spark: SparkSession,
        lake: Lake,
        mappings: DataFrame,
        targets: list[Target],
        objects_root: str,
        deduplicate: bool = False,
    ):
        self.spark, self.lake, self.mappings = spark, lake, mappings
        self.targets = {(t.database, t.table): t for t in targets}
        self.objects_root = objects_root.rstrip("/")
        self.deduplicate = deduplicate
        self.routing = routing.strategy(mappings)

    # ------------------------------------------------------------ streams

    def run(self, events_path: str, checkpoint: str, max_files: int = MAX_FILES) -> None:
        """Work off everything that has arrived, in micro-batches of ``max_files`` files, then return."""
        self.start_intake(events_path, f"{checkpoint}/intake", max_files).awaitTermination()
        if self.lake.log("handoff", ROUTED_LOG).limit(1).count():
            self.start_detached(f"{checkpoint}/detached", max_files).awaitTermination()

    def start_intake(self, events_path: str, checkpoint: str, max_files: int = MAX_FILES, **trigger) -> StreamingQuery:
        stream = messages.read_messages(self.spark, events_path, True, max_files)
        if self.deduplicate:
            stream = _first_deliveries(stream)
        writer = stream.writeStream.foreachBatch(self.intake).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def start_detached(self, checkpoint: str, max_files: int = MAX_FILES, **trigger) -> StreamingQuery:
        reader = self.spark.readStream.schema(ROUTED_LOG).option("maxFilesPerTrigger", max_files)
        stream = reader.parquet(f"{self.lake.root}/handoff")
        writer = stream.writeStream.foreachBatch(self.detached).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    # ------------------------------------------------------------ micro-batches

    def intake(self, batch: DataFrame, batch_id: int) -> None:
        with _ONE_WRITER:
            state = self.lake.current()
            if state["batch_id"].get("intake", -1) >= batch_id:
                return
            folder = batch_id * 2
            seen = Observation()
            detached = F.coalesce(F.col("invocation_mode") == "DETACHED", F.lit(False))
            rows = self._log_rows(batch, state["next_seq"]).observe(
                seen, F.count(F.lit(1)).alias("rows"), F.count_if(detached).alias("detached")
            )
            self.lake.append_log("object_event", rows, folder)
            # read back: ids, arrival times and routes are fixed from here on
            logged = self.spark.read.schema(ROUTED_LOG).parquet(f"{self.lake.root}/object_event/batch_id={folder}")
            now, later = split_by_mode(logged.where(F.col("reject").isNull()))
            if seen.get["detached"]:
                # a source's events stay in one file, so that no trigger of the other query parts them
                self.lake.append_log("handoff", later.repartition(*SOURCE), folder)
            self._process(now, folder, ("intake", batch_id), state["next_seq"] + seen.get["rows"], seen.get["rows"])

    def detached(self, batch: DataFrame, batch_id: int) -> None:
        with _ONE_WRITER:
            state = self.lake.current()
            if state["batch_id"].get("detached", -1) >= batch_id:
                return
            edge = batch.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")).first()
            done = self.lake.log("event_tx_log").where(F.col("id").between(edge["a"] or 0, edge["b"] or 0))
            fresh = batch.dropDuplicates(["id"]).join(done.select("id"), "id", "left_anti")
            folder = batch_id * 2 + 1
            self._process(self._fixed("detached", fresh, folder), folder, ("detached", batch_id), None, edge["n"])

    def _fixed(self, name: str, rows: DataFrame, folder: int) -> DataFrame:
        """``rows`` written to a log and read back, for what several later steps use."""
        self.lake.append_log(name, rows, folder)
        return self.spark.read.schema(rows.schema).parquet(f"{self.lake.root}/{name}/batch_id={folder}")

    def _log_rows(self, batch: DataFrame, next_seq: int) -> DataFrame:
        parsed = messages.parse_messages(batch, F.localtimestamp()).withColumn("received_at", F.localtimestamp())
        if self.deduplicate:
            complete = F.col("event_id").isNotNull()
            keyed = parsed.withColumn("version", F.col("object_version"))
            # the choice among deliveries is fixed by their text: ids are counted in two passes
            first = skew.latest_per_key(keyed.where(complete), ordering.IDEMPOTENCY, ["event_message"])
            parsed = first.unionByName(keyed.where(~complete)).drop("version")
        order = [F.col("event_time"), F.col("event_id"), F.col("event_message")]
        numbered = skew.numbered(parsed, order, "id").withColumn("id", F.col("id") + next_seq)
        routed = routing.route(
            numbered, self.mappings, key="id", **self.routing
        )
        # an unsupported type never reaches the mapping
        known = F.col("action") != "UNKNOWN"
        routed = routed.withColumns(
            {c: F.when(known, F.col(c)) for c in ("mapping_id", *TARGET, "mapping_mode", "worker_threads")}
        )
        mode = ev.new_event_mode(F.lit(None).cast("string"), F.col("mapping_mode"), F.lit(False))
        nothing = {"completed_at": "timestamp_ntz", "duration_ms": "decimal(16,3)"}
        rows = routed.withColumns(
            {
                "event_date": F.col("event_time"),
                "invocation_mode": F.when(F.col("mapping_id").isNotNull(), mode),
                **{c: F.lit(None).cast(t) for c, t in nothing.items()},
            }
        )
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ROUTED_LOG])

    def _process(
        self, events: DataFrame, folder: int, batch: tuple[str, int], next_seq: int | None, size: int
    ) -> None:
        state = self.lake.current()
        registry = self.lake.registry(state, events.select(*SOURCE).distinct())
        if state["version"]:
            registry = self._fixed("registry_before", registry, folder)
        specs = local_frame(
            self.spark, sorted(self.targets), {"target_database": "string", "target_table": "string"}
        ).withColumn("_exists", F.lit(True))
        # a slice stays with the target it was created in
        owners = registry.select(*SOURCE, *[F.col(c).alias(f"_{c}") for c in TARGET])
        events = (
            events.withColumn("seq", F.col("id"))
            .join(owners, SOURCE, "left")
            .withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in TARGET})
            .drop(*[f"_{c}" for c in TARGET])
            .join(specs, TARGET, "left")
        )
        valid = events.where(F.col("mapping_id").isNotNull() & F.col("_exists"))

        numbers = lifecycle.allocate_batches(valid, registry, self.lake.sequences(state))
        sources = self._fixed("sources", self._sources(valid, numbers), folder)
        batches = sources.select(*SOURCE, "batch_num")
        results = self._load(sources.where(F.col("file").isNotNull()), folder)
        judged = valid.join(results, SOURCE, "left").withColumn(
            "ok", F.coalesce(F.col("failure").isNull() & F.col("rows").isNotNull(), F.lit(False))
        )
        # a small micro-batch has no hot source, so nothing needs counting
        hot = skew.HotKeys(tuple(SOURCE)) if size < skew.MIN_HOT_ROWS else None
        folded = lifecycle.with_batches(lifecycle.fold_lifecycle(judged, registry, hot), batches)
        self.lake.append_log("event_tx_log", self._outcomes(events, folded), folder)
        written = self.spark.read.schema(OUTCOME).parquet(f"{self.lake.root}/event_tx_log/batch_id={folder}")
        errors = audit.error_rows(written, F.col("error_class")).withColumn("id", F.col("event_log_id"))
        self.lake.append_log("event_errors", errors, folder)
        self.lake.commit(self._changes(written, registry, folder), batch, next_seq)

    # ------------------------------------------------------------ loading

    def _sources(self, valid: DataFrame, numbers: DataFrame) -> DataFrame:
        """Every source with a slice: its batch number, and the object to read if it was created or updated.

        All load events of an object in one micro-batch see the same file, so it is read
        once; the last event's id names the attempt.
        """
        newest = (
            valid.where(F.col("action") != "DELETE")
            .groupBy(*SOURCE)
            .agg(F.max(F.struct("seq", "object_name")).alias("_last"))
        )
        path = F.concat_ws("/", F.lit(self.objects_root), "bucket_name", "_last.object_name")
        return numbers.join(newest, SOURCE, "left").select(
            *SOURCE, *TARGET, "batch_num", F.col("_last.seq").alias("attempt"),
            F.when(F.col("_last").isNotNull(), path).alias("file"),
        )

    def _load(self, loads: DataFrame, folder: int) -> DataFrame:
        """Stage the current contents of the objects in ``loads``; one result row per source."""
        # one path per object of the micro-batch: Spark's readers take paths from the driver
        paths: dict[tuple[str, str], list[str]] = {}
        for database, table, path in loads.select(*TARGET, "file").distinct().collect():
            paths.setdefault((database, table), []).append(path)
        work = [(self.targets[key], sorted(files)) for key, files in sorted(paths.items()) if key in self.targets]
        if not work:
            return self.spark.createDataFrame([], RESULTS)
        # targets do not depend on each other: their jobs share the cluster
        load = inheritable_thread_target(self.spark)(lambda item: self._load_target(loads, *item, folder))
        with ThreadPoolExecutor(min(len(work), PARALLEL_TARGETS)) as pool:
            results = list(pool.map(load, work))
        return reduce(DataFrame.unionByName, results)

    def _load_target(self, loads: DataFrame, target: Target, paths: list[str], folder: int) -> DataFrame:
        mine = loads.where((F.col("target_database") == target.database) & (F.col("target_table") == target.table))
        # headers are looked at twice: to check them, and to group the files by shape
        headers = csvfiles.probe_headers(csvfiles.file_frame(self.spark, paths)).persist()
        try:
            guess = records.Splits()
            self._stage(mine, target, paths, headers, guess, folder)
            if not guess.held():
                # some record goes over a split's end, or some text is not UTF-8: look first, then read again
                checked, splits = csvfiles.check_files(self.spark, headers)
                headers.unpersist()
                headers = checked.persist()
                self._stage(mine, target, paths, headers, splits, folder)
            shape = T.StructType(
                [
                    *target.schema.fields,
                    *schemas.schema_of("batch_num bigint, attempt bigint, _error string").fields,
                ]
            )
            staged = self.spark.read.schema(shape).parquet(
                f"{self.lake.target_path(target.database, target.table)}/load={folder}"
            )
            manifest = self.lake.manifest(target.database, target.table).where(F.col("load") == folder)
            self.lake.append_log(
                f"checks/{target.database}.{target.table}", self._checks(mine, headers, staged, manifest, target), folder
            )
        finally:
            headers.unpersist()
        return self.spark.read.schema(RESULTS).parquet(
            f"{self.lake.root}/checks/{target.database}.{target.table}/batch_id={folder}"
        )

    def _stage(
        self, mine: DataFrame, target: Target, paths: list[str], headers: DataFrame, splits: records.Splits, folder: int
    ) -> None:
        """Write the rows of the objects, tagged with their slices, where no reader looks yet."""
        rows = csvfiles.read_object_csv(self.spark, paths, list(target.columns), headers, splits)
        tagged = rows.join(mine.select(csvfiles.path_key(F.col("file")).alias("file"), "batch_num", "attempt"), "file")
        typed = [F.col(c).try_cast(t).alias(c) for c, t in target.columns.items()]
        self.lake.stage(
            tagged.select(*typed, "batch_num", "attempt", _cell_error(target).alias("_error")),
            target.database, target.table, folder,
        )

    def _checks(
        self, mine: DataFrame, headers: DataFrame, staged: DataFrame, manifest: DataFrame, target: Target
    ) -> DataFrame:
        """Rows loaded per attempt, or why the load failed: unreadable file, header, cell, repeated key, rows of another slice."""
        columns = F.array(*[F.lit(c) for c in target.columns])
        expected = mine.select("attempt", F.col("batch_num").alias("expected_batch"))
        counted = manifest.join(expected, "attempt")
        impure = counted.where(F.col("batch_num") != F.col("expected_batch")).select("attempt", F.lit(lifecycle.IMPURE).alias("_impure")).distinct()
        wrong = quality.header_findings(headers.where(F.col("error").isNull()), columns)
        files = headers.select("file", "error").join(wrong, "file", "left")
        counts = counted.where(F.col("batch_num") == F.col("expected_batch")).select("attempt", "rows")
        # parquet statistics skip everything where no cell failed
        broken = staged.where(F.col("_error").isNotNull()).groupBy("attempt").agg(F.min("_error").alias("_error"))
        found = (
            mine.join(files, "file", "left")
            .join(counts, "attempt", "left")
            .join(broken, "attempt", "left")
            .join(impure, "attempt", "left")
            .withColumn("_double", F.lit(None).cast("bigint"))
        )
        if target.keys:
            repeats = (
                quality.duplicate_keys(staged, list(target.keys), ["attempt"])
                .groupBy("attempt")
                .agg(F.count(F.lit(1)).alias("_double"))
            )
            found = found.drop("_double").join(repeats, "attempt", "left")
        repeated = F.when(F.col("_double").isNotNull(), "Duplicate entry for a unique key.")
        failure = F.coalesce("error", "message", "_error", repeated, "_impure")
        kind = (
            F.when(F.col("error").isNotNull(), "ServiceError")
            .when(F.col("message").isNotNull(), "ValueError")
            .when(F.col("_error").isNotNull(), "DataError")
            .when(F.col("_double").isNotNull(), "IntegrityError")
            .when(F.col("_impure").isNotNull(), "ValueError")
        )
        return found.select(
            *SOURCE, "attempt", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
            failure.alias("failure"), kind.alias("failure_class"),
        )

    # ------------------------------------------------------------ audit rows and registry

    def _outcomes(self, events: DataFrame, folded: DataFrame) -> DataFrame:
        """One audit row per event: folded ones, then those without a mapping or a target."""
        message = lifecycle.outcome_message(F.col("rows"), F.coalesce("failure", F.lit("Load failed.")))
        refused = F.col("message").isin(lifecycle.ALREADY_ACTIVE, lifecycle.NO_BATCH)
        done = folded.withColumns(
            {"event_status": F.when(F.col("success"), "SUCCESS").otherwise("ERROR"), "message": message}
        ).withColumn(
            "error_class", F.when(refused, "ValueError").otherwise(F.coalesce("failure_class", F.lit("ValueError")))
        )
        missing = F.concat(
            F.lit("Mapped target table "), "target_database", F.lit("."), "target_table", F.lit(" does not exist.")
        )
        unmapped = F.col("mapping_id").isNull()
        lost = events.where(unmapped | F.col("_exists").isNull()).withColumns(
            {
                "event_status": F.lit("ERROR"),
                "message": F.when(F.col("action") == "UNKNOWN", lifecycle.UNSUPPORTED)
                .when(unmapped, lifecycle.NO_MAPPING)
                .otherwise(missing),
                "error_class": F.when(unmapped, "ValueError").otherwise("TargetTableError"),
            }
        )

        def shaped(rows: DataFrame) -> DataFrame:
            source = {"object_event_id": F.col("id"), "event_action": F.col("action"), "created_at": F.localtimestamp()}
            columns = []
            for field in OUTCOME.fields:
                absent = field.name not in rows.columns
                value = source.get(field.name, F.lit(None) if absent else F.col(field.name))
                columns.append(value.cast(field.dataType).alias(field.name))
            return rows.select(*columns)

        return shaped(done).unionByName(shaped(lost))

    def _changes(self, outcomes: DataFrame, registry: DataFrame, folder: int) -> DataFrame:
        """Registry rows of the sources this micro-batch touched."""
        action, before = F.col("event_action"), F.col("prev_state")
        accepted = ((action == "CREATE") & (before != "ACTIVE")) | ((action == "UPDATE") & (before != "ABSENT"))
        last = outcomes.where(F.col("state").isNotNull()).groupBy(*SOURCE).agg(
            F.max(F.when(accepted, F.struct("id", "object_version"))).alias("_version"),
            F.max(F.struct("id", "state", "visible_seq", "attempt", "slice_batch", *TARGET, "received_at")).alias("_last"),
        )
        old = registry.select(
            *SOURCE, F.col("object_version").alias("_old_version"), F.col("visible_attempt").alias("_old_attempt"),
            F.col("visible_load").alias("_old_load"),
        )
        joined = last.join(old, SOURCE, "left").where(F.col("_last.state") != "ABSENT")
        shown = F.col("_last.visible_seq")
        kept = shown.eqNullSafe(F.col("_old_attempt"))
        return joined.select(
            *SOURCE,
            *[F.col(f"_last.{c}").alias(c) for c in TARGET],
            F.col("_last.slice_batch").alias("batch_num"),
            ev.source_key(F.col("mapping_id"), F.col("bucket_name"), F.col("resource_name")).alias("source_key"),
            F.coalesce("_version.object_version", "_old_version").alias("object_version"),
            F.col("_last.state").alias("lifecycle_state"),
            F.when(kept, shown).when(shown.isNotNull(), F.col("_last.attempt")).alias("visible_attempt"),
            F.col("_last.id").alias("last_seq"),
            F.col("_last.received_at").alias("updated_at"),
            F.when(kept, F.col("_old_load")).when(shown.isNotNull(), F.lit(folder)).cast("bigint").alias("visible_load"),
        )

    # ------------------------------------------------------------ reading

    def table(self, database: str, table: str) -> DataFrame:
        return self.lake.visible(database, table, self.targets[(database, table)].schema)


def _first_deliveries(stream: DataFrame) -> DataFrame:
    """Messages whose delivery key has not been seen for REMEMBER.

    The watermark runs on arrival, not on the event's own time, so that no message is ever too late.
    """
    parsed = messages.parse_messages(stream, F.localtimestamp())
    keyed = parsed.select(
        "event_message",
        F.coalesce("event_id", "event_message").alias("event_id"),
        F.col("object_version").alias("version"),
        "action",
        F.current_timestamp().alias("arrived"),
    )
    return ordering.dedup_events(keyed, ("arrived", REMEMBER)).select("event_message")


def _cell_error(target: Target) -> Column:
    """The first cell a strict insert would refuse, as text."""
    tests = []
    for column, kind in target.columns.items():
        if kind != "string":
            # the very expression that gives the typed column, so it is evaluated once
            bad = F.col(column).try_cast(kind).isNull()
            tests.append(F.when(bad, F.concat(F.lit(f"Incorrect value for column '{column}': "), F.col(column))))
        elif column in target.limits:
            tests.append(
                F.when(F.length(column) > target.limits[column], F.lit(f"Data too long for column '{column}'"))
            )
    return F.coalesce(*tests, F.lit(None).cast("string"))
