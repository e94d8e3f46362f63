"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings; each can be changed on a live session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}
# Tasks that list the paths of a read: Spark takes up to 10,000 of a path or two, which cost more than their listing.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="slicelake-"), "slicelake"), "zip",
        os.path.dirname(package), os.path.basename(package),
    )
    context.addPyFile(archive)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on (UTC, ANSI, AQE) on an existing session."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    spark.conf.set(LISTING, str(max(64, 4 * spark.sparkContext.defaultParallelism)))
    ship(spark)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; on a cluster use the one given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("slicelake")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def local_frame(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    """A small driver-side list as a relation whose size Catalyst knows.

    Rows given to ``createDataFrame`` as tuples become an RDD of unknown size, and a join with
    it would shuffle the large side; an Arrow table keeps its exact size.
    """
    import pyarrow as pa

    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    arrays = [pa.array([r[i] for r in rows], kinds[kind]) for i, kind in enumerate(columns.values())]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``; only a local
    run without that setting falls back to the machine's own temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
        shared = tempfile.mkdtemp(prefix="slicelake-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back: later steps all see the same rows in the same files."""
    path = work_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
