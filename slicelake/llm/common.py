"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slicelake.session import prepare, work_dir

SPACES = " \t\n\x0b\x0c\r"            # the white space of all word and line rules here
WORD_BREAK = "[ \\t-\\r]+"
BITS = 24                              # a bitmap has 2 ** BITS bits


def ready(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches bounded by bytes, as texts differ in length."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``, so that columns added beside it never clash with given ones."""
    return F.struct(*[column(c) for c in df.columns]).alias("row")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back: a lost executor then costs a read, not the lineage."""
    path = work_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash128(*parts: Column) -> Column:
    """128 hash bits as two longs: 64 would collide among the lines of a very large corpus."""
    return F.struct(
        F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b")
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def slices(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Consecutive slices of at most ``limit`` in total, or of one element that is larger."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


class HashedPairs:
    """(first, second) -> value for non-negative ints, open addressing in numpy, whole arrays at a time."""

    EMPTY = -1

    def __init__(self, bits: int = 12):
        self._reset(bits)

    def _reset(self, bits: int) -> None:
        self.bits, self.size = bits, 0
        self.keys = np.full(1 << bits, self.EMPTY, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (first.astype(np.int64) << 32) | second

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of ``keys``, -1 where there is none."""
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], -1)
        left = np.flatnonzero((found != keys) & (found != self.EMPTY))
        slots = slots[left]
        while len(left):
            slots = (slots + 1) & (len(self.keys) - 1)
            found = self.keys[slots]
            hit = found == keys[left]
            out[left[hit]] = self.values[slots[hit]]
            more = ~hit & (found != self.EMPTY)
            left, slots = left[more], slots[more]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not in the table yet."""
        if (self.size + len(keys)) * 3 > len(self.keys):
            old, kept = self.keys[self.keys != self.EMPTY], self.values[self.keys != self.EMPTY]
            bits = self.bits
            while (self.size + len(keys)) * 3 > 1 << bits:
                bits += 1
            self._reset(bits)
            self.put(old, kept)
        self.size += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] == self.EMPTY)
            _, first = np.unique(slots[free], return_index=True)
            mine = free[first]
            self.keys[slots[mine]], self.values[slots[mine]] = keys[mine], values[mine]
            rest = np.ones(len(keys), bool)
            rest[mine] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & (len(self.keys) - 1)


def texts_of(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its n + 1 offsets into them; NULL is empty."""
    import pyarrow as pa

    array = array.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole, offsets


def bitmap(hashes: DataFrame):
    """A broadcast bitmap of the hashes' low bits: 2 ** BITS bits, whatever the number of hashes."""
    slot = F.pmod("hash", F.lit(1 << BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int"))
    rows = (
        hashes.select(F.floor(slot / 64).cast("int").alias("at"), bit.alias("bit"))
        .groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()  # at most 2 ** BITS / 64 rows
    )
    out = np.zeros((1 << BITS) // 64, np.int64)
    for row in rows:
        out[row["at"]] = row["bits"]
    return hashes.sparkSession.sparkContext.broadcast(out)


def marked(grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the n-grams whose bit is set."""
    low = grams & ((1 << BITS) - 1)
    return np.flatnonzero((bits[low >> 6] >> (low & 63)) & 1)


def frequent(rows: DataFrame, n: str, limit: int) -> tuple[DataFrame, bool]:
    """The most frequent rows by the positive count ``n``, at most ``limit``, and whether these are all.

    Rows come in classes of similar counts, sixteen for each doubling; classes are taken whole, so
    nothing is sorted and only a row per class, about a thousand, comes to the driver.
    """
    step = F.floor(F.log2(n) * 16)
    classes = rows.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for row in classes:
        if total + row["size"] > limit:
            return (rows.where(step >= least) if least is not None else rows.where(F.lit(False))), False
        total, least = total + row["size"], row["step"]
    return rows, True
