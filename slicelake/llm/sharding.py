"""Sharding by Karmarkar-Karp differencing: indivisible groups of equal texts, shards of near equal bytes.

Differencing keeps a heap of partial partitions, each a list of shard loads, and again and again combines the two
with the largest spread, the heaviest shard of one with the lightest of the other.

Its input is bounded whatever the table: a group above ``1 / ITEMS`` of all bytes is an item of
its own (there are fewer than ``ITEMS``), all other groups go by their hash into ``ITEMS`` bundles. So the
driver combines fewer than ``2 * ITEMS`` items, the decision is a broadcast table of that size, and rows find
their shard without a shuffle, also those of one very large group. A group larger than a shard's
share fills its shard alone and the others share the rest.

Slots number the rows of a shard in the order of document id: rows are ranged by shard and id, counted by range,
and numbered inside their range.

Defined cases: a NULL text has no bytes and is in the group of empty texts. NULL and repeated ids are numbered like
others, NULL first. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from slicelake.llm.common import column, hash128, stored
from slicelake.session import local_frame

ITEMS = 20_000
ROW_BYTES = 8             # what a row costs besides its text


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of every item."""
    if not sizes:
        return []
    loads, children, orders = [], [], []
    for size in sizes:
        first = np.zeros(shards, np.int64)
        first[0] = size
        loads.append(first)       # heaviest shard first
        children.append(None), orders.append(None)
    heap = [(-int(x[0] - x[-1]), i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        sums = loads[a] + loads[b][::-1]
        order = np.argsort(-sums, kind="stable")
        loads[a] = loads[b] = None
        loads.append(sums[order]), children.append((a, b)), orders.append(order)
        heapq.heappush(heap, (-int(loads[-1][0] - loads[-1][-1]), len(loads) - 1))
    shard = [0] * len(sizes)
    todo = [(heap[0][1], np.arange(shards))]
    while todo:                   # from the last partition back to the items
        node, shard_at = todo.pop()
        if children[node] is None:
            shard[node] = int(shard_at[0])
            continue
        a, b = children[node]
        placed = np.empty(shards, np.int64)
        placed[orders[node]] = shard_at
        todo += [(a, placed), (b, placed[::-1])]
    return shard


def measure(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``size``, ``crc`` and the group's hash ``a``, ``b``; the text is read once."""
    body = F.coalesce(column(text), F.lit(""))
    key = hash128(body)
    return docs.select(
        column(id).alias("doc"),
        (F.octet_length(body) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(body).alias("crc"),
        key["a"].alias("a"), key["b"].alias("b"),
    )


def assign(rows: DataFrame, shards: int, items: int = ITEMS) -> DataFrame:
    """``rows`` of :func:`measure` with their ``shard``."""
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0] or 0
    bundle = F.pmod(F.xxhash64("b", "a"), F.lit(items))
    groups = rows.groupBy("a", "b").agg(F.sum("size").alias("size"))
    large = F.col("size").cast("decimal(38,0)") * items > total
    units = (
        groups.select(
            F.when(large, F.col("a")).alias("a"), F.when(large, F.col("b")).alias("b"),
            F.when(~large, bundle).alias("bundle"), "size",
        )
        .groupBy("a", "b", "bundle").agg(F.sum("size").alias("size"))
        .orderBy("a", "b", "bundle").collect()  # fewer than 2 * items rows
    )
    placed = difference([r["size"] for r in units], shards)
    alone = [(r["a"], r["b"], s) for r, s in zip(units, placed) if r["bundle"] is None]
    together = [(r["bundle"], s) for r, s in zip(units, placed) if r["bundle"] is not None]
    by_group = local_frame(spark, alone, {"a": "bigint", "b": "bigint", "own": "bigint"})
    by_bundle = local_frame(spark, together, {"bundle": "bigint", "shared": "bigint"})
    return (
        rows.join(F.broadcast(by_group), ["a", "b"], "left")
        .withColumn("bundle", bundle)
        .join(F.broadcast(by_bundle), "bundle", "left")
        .withColumn("shard", F.coalesce("own", "shared").cast("int"))
        .drop("own", "shared", "bundle")
    )


def number(rows: DataFrame) -> DataFrame:
    """Add ``slot``: gapless from 0 in each shard, by ``doc``; no shard has to fit into one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(
        rows.repartitionByRange(parts, "shard", "doc", "crc").withColumn("range", F.spark_partition_id()), "shards"
    )
    counts = ranged.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "range").orderBy("doc", "crc")
    # offsets: at most ranges + shards rows, as ranges of (shard, id) follow each other
    return (
        ranged.join(F.broadcast(offsets), ["shard", "range"])
        .withColumn("slot", (F.col("offset") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("range", "offset")
    )


def shard_documents(docs: DataFrame, shards: int = 24, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``size``, ``crc``, ``shard`` and ``slot`` of every document."""
    rows = stored(measure(docs, id, text), "sizes")
    return number(assign(rows, shards)).select("doc", "size", "crc", "shard", "slot")
