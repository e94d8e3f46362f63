"""MinHash near-dedup: an inverted join on signature coordinates, confirmed on full shingle sets.

A signature has ``MINIMA`` minima of 16 bits; four neighbours make a coordinate, so there are
``COORDINATES`` of them. Every distinct shingle set is posted under each (coordinate, value). A pair is looked at in the
list of its first shared coordinate only (later ones skip it), its collisions are counted over all minima, and pairs
with at least ``matches(percent)`` are candidates. A pair at the threshold is missed with a probability of about 2 in a
million: 1 for the count (4.8 standard deviations), under 1 for sharing no coordinate.

No list emits all its pairs:

1. Per list a spanning forest of the candidates, best count first, is emitted and confirmed on the full sets.
2. Components of the confirmed links are formed. Lists are gone through again for candidates between different
   components; only rows of such pairs get their full sets, and the task that holds them confirms
   what is not yet connected. The components of all links together are the result.

Lists over ``BLOCK`` rows are cut into blocks and done block pair by block pair. Lists over ``DEEP`` rows (a passage that very many
documents share) are posted again under every second coordinate for step 1; step 2 also takes them whole, for the pairs
that share no second coordinate, unless all their rows are one component by then. That costs the square of a list
with several components. Equal sets are one row from the start. Only candidate documents' sets are ever shuffled.

Defined cases: a NULL, empty or wordless text has no shingles, is linked with nothing and its own component; a text with
fewer words than a shingle is one shingle. Rows with NULL ids have no component and stay. Rows with equal ids
are one document: each of its texts is compared, their links count together. Empty tables give empty
results. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from slicelake.llm.byte_bpe import Pieces
from slicelake.llm.common import column, stored, whole_row
from slicelake.llm.components import components

MINIMA, ROWS = 128, 4
COORDINATES = MINIMA // ROWS
BLOCK = 1024              # rows of a list that meet in one task, twice
DEEP = 20_000             # rows of a list that are posted again
NO_SECOND = -2            # c2 of a deep list taken whole
MAX_WORDS = 1_000_000     # distinct words whose hashes a worker remembers


def matches(percent: int) -> int:
    """Minima that must collide: 4.8 standard deviations below the expectation at the threshold."""
    p = percent / 100
    return max(1, math.floor(MINIMA * p - 4.8 * math.sqrt(MINIMA * p * (1 - p))))


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""

    def __init__(self, words: int):
        self.words, self.cache, self.hashes = words, Pieces(), np.zeros(1 << 14, np.uint64)

    def of(self, text: str) -> np.ndarray:
        import xxhash

        found = text.encode().lower().split()      # of bytes: A-Z and ASCII white space only
        numbers = np.fromiter(map(self.cache.__getitem__, found), np.int64, len(found))
        if self.cache.new:
            if len(self.cache) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(2 * len(self.cache), np.uint64)])
            fresh = np.fromiter(map(xxhash.xxh3_64_intdigest, self.cache.new), np.uint64, len(self.cache.new))
            self.hashes[len(self.cache) - len(fresh) : len(self.cache)] = fresh
            self.cache.new.clear()
        h = self.hashes[numbers]
        if len(self.cache) > MAX_WORDS:
            self.cache = Pieces()
        width = min(self.words, len(h))
        if not width:
            return h
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = (out ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """``COORDINATES`` 64-bit values, each of ``ROWS`` minima of 16 bits."""
    seeds = np.random.default_rng(20240229).integers(1, 1 << 63, (2, MINIMA), np.uint64)
    factor, shift = seeds[0] * np.uint64(2) + np.uint64(1), seeds[1]
    least = np.full(MINIMA, np.iinfo(np.uint64).max)
    for part in range(0, len(hashes), 2048):
        mixed = hashes[part : part + 2048, None] * factor
        mixed += shift
        np.minimum(least, mixed.min(0), out=least)
    short = ((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype("<u2")
    return short.view("<i8")


_shinglers: dict[int, Shingler] = {}


def shingler(words: int) -> Shingler:
    return _shinglers.setdefault(words, Shingler(words))


def signatures(docs: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """``doc``, ``n`` (shingles), ``key`` (128 bits that name the set), ``sig``."""
    import pyarrow as pa
    import xxhash

    shape = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sig", pa.list_(pa.int64()))])

    def run(batches):
        cut = shingler(words)
        for batch in batches:
            sets = [cut.of(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc"), pa.array(map(len, sets), pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ], schema=shape)

    staged = docs.select(column(id).cast("bigint").alias("doc"), column(text).alias("text"))
    return staged.mapInArrow(run, "doc bigint, n bigint, key binary, sig array<bigint>")


def _lists(sets: DataFrame, deep: int) -> DataFrame:
    """Rows of all lists with two members or more: ``list``, ``c``, ``c2``, ``size``, ``rep``, ``n``, ``sig``.

    ``c2`` is the second coordinate, -1 without one and ``NO_SECOND`` where pairs are to share no second one.
    """

    def shared(postings: DataFrame) -> DataFrame:
        sizes = postings.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        return postings.join(sizes, "list")

    coordinate = F.posexplode("sig").alias("c", "v")
    first = shared(
        sets.select("rep", "n", "key", coordinate).select(
            F.xxhash64("c", "v").alias("list"), "c", F.lit(-1).alias("c2"), "rep", "key"
        )
    )
    first = stored(first, "postings")
    plain = first.where(F.col("size") <= deep)
    again = (
        first.where(F.col("size") > deep).drop("size")
        .join(sets.select("rep", "key", "sig"), ["rep", "key"])
        .select("list", "c", "rep", "key", F.posexplode("sig").alias("second", "v"))
        .where("second > c")
        .select(F.xxhash64("list", "second", "v").alias("list"), "c", F.col("second").alias("c2"), "rep", "key")
    )
    whole = first.where(F.col("size") > deep).withColumn("c2", F.lit(NO_SECOND))
    return plain.unionByName(shared(again)).unionByName(whole).join(sets, ["rep", "key"]).select(
        "list", "c", "c2", "size", "rep", "key", "n", "sig"
    )


def _grouped(rows: DataFrame, run, schema: str, block: int) -> DataFrame:
    """Call ``run`` with the rows of each list, or of each pair of blocks of a long list, as numpy columns.

    Rows of a group are neighbours after a sort, so that many small groups cost no call of their own to Spark.
    """
    import pyarrow as pa

    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("rep", "key"), blocks).cast("int")
    staged = (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        .withColumn("group", F.xxhash64("list", "low", "high"))
        .drop("other", "list", "size")
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = staged.repartition(parts, "group").sortWithinPartitions("group", "rep", "key")

    def groups(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            keys = rest.column("group").to_numpy()
            ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if not len(ends):
                continue
            yield from cut(rest.slice(0, int(ends[-1])), ends)
            rest = rest.slice(int(ends[-1]))
        if rest is not None and rest.num_rows:
            yield from cut(rest, np.array([rest.num_rows]))

    def cut(table, ends):
        columns = {}
        for name in table.column_names:
            if name == "sig":
                columns[name] = table.column(name).combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
            elif name in ("set", "key"):
                columns[name] = np.array(table.column(name).to_pylist(), object)
            else:
                columns[name] = table.column(name).to_numpy()
        start = 0
        for end in ends.tolist():
            yield {k: v[start:end] for k, v in columns.items()}
            start = end

    def whole(batches):
        held = []
        for group in groups(batches):
            held += run(group)
            if len(held) >= 10_000:
                yield pa.RecordBatch.from_pylist(held, shape)
                held = []
        yield pa.RecordBatch.from_pylist(held, shape)

    shape = pa.schema([(f.split()[0], {"bigint": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in schema.split(", ")])
    return sorted_.mapInArrow(whole, schema)


def _candidates(g: dict, need: int, percent: int):
    """(matches, i, j) of the pairs of a group that belong to its list and collide often enough."""
    n = len(g["rep"])
    minima, sig, sizes = np.ascontiguousarray(g["sig"]).view("<u2").reshape(n, MINIMA), g["sig"], g["n"]
    c, c2 = int(g["c"][0]), int(g["c2"][0])
    within = g["low"][0] == g["high"][0]
    for i in range(n - 1):
        far = np.arange(i + 1, n)
        if not within:
            far = far[g["own"][far] != g["own"][i]]
        if "comp" in g:
            far = far[g["comp"][far] != g["comp"][i]]
        small, large = np.minimum(sizes[far], sizes[i]), np.maximum(sizes[far], sizes[i])
        far = far[(100 * small >= percent * large) & (sig[far, c] == sig[i, c])]
        if not len(far):
            continue
        hits = (minima[far] == minima[i]).sum(1)
        far, hits = far[hits >= need], hits[hits >= need]
        if not len(far):
            continue
        same = sig[far] == sig[i]
        mine = same.argmax(1) == c
        if c2 >= 0:
            same[:, c] = False
            mine &= same.argmax(1) == c2
        elif c2 == NO_SECOND:
            mine &= same.sum(1) == 1
        for hit, j in zip(hits[mine].tolist(), far[mine].tolist()):
            yield hit, i, j


class Union:
    """Union-find over the rows of one group."""

    def __init__(self, labels):
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[j] = i
        return i != j


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def links(docs: DataFrame, sets: DataFrame, id: str, text: str, words: int, percent: int, block: int, deep: int) -> DataFrame:
    """Confirmed links ``a``, ``b`` whose components are those of all links."""
    import pyarrow as pa

    need = matches(percent)
    lists = stored(_lists(sets, deep), "lists")

    def forest(g):
        union = Union(range(len(g["rep"])))
        best = sorted(_candidates(g, need, percent), key=lambda x: (-x[0], x[1], x[2]))
        return [
            {"a": int(g["rep"][i]), "ka": g["key"][i], "b": int(g["rep"][j]), "kb": g["key"][j]}
            for _, i, j in best if union.join(i, j)
        ]

    shallow = lists.where(F.col("c2") != NO_SECOND)
    pairs = stored(_grouped(shallow, forest, "a bigint, ka binary, b bigint, kb binary", block).distinct(), "pairs")

    named = lists.select("rep", "key").distinct()
    wanted = docs.select(column(id).cast("bigint").alias("rep"), column(text).alias("text")).join(
        named.select("rep").distinct(), "rep", "left_semi"
    )

    def cut_sets(batches):
        import xxhash

        cut = shingler(words)
        for batch in batches:
            found = [cut.of(t.as_py() or "").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), pa.array([xxhash.xxh3_128_digest(s) for s in found], pa.binary()), pa.array(found, pa.binary())],
                names=["rep", "key", "set"],
            )

    full = stored(wanted.mapInArrow(cut_sets, "rep bigint, key binary, set binary").dropDuplicates(["rep", "key"]), "shingles")

    def confirm(batches):
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("sa", "sb"))
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sides = [full.select(F.col("rep").alias(s), F.col("key").alias(f"k{s}"), F.col("set").alias(f"s{s}")) for s in "ab"]
    joined = pairs.join(sides[0], ["a", "ka"]).join(sides[1], ["b", "kb"]).select("a", "b", "sa", "sb")
    sure = stored(joined.mapInArrow(confirm, "a bigint, b bigint"), "links")

    named_components = stored(components(sure), "components").withColumnRenamed("node", "rep")
    labelled = lists.join(named_components, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    labelled = stored(
        labelled.join(
            labelled.groupBy("list").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("list"), "list"
        ),
        "open-lists",
    )

    def touched(g):
        rows = {k for _, i, j in _candidates(g, need, percent) for k in (i, j)}
        return [{"rep": int(g["rep"][k]), "key": g["key"][k]} for k in rows]

    # a text is in few open pairs or in many: either way its set travels once to each list it is open in
    still = _grouped(labelled, touched, "rep bigint, key binary", block).distinct()
    carried = stored(full.join(still, ["rep", "key"]), "open-shingles")

    def finish(g):
        union, out = Union(g["comp"].tolist()), []
        sets_ = [np.frombuffer(x, np.uint64) for x in g["set"]]
        for _, i, j in sorted(_candidates(g, need, percent), key=lambda x: (-x[0], x[1], x[2])):
            if union.root(i) != union.root(j) and similar(sets_[i], sets_[j], percent):
                union.join(i, j)
                out.append({"a": int(g["rep"][i]), "b": int(g["rep"][j])})
        return out

    late = _grouped(labelled.join(carried, ["rep", "key"]), finish, "a bigint, b bigint", block)
    return sure.union(late)


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
    block: int = BLOCK, deep: int = DEEP,
) -> DataFrame:
    """``doc``, ``n_shingles``, ``component``, ``kept`` of every row."""
    marked = stored(signatures(docs, id, text, words), "signatures")
    sets = (
        marked.where(F.col("doc").isNotNull() & F.col("key").isNotNull())
        .groupBy("key").agg(F.min("doc").alias("rep"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    )
    sets = stored(sets, "sets")
    found = links(docs, sets, id, text, words, percent, block, deep)
    # rows with one id are one document, so its sets are linked through it
    same = marked.where("doc IS NOT NULL").join(sets.select("key", "rep"), "key").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    named = stored(components(found.union(same.where("a <> b"))), "components")
    of_doc = F.coalesce("component", "doc")
    return (
        marked.select("doc", F.col("n").alias("n_shingles"))
        .join(named, F.col("doc") == F.col("node"), "left")
        .select("doc", "n_shingles", of_doc.alias("component"), (of_doc.eqNullSafe(F.col("doc"))).alias("kept"))
    )


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without those whose component has a smaller id; their own columns."""
    gone = near_duplicates(docs, id, text, **options).where(~F.col("kept")).select("doc").distinct()
    rows = docs.select(whole_row(docs), column(id).cast("bigint").alias("doc"))
    return rows.join(gone, "doc", "left_anti").select("row.*")
