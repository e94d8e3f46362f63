"""Suffix-array dedup: repeated passages found in a sparse suffix array over all documents.

Of every ``WINDOW`` neighbouring n-grams of ``GRAM`` words the one with the smallest hash is kept, so both copies of a passage
keep the same places, and a passage of ``MIN_WORDS`` words has one among its first ``WINDOW`` words, with
``RUN`` words of the passage behind it. Only suffixes at such places whose first ``RUN`` words occur in two documents
are built. They are sorted over the whole corpus, compared with their neighbours in other documents, and
each match is extended to the right (the common beginning of both suffixes) and to the left (the words before them).
Matches of ``MIN_WORDS`` words or more are joined into maximal passages per document.

Documents are scanned twice: once for the hashes of the places, once, against a bitmap of fixed size, for
the suffixes that repeat, each cut to ``RIGHT`` words with ``LEFT`` words before it. A longer passage has further places
that carry it on. Equal places of several documents are one row of the array, found by an aggregate with map-side combine and joined
back at the end, the rows of one place dealt to ``SALTS`` parts. Sorting is by range, so a beginning that very many documents share spreads over tasks; the
first and last suffixes of a range also go to the ranges beside it.

A suffix is compared with ``NEIGHBOURS`` suffixes on either side. Those further away share at most as many words to the right
as the last one compared, but may share more to the left. So where more follow, every window of ``MIN_WORDS`` words
round the place that could still be shared and lies outside what was found is looked up by its hash among the windows of all
documents: no match is lost to the number of neighbours, and a window that many documents hold is one row after map-side combine.
A window is looked up at one place only, the least of its first ``WINDOW`` n-grams (the leftmost of equal ones), which is the same
place in every document that holds the window.

Defined cases: words are compared with A-Z lower-cased; NULL texts have none. NULL ids count as one document.
Repeated rows with one id are no repeat (a passage must occur in two documents). Empty tables give empty
results. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, chain
from operator import or_

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from slicelake.llm.common import bitmap, column, marked, slices, stored
from slicelake.llm.byte_bpe import Pieces

MIN_WORDS, GRAM, WINDOW = 50, 10, 36
RUN = MIN_WORDS - WINDOW + 1      # words behind the first place of a passage
LEFT, RIGHT = WINDOW, MIN_WORDS    # a passage's first place lies WINDOW - 1 words behind its start at most
NEIGHBOURS = 8                    # suffixes compared directly on either side; the rest by window hashes
MAX_WORDS = 1_000_000             # distinct words whose hashes a worker remembers
CHUNK = 300_000                   # characters of texts that are cut in one pass, or one longer text
SALTS = 64                        # parts into which the rows of one place are dealt when results are joined back


class Places:
    """Words of texts, the chosen places, and the hash of the RUN words behind each."""

    def __init__(self):
        self.cache, self.hashes = Pieces(), np.zeros(1 << 14, np.uint64)

    def of(self, texts: list[str]) -> tuple[list[list[bytes]], "Found"]:
        """All texts in one pass: their words one after the other, windows over the end of a text left out."""
        import xxhash

        words = [t.encode().lower().split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        numbers = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(words)), np.int64, sizes.sum())
        if self.cache.new:
            if len(self.cache) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(2 * len(self.cache), np.uint64)])
            fresh = np.fromiter(map(xxhash.xxh3_64_intdigest, self.cache.new), np.uint64, len(self.cache.new))
            self.hashes[len(self.cache) - len(fresh) : len(self.cache)] = fresh
            self.cache.new.clear()
        h = self.hashes[numbers]
        if len(self.cache) > MAX_WORDS:
            self.cache = Pieces()
        ends = np.cumsum(sizes)
        if len(h) < MIN_WORDS:
            none = np.zeros(0, np.int64)
            return words, Found(none, none, none, ends, np.zeros(0, np.uint64))
        grams = rolled(h, GRAM)
        # a place is chosen if it is the least of any window it lies in (equal hashes all are)
        least = sliding(grams, np.minimum)
        left = np.repeat(np.where(sizes < MIN_WORDS, 0, ends), sizes) - np.arange(len(h))
        least[left[: len(least)] < WINDOW + GRAM - 1] = 0
        edge = np.zeros(WINDOW - 1, np.uint64)
        at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), np.maximum) == grams)
        at = at[left[at] >= RUN]
        return words, Found(np.searchsorted(ends, at, "right"), at, rolled(h, RUN, at).view(np.int64), ends, grams)


class Found:
    """The places of some texts: ``text`` (its number), ``at`` (in the words of all), ``hashes``."""

    def __init__(self, text: np.ndarray, at: np.ndarray, hashes: np.ndarray, ends: np.ndarray, grams: np.ndarray):
        self.text, self.at, self.hashes, self.ends, self.grams = text, at, hashes, ends, grams

    def inside(self, some: np.ndarray) -> np.ndarray:
        """The place in its text."""
        return self.at[some] - np.where(self.text[some] > 0, self.ends[self.text[some] - 1], 0)

    def spans(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most words before the place in those windows of which it is the first least n-gram among the first WINDOW."""
        at, own = self.at[some], self.grams[self.at[some]]
        start, last = at - self.inside(some), self.ends[self.text[some]] - GRAM
        before, behind = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for far in range(1, WINDOW):
            more = (before == far - 1) & (at - far >= start)
            before += more & (self.grams[np.where(more, at - far, 0)] > own)
            more = (behind == far - 1) & (at + far <= last)
            behind += more & (self.grams[np.where(more, at + far, 0)] >= own)
        return WINDOW - 1 - behind, before


def chunks(column) -> Iterator[tuple[int, list[str]]]:
    """The texts of an Arrow column, those of some CHUNK characters at a time, and the number of the first."""
    texts = [t or "" for t in column.to_pylist()]
    for part in slices(np.fromiter(map(len, texts), np.int64, len(texts)), CHUNK):
        yield part.start, texts[part]


def sliding(values: np.ndarray, best) -> np.ndarray:
    """np.minimum or np.maximum over every WINDOW neighbours, by doubling."""
    width = 1
    while 2 * width <= WINDOW:
        values, width = best(values[:-width], values[width:]), 2 * width
    rest = WINDOW - width
    return best(values[: len(values) - rest], values[rest:])


def rolled(h: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of every ``width`` neighbouring values, or of those that begin ``at`` some places."""
    out = np.zeros(len(h) - width + 1 if at is None else len(at), np.uint64)
    for k in range(width):
        out ^= h[k : len(h) - width + 1 + k] if at is None else h[at + k]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


_places: list[Places] = []


def places() -> Places:
    if not _places:
        _places.append(Places())
    return _places[0]


def repeated_runs(staged: DataFrame) -> DataFrame:
    """``hash`` of the runs at chosen places that two documents have."""
    import pyarrow as pa

    def run(batches):
        cut = places()
        for batch in batches:
            for first, texts in chunks(batch.column("text")):
                found = cut.of(texts)[1]
                docs = batch.column("doc").take(pa.array(first + found.text))
                yield pa.RecordBatch.from_arrays([pa.array(found.hashes), docs], names=["hash", "doc"])

    held = staged.mapInArrow(run, "hash bigint, doc bigint")
    sides = held.groupBy("hash").agg(F.min("doc").alias("x"), F.max("doc").alias("y"), F.count_if(F.col("doc").isNull()).alias("z"))
    return sides.where("x <> y OR (z > 0 AND x IS NOT NULL)").select("hash")


def suffixes(staged: DataFrame, runs: DataFrame) -> DataFrame:
    """``hash``, ``suffix``, ``before`` (nearest word first), ``doc``, ``at``, ``least``, ``most`` of the places whose run may repeat.

    ``least`` and ``most`` are the words before the place in the windows that are looked up there, if they are. Every word ends in a blank, so sorting puts those that begin with the same words next to each other.
    """
    import pyarrow as pa

    bits = bitmap(runs)
    shape = pa.schema([("hash", pa.int64()), ("suffix", pa.binary()), ("before", pa.binary()), ("doc", pa.int64()), ("at", pa.int64()), ("least", pa.int8()), ("most", pa.int8())])

    def run(batches):
        cut, filter_ = places(), bits.value
        for batch in batches:
            for first, texts in chunks(batch.column("text")):
                words, found = cut.of(texts)
                chosen = marked(found.hashes, filter_)
                text, starts = found.text[chosen], found.inside(chosen)
                suffix, before = [], []
                for n, p in zip(text.tolist(), starts.tolist()):
                    own = words[n]
                    suffix.append(b" ".join([*own[p : p + RIGHT], b""]))
                    before.append(b" ".join([*own[max(0, p - LEFT) : p][::-1], b""]))
                least, most = found.spans(chosen)
                docs = batch.column("doc").take(pa.array(first + text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.hashes[chosen]), pa.array(suffix, pa.binary()), pa.array(before, pa.binary()), docs, pa.array(starts),
                     pa.array(least, pa.int8()), pa.array(most, pa.int8())], schema=shape,
                )

    return staged.mapInArrow(run, "hash bigint, suffix binary, before binary, doc bigint, at bigint, least tinyint, most tinyint")


def common(a: list[bytes], b: list[bytes]) -> int:
    """Words the two lists begin with alike."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def compare(rows: list[dict], own: range) -> list[dict]:
    """What each row in ``own`` shares with another document, and the windows of it that are left to look up.

    ``before`` and ``behind`` are the words shared on either side of the place.
    """
    out = []
    right = [r["suffix"].split(b" ")[:-1] for r in rows]
    left = [r["left"].split(b" ")[:-1] for r in rows]
    for i in own:
        row, before, behind, other, bound = rows[i], 0, 0, None, 0
        found = {"hash": row["hash"], "place": row["place"], "salts": row["salts"]}
        if row["many"]:
            if len(left[i]) + len(right[i]) >= MIN_WORDS:
                out.append(found | {"before": len(left[i]), "behind": len(right[i]), "x": row["x"], "y": row["y"]})
            continue
        for step in (-1, 1):
            j = i
            for _ in range(NEIGHBOURS):
                j += step
                if not 0 <= j < len(rows) or rows[j]["hash"] != row["hash"]:
                    break
                near = rows[j]
                b = len(right[i]) if near["suffix"] == row["suffix"] else common(right[i], right[j])
                if near["many"] or near["x"] != row["x"]:
                    a = len(left[i]) if near["left"] == row["left"] else common(left[i], left[j])
                    if a + b >= MIN_WORDS:
                        if a + b > before + behind or other is None:
                            other = near
                        before, behind = max(a, before), max(b, behind)
                        if before == len(left[i]) and behind == len(right[i]):
                            break
            else:
                j += step
                if not 0 <= j < len(rows) or rows[j]["hash"] == row["hash"]:
                    bound = max(bound, b)      # words that rows further away may share to the right
        if other:
            out.append(found | {"before": before, "behind": behind, "x": other["x"], "y": other["y"]})
        if bound and (before < len(left[i]) or behind < len(right[i])):
            for k, window in windows(left[i], right[i], max(row["least"], MIN_WORDS - bound), row["most"]):
                if k > before or MIN_WORDS - k > behind:
                    out.append(found | {"before": k, "behind": MIN_WORDS - k, "x": row["x"], "window": window})
    return out


def windows(left: list[bytes], right: list[bytes], least: int, most: int) -> list[tuple[int, int]]:
    """(words before the place, hash) of the windows of MIN_WORDS words with ``least`` to ``most`` words before the place."""
    import xxhash

    words = [*left[::-1], *right]
    text, at = b" ".join(words), [0, *accumulate(len(w) + 1 for w in words)]
    starts = ((k, len(left) - k) for k in range(max(least, MIN_WORDS - len(right)), min(most, len(left)) + 1))
    return [(k, xxhash.xxh3_64_intdigest(text[at[a] : at[a + MIN_WORDS] - 1]) - (1 << 63)) for k, a in starts]


def shared_windows(array: DataFrame, wanted: DataFrame) -> DataFrame:
    """``hash``, ``place``, ``salts``, ``before``, ``behind``, ``x``, ``y`` of the ``wanted`` windows that another document has, too."""
    import pyarrow as pa

    places_, sought = bitmap(wanted.select("hash")), bitmap(wanted.select(F.col("window").alias("hash")))
    shape = pa.schema([("window", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("many", pa.bool_())])

    def run(batches):
        for batch in batches:
            chosen = marked(batch.column("hash").to_numpy(), places_.value)
            for some in np.array_split(chosen, max(1, len(chosen) // 500)):      # at most 18,000 windows or so a time
                part = batch.take(pa.array(some))
                hashes, owner = [], []
                rows = zip(*(part.column(c).to_pylist() for c in ("left", "suffix", "least", "most")))
                for n, (left, suffix, least, most) in enumerate(rows):
                    found = windows(left.split(b" ")[:-1], suffix.split(b" ")[:-1], least, most)
                    hashes += [window for _, window in found]
                    owner += [n] * len(found)
                held = np.array(hashes, np.int64)
                at = marked(held, sought.value)
                own = part.select(["x", "y", "many"]).take(pa.array(np.array(owner, np.int64)[at]))
                yield pa.RecordBatch.from_arrays([pa.array(held[at]), *own.columns], schema=shape)

    kinds = "window bigint, x bigint, y bigint, many boolean"
    held = array.select("hash", "suffix", "left", "least", "most", "x", "y", "many").mapInArrow(run, kinds)
    two = held.groupBy("window").agg(*documents_of(F.min("x"), F.max("y"), F.count_if(F.col("x").isNull()), F.max("many"))).where("many")
    found = wanted.select("hash", "place", "salts", "before", "window").join(two, "window")
    return found.select("hash", "place", "salts", "before", (MIN_WORDS - F.col("before")).alias("behind"), "x", "y")


def documents_of(x, y, without_id, *many) -> list:
    """Least and greatest document of a group, and whether it has more than one (all rows without id being one)."""
    several = F.coalesce(x != y, F.lit(False)) | ((without_id > 0) & x.isNotNull())
    return [x.alias("x"), y.alias("y"), reduce(or_, many, several).alias("many")]


def find_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc``, ``start``, ``end`` (words, end excluded), ``other`` (a document that has some of it) of every passage.

    Passages are joined from matches of ``MIN_WORDS`` words or more; those of fewer than ``min_words`` words are left out.
    """
    import pyarrow as pa

    staged = docs.select(column(id).cast("bigint").alias("doc"), column(text).alias("text"))
    runs = stored(repeated_runs(staged), "runs")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sparse = stored(suffixes(staged, runs).withColumn("place", F.xxhash64("suffix", "before")), "suffixes")
    alike = sparse.groupBy("hash", "suffix", F.col("before").alias("left"), "place")
    # the parts that hold rows of the place, as bits: a place of few rows is not copied to all parts
    salt = F.pmod(F.xxhash64("doc", "at"), F.lit(SALTS)).cast("int")
    salts = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), salt)).alias("salts")
    holders = documents_of(F.min("doc"), F.max("doc"), F.count_if(F.col("doc").isNull()))
    # the same for all rows of a place
    span = [F.max(c).cast("bigint").alias(c) for c in ("least", "most")]
    array = stored(alike.agg(*holders, salts, *span), "array")
    order = ["hash", "suffix", "left"]
    kinds = "hash bigint, place bigint, before bigint, behind bigint, x bigint, y bigint, window bigint, salts bigint, least bigint, most bigint, suffix binary, left binary, many boolean"
    shape = pa.schema(
        [(n, pa.int64()) for n in ("hash", "place", "before", "behind", "x", "y", "window", "salts", "least", "most")]
        + [("suffix", pa.binary()), ("left", pa.binary()), ("many", pa.bool_())]
    )
    near = 2 * NEIGHBOURS

    def run(batches):
        """Matches and open windows inside a range; then its first and last rows, whose neighbours may be in another range."""
        held, done, first = [], 0, []      # the last rows, and how many of them have been compared
        for batch in batches:
            rows = held + batch.to_pylist()
            first = first + rows[len(held) :][: near - len(first)]
            stop = max(done, len(rows) - near)
            yield pa.RecordBatch.from_pylist(compare(rows, range(done, stop)), shape)
            keep = max(0, stop - near)
            held, done = rows[keep:], stop - keep
        yield pa.RecordBatch.from_pylist(compare(held, range(done, len(held))), shape)
        yield pa.RecordBatch.from_pylist(first + held[-near:], shape)

    def again(batches):
        rows = [row for batch in batches for row in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(compare(rows, range(len(rows))), shape)

    sorted_ = array.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    compared = stored(sorted_.mapInArrow(run, kinds), "matches")
    # a few rows of each range, so as many as there are ranges
    edges = compared.where("suffix IS NOT NULL").distinct().repartition(1).sortWithinPartitions(*order)
    compared = compared.where("suffix IS NULL").union(stored(edges.mapInArrow(again, kinds), "edges")).drop("suffix", "left", "many", "least", "most")
    direct = compared.where("window IS NULL").drop("window")
    shares = direct.unionByName(shared_windows(array, compared.where("window IS NOT NULL")))
    widest = shares.groupBy("hash", "place").agg(
        F.max("before").alias("before"), F.max("behind").alias("behind"), F.min("x").alias("x"), F.max("y").alias("y"), F.max("salts").alias("salts")
    )
    parted = widest.withColumn("salt", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftright(salts, s) & 1) = 1)")))
    # a document of the two that the row is not itself, NULL if that is the document without id
    other = F.when(F.col("doc").isNull() | (F.col("x") != F.col("doc")), F.col("x")).when(F.col("y") != F.col("doc"), F.col("y"))
    matches = sparse.select("hash", "place", "doc", "at", salt.alias("salt")).join(parted, ["hash", "place", "salt"]).select(
        "doc", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("behind")).alias("end"), other.alias("other")
    )
    in_order = Window.partitionBy("doc").orderBy("start", "end")      # the passages of one document
    reached = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opened = matches.withColumn("opens", F.when(F.col("start") < reached, 0).otherwise(1))
    chained = opened.withColumn("passage", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.groupBy("doc", "passage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other")
    ).where(F.col("end") - F.col("start") >= min_words).drop("passage")
