"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased (A-Z) and freed of punctuation at their ends. Every n-gram of an item is a seed, whatever number of
documents hold it. A choice by document counts would let copies hide each other: n-grams that one edited copy has broken are
rarer, as soon as the item has another copy, than those it still shares.

Documents are scanned once against a bitmap of fixed size. A find is a passage (the words around seeds, as far as the longest
item reaches); passages meet items by an ordinary join on the seed's hash. A (passage, item) pair is aligned with
matches +2, other words and gaps -1, unless an upper bound of its score is too low already; the score
is the best local alignment over that of a full copy. Texts themselves are never shuffled.

Common n-grams bring many pairs: their number is that of the documents that hold an n-gram times the items that do. The bound
spares these pairs the alignment, not the join.

Defined cases: NULL texts have no words. Items with fewer than ``GRAM`` words have their whole word sequence as
seed, so they are found where it occurs, not by a part of it. NULL ids are kept as ids (one document, or item, of that name); repeated rows report once, with their best score.
Empty tables give empty results. Extra columns are not read, or are carried along by ``drop_leaks``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from slicelake.llm.byte_bpe import Pieces
from slicelake.llm.common import bitmap, column, marked, stored, whole_row

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, 1
MIN_SCORE = 0.4           # of a full copy's score; chance alignments stay under 0.25
ENDS = b".,;:!?\"'()[]{}*#$%&|<>"
ALIGN_CELLS = 1 << 22     # words of padded passages aligned at once
MAX_WORDS = 1_000_000     # distinct words whose hashes a worker remembers


class Words:
    """Words of a text and their hashes."""

    def __init__(self):
        self.cache, self.hashes = Pieces(), np.zeros(1 << 14, np.uint64)

    def hashed(self, text: str) -> tuple[list[bytes], np.ndarray]:
        import xxhash

        words = text.encode().lower().split()
        numbers = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
        if self.cache.new:
            if len(self.cache) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(2 * len(self.cache), np.uint64)])
            fresh = [xxhash.xxh3_64_intdigest(bare(w)) for w in self.cache.new]
            self.hashes[len(self.cache) - len(fresh) : len(self.cache)] = np.array(fresh, np.uint64)
            self.cache.new.clear()
        h = self.hashes[numbers]
        if len(self.cache) > MAX_WORDS:
            self.cache = Pieces()
        return words, h


def chained(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words."""
    out = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width if len(out) else 0):
        out = (out ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def bare(word: bytes) -> bytes:
    return word.strip(ENDS) or word


_words: list[Words] = []


def shared_words() -> Words:
    if not _words:
        _words.append(Words())
    return _words[0]


def item_grams(items: DataFrame, id: str, text: str) -> DataFrame:
    """``item``, ``n_words``, ``words``, ``grams`` (hashes in order) of every item."""
    import pyarrow as pa

    def run(batches):
        cut = shared_words()
        for batch in batches:
            cells = [cut.hashed(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("item"), pa.array([len(w) for w, _ in cells], pa.int64()),
                pa.array([b" ".join(w) for w, _ in cells], pa.binary()), pa.array([chained(h, min(GRAM, max(1, len(h)))) for _, h in cells], pa.list_(pa.int64())),
            ], names=["item", "n_words", "words", "grams"])

    staged = items.select(column(id).cast("bigint").alias("item"), column(text).alias("text"))
    return staged.mapInArrow(run, "item bigint, n_words bigint, words binary, grams array<bigint>")


def passages(docs: DataFrame, seeds: DataFrame, reach: int, widths: list[int], id: str, text: str) -> DataFrame:
    """``doc``, ``start`` (word), ``words`` and ``hashes`` (seeds inside) of every passage around seeds."""
    import pyarrow as pa

    bits = bitmap(seeds)
    shape = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("words", pa.binary()), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        cut, filter_ = shared_words(), bits.value
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column("doc").to_pylist(), batch.column("text")):
                words, h = cut.hashed(t.as_py() or "")
                runs = [chained(h, w) for w in widths]
                places = [marked(x, filter_) for x in runs]
                at = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
                if not len(at):
                    continue
                breaks = np.flatnonzero(np.diff(at) > 2 * reach + GRAM) + 1      # windows that do not touch
                for some in np.split(at, breaks):
                    start = max(0, int(some[0]) - reach)
                    inside = words[start : int(some[-1]) + GRAM + reach]
                    rows.append({"doc": doc, "start": start, "words": b" ".join(inside), "hashes": np.unique(np.concatenate([x[p[(p >= some[0]) & (p <= some[-1])]] for x, p in zip(runs, places)]))})
            yield pa.RecordBatch.from_pylist(rows, shape)

    staged = docs.select(column(id).cast("bigint").alias("doc"), column(text).alias("text"))
    return staged.mapInArrow(run, "doc bigint, start bigint, words binary, hashes array<bigint>")


def align(items: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """Best local alignment score of each row of word numbers; rows are padded with -1 and -2."""
    best = np.zeros(len(items), np.int32)
    width = passages.shape[1]
    slope = GAP * np.arange(width, dtype=np.int32)
    above = np.zeros((len(items), width + 1), np.int32)
    for k in range(items.shape[1]):
        step = np.where(passages == items[:, k : k + 1], MATCH, MISMATCH).astype(np.int32)
        here = np.maximum(above[:, :-1] + step, above[:, 1:] - GAP)
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + slope, axis=1) - slope     # gaps along the passage
        np.maximum(best, here.max(1), out=best)
        above[:, 1:] = here
    return best


def bound(item: np.ndarray, passage: np.ndarray) -> int:
    """No alignment scores more: the best run of words, each a match if the item has it at all, else -1."""
    sums = np.concatenate([[0], np.cumsum(np.where(np.isin(passage, item), MATCH, -1))])
    return int((sums - np.minimum.accumulate(sums)).max())


def score_pairs(pairs: DataFrame, min_score: float) -> DataFrame:
    """Add ``score`` to rows of ``words`` (passage) and ``item_words``, both dropped, that reach ``min_score``."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            numbers: dict = {}

            def coded(cell):
                return np.array([numbers.setdefault(bare(w), len(numbers)) for w in cell.as_py().split(b" ")], np.int32)

            long, short = [coded(x) for x in batch.column("words")], [coded(x) for x in batch.column("item_words")]
            hopeful = [i for i in range(len(long)) if bound(short[i], long[i]) / (MATCH * len(short[i])) >= min_score]
            order = sorted(hopeful, key=lambda i: len(long[i]))
            scores = np.full(len(long), -1.0)
            while order:
                width = len(long[order[-1]])
                some, order = order[-max(1, ALIGN_CELLS // width) :], order[: -max(1, ALIGN_CELLS // width)]
                a = np.full((len(some), max(len(short[i]) for i in some)), -1, np.int32)
                b = np.full((len(some), width), -2, np.int32)
                for row, i in enumerate(some):
                    a[row, : len(short[i])], b[row, : len(long[i])] = short[i], long[i]
                scores[some] = align(a, b) / [MATCH * len(short[i]) for i in some]
            keep = np.isin(np.arange(len(long)), hopeful) & (scores >= min_score)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("item"), batch.column("start"), pa.array(scores)],
                names=["doc", "item", "start", "score"],
            ).filter(pa.array(keep))

    return pairs.mapInArrow(run, "doc bigint, item bigint, start bigint, score double")


def find_leaks(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", min_score: float = MIN_SCORE,
) -> DataFrame:
    """``doc``, ``item``, ``score`` (0 to 1) of every document and item that align well enough."""
    grams = stored(item_grams(items, item_id, item_text), "items")
    reach = 2 * (grams.agg(F.max("n_words")).first()[0] or 0)
    seeds = grams.select("item", F.explode("grams").alias("hash")).distinct()
    sizes = grams.where("n_words > 0").select(F.least("n_words", F.lit(GRAM))).distinct().collect()     # at most GRAM
    found = stored(passages(docs, seeds, reach, sorted(r[0] for r in sizes), id, text), "passages")
    met = (
        found.select("doc", "start", F.xxhash64("words").alias("version"), F.explode("hashes").alias("hash"))
        .join(seeds, "hash").select("doc", "start", "version", "item").distinct()
    )
    texts = grams.where("n_words > 0").select(F.col("item").alias("i"), F.col("words").alias("item_words")).distinct()
    pieces = found.select(
        F.col("doc").alias("d"), F.col("start").alias("s"), F.xxhash64("words").alias("v"), "words"
    ).dropDuplicates(["d", "s", "v"])
    pairs = (
        met.join(pieces, F.col("doc").eqNullSafe(F.col("d")) & (F.col("start") == F.col("s")) & (F.col("version") == F.col("v")))
        .join(texts, F.col("item").eqNullSafe(F.col("i")))
        .select("doc", "item", "start", "words", "item_words")
    )
    return score_pairs(pairs, min_score).groupBy("doc", "item").agg(F.max("score").alias("score"))


def drop_leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    leaked = find_leaks(docs, items, id, text, **options).select(F.col("doc").alias("leaked")).distinct()
    rows = docs.select(whole_row(docs), column(id).cast("bigint").alias("doc"))
    return rows.join(leaked, F.col("doc").eqNullSafe(F.col("leaked")), "left_anti").select("row.*")
