"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary documents.

The models predict the characters of words from the ``ORDER - 1`` before them. The highest order is class-conditional: absolute
discounting of the class's own counts. What it takes off is dealt out by the lower orders, which both classes share:
interpolated Kneser-Ney over continuation counts (in how many longer n-grams an n-gram ends) of all labelled words, so that
rare expressions, inflections and contexts only one class has seen are smoothed alike. A word's ratio is the difference
of its log-likelihoods under the two models; it counts beyond a margin of some nats, as models of unequal size differ on
any rare word. The fit below chooses among ``MARGINS`` (more labels, sharper models, larger margin). A document's evidence is the sum over its words divided by its number of characters, so length does not tell.
The score is a logistic function of the evidence's square root, fitted on labelled documents that were not counted (one in ``CALIBRATE``).

Everything corpus-wide is a Spark table that grows with the input: n-gram counts (summed per task before they are
shuffled), levels of continuation counts, ratios. A worker keeps the ``HOT`` most frequent ratios, a bound that does not
depend on the corpus. Words that need others are joined with the full table, so no ratio is lost; they are sums of
millionths of a nat, exact in any order. Labels are broadcast up to ``MAX_LABELS`` rows and joined by shuffling beyond.

Defined cases: words are split at Unicode white space after lower-casing. A NULL, empty or blank text has no evidence and gets
the score of evidence 0. Rows are scored one by one, so repeated rows and NULL ids need no rule. A document labelled both ways is toxic; labels
other than 0 and 1 and those without id are not read. Without labels of both classes no word has evidence, and the score is
(toxic + 1) / (labels + 3). An empty table gives an empty result. Results carry ``row`` as a struct, so extra columns cannot clash.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from slicelake.llm.common import column, frequent, ready, stored, whole_row

ORDER = 5
DISCOUNT = 0.75
MARGINS = (2, 3, 4)       # nats of a word's ratio that are no evidence; the fit chooses
SCALE = 1_000_000         # ratios are whole millionths of a nat
HOT = 1 << 18             # ratios a worker keeps
MAX_LABELS = 1 << 21      # labels that may be broadcast, two numbers each
CALIBRATE = 4             # one labelled document in so many fits the logistic function
FLUSH = 300_000           # distinct words a task counts before it passes n-grams on
MAX_WORDS = 500_000       # distinct words a worker remembers
BINS = 4096               # steps of the fit, over evidence up to BINS / STEP squared
STEP = 1000
START, END = "\x02", "\x03"


def grams_of(word: str) -> list[str]:
    padded = START * (ORDER - 1) + word + END
    return [padded[i : i + ORDER] for i in range(len(word) + 1)]


def count_grams(labelled: DataFrame) -> DataFrame:
    """``gram``, ``ordinary`` and ``toxic`` of rows with ``text`` and ``label`` 0 or 1."""
    import pyarrow as pa

    def flush(words):
        grams = (Counter(), Counter())
        for total, some in zip(grams, words):
            for word, n in some.items():
                for gram in grams_of(word):
                    total[gram] += n
        names = list(grams[0].keys() | grams[1].keys())
        for part in range(0, len(names), 50_000):
            some = names[part : part + 50_000]
            counts = [pa.array([total[g] for g in some], pa.int64()) for total in grams]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *counts], names=["gram", "ordinary", "toxic"])

    def run(batches):
        words = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                words[label].update((text.as_py() or "").lower().split())
                if len(words[0]) + len(words[1]) > FLUSH:
                    yield from flush(words)
                    words = (Counter(), Counter())
        yield from flush(words)

    counted = labelled.select("text", "label").mapInArrow(run, "gram string, ordinary bigint, toxic bigint")
    return counted.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _less(n: str) -> Column:
    return F.greatest(F.col(n) - DISCOUNT, F.lit(0.0))


def shared_probabilities(grams: DataFrame) -> DataFrame:
    """``lower`` and ``p`` of all n-grams of order ``ORDER - 1``: Kneser-Ney over the classes' n-grams together.

    Windows and joins here are per context or ending; a group is never larger than the alphabet.
    """
    levels, longer = [], grams
    for order in range(ORDER - 1, 0, -1):
        longer = longer.groupBy(F.substring("gram", 2, order).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.append(longer)
    known = levels.pop()
    whole = known.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    total, kinds = whole["n"] or 1, whole["kinds"]
    known = known.select(
        F.col("gram").alias("lower"), ((_less("n") + DISCOUNT * kinds / (kinds + 1)) / total).alias("p")
    )
    for order in range(2, ORDER):
        same = Window.partitionBy(F.substring("gram", 1, order - 1))
        level = levels.pop().select(
            "gram", F.substring("gram", 2, order - 1).alias("lower"), "n",
            F.sum("n").over(same).alias("total"), F.count(F.lit(1)).over(same).alias("kinds"),
        )
        known = level.join(known, "lower").select(
            F.col("gram").alias("lower"), ((_less("n") + DISCOUNT * F.col("kinds") * F.col("p")) / F.col("total")).alias("p")
        )
    return known


def ratios(grams: DataFrame) -> DataFrame:
    """``key``, ``ratio`` and ``n``: of n-grams seen, and of contexts (one letter shorter) for n-grams not seen in them."""
    context = F.substring("gram", 1, ORDER - 1)
    same = Window.partitionBy("context")
    counted = grams.select("gram", context.alias("context"), F.substring("gram", 2, ORDER - 1).alias("lower"), "ordinary", "toxic")
    for c in ("ordinary", "toxic"):
        counted = counted.withColumn(f"all_{c}", F.sum(c).over(same)).withColumn(f"kinds_{c}", F.count_if(F.col(c) > 0).over(same))
    left = {
        c: F.when(F.col(f"all_{c}") > 0, DISCOUNT * F.col(f"kinds_{c}") / F.col(f"all_{c}")).otherwise(1.0)
        for c in ("ordinary", "toxic")
    }
    own = {
        c: F.when(F.col(f"all_{c}") > 0, _less(c) / F.col(f"all_{c}")).otherwise(0.0) + left[c] * F.col("p")
        for c in ("ordinary", "toxic")
    }

    def whole(ratio):
        return F.round(F.log(ratio) * SCALE).cast("bigint").alias("ratio")

    seen = counted.join(shared_probabilities(grams), "lower").select(
        F.col("gram").alias("key"), whole(own["toxic"] / own["ordinary"]), (F.col("ordinary") + F.col("toxic")).alias("n")
    )
    others = counted.dropDuplicates(["context"]).select(
        F.col("context").alias("key"), whole(left["toxic"] / left["ordinary"]), (F.col("all_ordinary") + F.col("all_toxic")).alias("n")
    )
    return seen.unionByName(others)


class Words(dict):
    """word -> its ratio if above the least margin, else 0; words that need ratios a worker has not are put into ``cold``."""

    def __init__(self, hot: dict[str, int], complete: bool):
        super().__init__()
        self.hot, self.complete, self.cold = hot, complete, set()

    def __missing__(self, word: str) -> int:
        total = 0
        for gram in grams_of(word):
            ratio = self.hot.get(gram)
            if ratio is None:
                if not self.complete:
                    self.cold.add(word)
                    total = 0
                    break
                ratio = self.hot.get(gram[:-1], 0)
            total += ratio
        self[word] = out = total if total > MARGINS[0] * SCALE else 0
        return out


def evidence(docs: DataFrame, known: DataFrame, text: str = "text", hot: int = HOT) -> DataFrame:
    """``row`` (all columns but the text), ``evidence`` (for each margin, millionths of a nat) and ``positions``."""
    import pyarrow as pa

    spark = docs.sparkSession
    most, complete = frequent(known, "n", hot)
    most = most.select("key", "ratio").toArrow()  # at most ``hot`` rows
    kept = spark.sparkContext.broadcast((most.column("key").to_pylist(), most.column("ratio").to_pylist()))
    others = [c for c in docs.columns if c != text]
    staged = docs.select(whole_row(docs.select(*[column(c) for c in others])), column(text).alias("text"))
    schema = T.StructType([
        staged.schema["row"], T.StructField("evidence", T.ArrayType(T.LongType())), T.StructField("positions", T.LongType()),
        T.StructField("cold", T.ArrayType(T.StringType())), T.StructField("times", T.ArrayType(T.LongType())),
    ])

    def run(batches):
        table = dict(zip(*kept.value))
        words = Words(table, complete)
        for batch in batches:
            sums, positions, cold, times = [], [], [], []
            for text in batch.column("text"):
                found = (text.as_py() or "").lower().split()
                above = [ratio for ratio in map(words.__getitem__, found) if ratio]
                sums.append([sum(ratio - m * SCALE for ratio in above if ratio > m * SCALE) for m in MARGINS])
                positions.append(sum(map(len, found)) + len(found))
                open_ = Counter(filter(words.cold.__contains__, found)) if words.cold else {}
                cold.append(list(open_))
                times.append(list(open_.values()))
                if len(words) > MAX_WORDS:
                    words = Words(table, complete)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(sums, pa.list_(pa.int64())), pa.array(positions, pa.int64()),
                 pa.array(cold, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))],
                names=schema.names,
            )

    scored = stored(staged.mapInArrow(run, schema).withColumn("at", F.monotonically_increasing_id()), "toxic-evidence")
    if complete:
        return scored.select("row", "evidence", "positions")
    asked = scored.select("at", F.explode(F.arrays_zip("cold", "times")).alias("x")).select("at", "x.cold", "x.times")
    weights = stored(_weights(asked.select(F.col("cold").alias("word")).distinct(), known), "toxic-words")
    beyond = [F.col("times") * F.greatest(F.col("ratio") - m * SCALE, F.lit(0)) for m in MARGINS]
    added = (
        asked.join(weights, F.col("cold") == F.col("word"))
        .groupBy(F.col("at").alias("added_at")).agg(F.array(*[F.sum(x) for x in beyond]).alias("added"))
    )
    more = F.zip_with("evidence", "added", lambda a, b: a + b)
    joined = scored.join(added, F.col("at") == F.col("added_at"), "left").select(
        "row", F.coalesce(more, F.col("evidence")).alias("evidence"), "positions"
    )
    return stored(joined, "toxic-documents")


def _weights(words: DataFrame, known: DataFrame) -> DataFrame:
    """``word`` and ``ratio`` of distinct words that have evidence, by joins with all ratios."""
    padded = F.concat(F.lit(START * (ORDER - 1)), F.col("word"), F.lit(END))
    place = F.explode(F.sequence(F.lit(1), F.length("word") + 1))
    grams = words.select("word", place.alias("i")).select("word", padded.substr(F.col("i"), F.lit(ORDER)).alias("gram"))
    # n-grams of many words are looked up once
    distinct = grams.select("gram").distinct()
    direct = known.select(F.col("key").alias("gram"), F.col("ratio").alias("seen"))
    fallback = known.select(F.col("key").alias("context"), F.col("ratio").alias("unseen"))
    looked = (
        distinct.join(direct, "gram", "left").withColumn("context", F.substring("gram", 1, ORDER - 1))
        .join(fallback, "context", "left")
        .select("gram", F.coalesce("seen", "unseen", F.lit(0)).alias("ratio"))
    )
    total = grams.join(looked, "gram").groupBy("word").agg(F.sum("ratio").alias("ratio"))
    return total.where(F.col("ratio") > MARGINS[0] * SCALE)


def strength(evidence: Column, positions: Column) -> Column:
    return F.sqrt(F.coalesce(F.try_divide(evidence, positions * SCALE), F.lit(0.0)))


def fit(x: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Offset and slope of a logistic function by Newton's method, over binned values."""
    if not toxic.sum() or toxic.sum() == n.sum():
        return float(np.log((toxic.sum() + 1) / (n.sum() - toxic.sum() + 2))), 0.0
    rows, w = np.c_[np.ones(len(x)), x], np.zeros(2)
    ridge = np.diag([1e-6, 1e-3 * n.sum() / 1000])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve(rows.T @ (rows * (n * p * (1 - p) + 1e-12)[:, None]) + ridge, rows.T @ (toxic - n * p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-10:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def calibrate(found: DataFrame, labels: DataFrame, id: str = "doc_id") -> tuple[int, float, float]:
    """The margin that tells documents with ``label`` apart best, and its fit; at most ``BINS`` rows a margin come back."""
    marked = found.select(F.col("row")[id].cast("bigint").alias("doc"), "evidence", "positions").join(labels, "doc")
    values = F.array(*[
        F.struct(F.lit(i).alias("margin"), F.least(F.round(strength(F.col("evidence")[i], F.col("positions")) * STEP), F.lit(BINS)).alias("bin"))
        for i in range(len(MARGINS))
    ])
    counted = marked.select(F.explode(values).alias("v"), "label").groupBy("v.margin", "v.bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")
    )
    rows, best = counted.orderBy("margin", "bin").collect(), None
    for i in range(len(MARGINS)):
        x, n, toxic = (np.array([float(r[c]) for r in rows if r["margin"] == i]) for c in ("bin", "n", "toxic"))
        offset, slope = fit(x / STEP, n, toxic)
        p = np.clip(1 / (1 + np.exp(-(offset + slope * x / STEP))), 1e-9, 1 - 1e-9)
        loss = -float((toxic * np.log(p) + (n - toxic) * np.log(1 - p)).sum())
        if best is None or loss < best[0]:
            best = (loss, i, offset, slope)
    return best[1:]


def score_documents(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", hot: int = HOT
) -> DataFrame:
    """``row`` (all columns but the text), ``evidence``, ``positions``, ``score`` and ``predicted`` of every document."""
    ready(docs.sparkSession)
    marks = stored(
        labels.select(column(id).cast("bigint").alias("doc"), column(label).cast("int").alias("label"))
        .where(F.col("doc").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc").agg(F.max("label").alias("label"))
        .withColumn("held", F.pmod(F.xxhash64("doc"), F.lit(CALIBRATE)) == 0),
        "toxic-labels",
    )
    small = marks.count() <= MAX_LABELS
    counted, held = (marks.where(c).select("doc", "label") for c in ("NOT held", "held"))
    texts = docs.select(column(id).cast("bigint").alias("doc"), column(text).alias("text"))
    grams = stored(count_grams(texts.join(F.broadcast(counted) if small else counted, "doc")), "toxic-grams")
    known = stored(ratios(grams), "toxic-ratios")
    found = evidence(docs, known, text, hot)
    margin, offset, slope = calibrate(found, F.broadcast(held) if small else held, id)
    chosen = F.col("evidence")[margin]
    score = 1 / (1 + F.exp(-(F.lit(offset) + F.lit(slope) * strength(chosen, F.col("positions")))))
    return found.select("row", chosen.alias("evidence"), "positions", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
