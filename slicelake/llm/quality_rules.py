"""Quality rules: a decision list learned by sequential covering, emitted as one Spark expression.

``stats_of`` measures a text with built-in functions only. ``learn_rules`` grows conjunctions of
thresholds on two thirds of the labelled rows, prunes each on the last third, keeps those precise
enough, takes out what they cover and goes on. ``RuleList.verdict`` is the ordered ``CASE WHEN``.

The learner sees at most ``MAX_LABELLED`` labelled rows (a documented bound: they pass the driver),
chosen by the hash of their id, so the choice spreads over the whole table and is the same each time.
All documents are measured and judged.

Defined cases: a NULL or empty text has no words and fails the base rules. Labels that are NULL or
without a document teach nothing; without labels of both kinds the list has no rules and keeps all that
passes the base. Repeated rows are judged alike; a doubly labelled document counts twice. Empty
tables give empty results. Only ids and statistics are returned, so extra columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from slicelake.llm.common import SPACES, WORD_BREAK, column, let, whole_row

MAX_LABELLED = 20_000     # labelled rows the learner may see
SYMBOLS = "#*$%&|<>"
WINDOW = 3                # words of a repeated window
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that the text holds twice or more."""

    def windows(w):
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.struct(F.xxhash64(*[w[i + k] for k in range(WINDOW)]).alias("h"), i.alias("i")),
        )

    def twice(s):  # s is sorted by hash: equal windows are neighbours
        last = F.size(s) - 1
        hits = F.filter(
            s,
            lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])),
        )
        return F.sort_array(F.transform(hits, lambda x: x["i"]))

    def covered(p):  # each start covers WINDOW words, less what the next start covers again
        steps = F.transform(p, lambda a, j: F.coalesce(F.least(F.lit(WINDOW), F.get(p, j + 1) - a), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, x: total + x)

    return let(
        words,
        lambda w: F.when(
            F.size(w) >= WINDOW,
            let(F.array_sort(windows(w)), lambda s: let(twice(s), covered)),
        ).otherwise(F.lit(0).cast("bigint")),
    )


def stats_of(text: Column) -> Column:
    """All statistics of a text as one struct."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    counted = let(
        words_of(body),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_words(w).alias("repeat")),
    )
    return let(
        counted,
        lambda c: F.struct(
            c["n"].alias("n_words"),
            F.length(F.translate(body, SPACES, "")).cast("bigint").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
            c["repeat"].alias("n_repeat_words"),
        ),
    )


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


# What the rules may test, over the struct of stats_of.
FEATURES = {
    "words": lambda s: s["n_words"].cast("double"),
    "word_length": lambda s: _ratio(s["word_chars"], s["n_words"]),
    "symbol_share": lambda s: _ratio(s["n_symbols"], s["word_chars"]),
    "symbols_per_word": lambda s: _ratio(s["n_symbols"], s["n_words"]),
    "dup_lines": lambda s: s["n_dup_lines"].cast("double"),
    "dup_lines_per_word": lambda s: _ratio(s["n_dup_lines"], s["n_words"]),
    "repeat_share": lambda s: _ratio(s["n_repeat_words"], s["n_words"]),
}


@dataclass(frozen=True)
class RuleList:
    """Ordered rules; each is a conjunction of (feature, is_upper_bound, threshold) that rejects."""

    rules: tuple[tuple[tuple[str, bool, float], ...], ...] = ()

    def verdict(self, s: Column) -> Column:
        """True where no rule rejects the statistics ``s``; the first rule that holds decides."""
        out = F
        for rule in self.rules:
            holds = F.lit(True)
            for feature, upper, at in rule:
                value = FEATURES[feature](s)
                holds = holds & (value <= at if upper else value > at)
            out = out.when(holds, F.lit(False))
        return F.lit(True) if out is F else out.otherwise(F.lit(True))

    def text(self) -> list[str]:
        return [" and ".join(f"{f} {'<=' if u else '>'} {a:.6g}" for f, u, a in r) for r in self.rules]


def _holds(x: np.ndarray, rule: list[tuple[int, bool, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, upper, at in rule:
        out &= x[:, j] <= at if upper else x[:, j] > at
    return out


def _grow(x: np.ndarray, bad: np.ndarray, max_tests: int, cuts: int) -> list[tuple[int, bool, float]]:
    """Add the test with the best information gain until the rule is pure or nothing helps."""
    rule: list[tuple[int, bool, float]] = []
    inside = np.ones(len(x), bool)
    while len(rule) < max_tests and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), inside.sum()
        best = (1e-9, None)
        for j in range(x.shape[1]):
            values = x[inside, j]
            order = np.argsort(values, kind="stable")
            ordered, hits = values[order], np.cumsum(bad[inside][order])
            ends = np.flatnonzero(ordered[1:] > ordered[:-1]) + 1    # rows up to a change of value
            if len(ends) > cuts:
                ends = ends[np.linspace(0, len(ends) - 1, cuts).astype(int)]
            for upper, p, n in ((True, hits[ends - 1], ends), (False, p0 - hits[ends - 1], n0 - ends)):
                gain = p * (np.log2((p + 1e-9) / n) - np.log2(p0 / n0))
                if len(gain) and gain.max() > best[0] * (1 + 1e-9):
                    k = int(gain.argmax())
                    best = (float(gain[k]), (j, upper, float((ordered[ends[k] - 1] + ordered[ends[k]]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _holds(x, [best[1]])
    return rule


def _prune(x: np.ndarray, bad: np.ndarray, rule: list) -> list:
    """The beginning of the rule that is worth most on rows it was not grown on."""

    def worth(r):
        inside = _holds(x, r)
        p, n = int(bad[inside].sum()), int(inside.sum())
        return (2 * p - n) / n if n else -1.0

    return max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (worth(r), -len(r)))


def cover(
    x: np.ndarray, good: np.ndarray, names: list[str], max_rules: int = 12, max_tests: int = 3,
    min_precision: float = 0.95, min_rows: int = 5, cuts: int = 256,
) -> RuleList:
    """Sequential covering over a matrix of features; ``good`` is the label."""
    third = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    rules: list = []
    while len(rules) < max_rules:
        grow, check = left & ~third, left & third
        if not (~good[grow]).any() or not good[grow].any() or not check.any():
            break
        rule = _grow(x[grow], ~good[grow], max_tests, cuts)
        if not rule:
            break
        rule = _prune(x[check], ~good[check], rule)
        inside, tested = _holds(x, rule) & left, _holds(x, rule) & check
        if tested.sum() < min_rows or (~good[tested]).mean() < min_precision or (~good[inside]).mean() < min_precision:
            break
        rules.append(tuple((names[j], upper, at) for j, upper, at in rule))
        left &= ~inside
    return RuleList(tuple(rules))


def learn_rules(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    max_labelled: int = MAX_LABELLED, **options,
) -> RuleList:
    """Measure the chosen labelled documents on Spark and learn the list from their statistics."""
    chosen = (
        labels.select(column(id).alias("doc"), column(label).cast("int").alias("label"))
        .where(F.col("doc").isNotNull() & F.col("label").isin(0, 1))
        .orderBy(F.xxhash64("doc"), "doc", "label")
        .limit(max_labelled)
    )
    # at most max_labelled rows of two numbers are broadcast
    wanted = docs.select(column(id).alias("doc"), column(text).alias("text")).join(F.broadcast(chosen), "doc")
    names = list(FEATURES)
    features = let(  # measured once: a filter or a second column would measure again
        stats_of(F.col("text")),
        lambda s: F.when(~base_failed(s), F.array(*[FEATURES[n](s) for n in names])),
    )
    rows = (
        wanted.select("label", F.xxhash64("doc").alias("at"), features.alias("features"))
        .orderBy("at", "features", "label")
        .limit(2 * max_labelled)  # repeated ids can add rows; the bound holds all the same
        .collect()
    )
    rows = [r for r in rows if r["features"] is not None]
    if not rows:
        return RuleList()
    data, good = np.array([r["features"] for r in rows]), np.array([r["label"] == 1 for r in rows])
    return cover(data, good, names, **options)


def passes(s: Column, rules: RuleList) -> Column:
    return ~base_failed(s) & rules.verdict(s)


def judge(docs: DataFrame, rules: RuleList, text: str = "text") -> DataFrame:
    """``row`` and, in ``judged``, the statistics, ``base_failed`` and ``kept`` of every document."""
    judged = let(
        stats_of(column(text)),
        lambda s: s.withField("base_failed", base_failed(s)).withField("kept", passes(s, rules)),
    )
    return docs.select(whole_row(docs), judged.alias("judged"))


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that pass the base and the learned rules, with their own columns."""
    rules = learn_rules(docs, labels, id, text, **options)
    return docs.where(let(stats_of(column(text)), lambda s: passes(s, rules)))
