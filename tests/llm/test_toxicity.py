"""Toxicity scores against plain Kneser-Ney models, and on labels that were not learned from."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicelake.llm import queries, toxicity
from slicelake.llm.common import table

D, N = toxicity.DISCOUNT, toxicity.ORDER


class PlainModels:
    def __init__(self, ordinary, toxic):
        self.grams = [Counter(g for t in texts for w in t.lower().split() for g in toxicity.grams_of(w)) for texts in (ordinary, toxic)]
        kinds = set(self.grams[0]) | set(self.grams[1])
        self.levels = {}
        for order in range(N - 1, 0, -1):
            self.levels[order] = Counter(k[1:] for k in kinds)
            kinds = set(self.levels[order])
        self.after = [Counter(), Counter()]
        self.kinds = [Counter(), Counter()]
        for side in (0, 1):
            for g, n in self.grams[side].items():
                self.after[side][g[:-1]] += n
                self.kinds[side][g[:-1]] += 1

    def lower(self, gram):
        level = self.levels[len(gram)]
        same = {g: n for g, n in level.items() if g[:-1] == gram[:-1]}
        total, own = sum(same.values()), max(level[gram] - D, 0)
        rest = 1 / (len(level) + 1) if len(gram) == 1 else self.lower(gram[1:])
        return (own + D * len(same) * rest) / total

    def left(self, side, context):
        n = self.after[side][context]
        return D * self.kinds[side][context] / n if n else 1.0

    def ratio(self, gram):
        context = gram[:-1]
        if not (self.grams[0][gram] or self.grams[1][gram]):
            return math.log(self.left(1, context) / self.left(0, context))
        p = [
            (max(self.grams[s][gram] - D, 0) / self.after[s][context] if self.after[s][context] else 0)
            + self.left(s, context) * self.lower(gram[1:])
            for s in (0, 1)
        ]
        return math.log(p[1] / p[0])

    def evidence(self, text, margin):
        return sum(max(sum(map(self.ratio, toxicity.grams_of(w))) - margin, 0) for w in (text or "").lower().split())


def made(count):
    random.seed(8)
    syllables = ["ba", "do", "mi", "ru", "te", "lö"]
    rows, labels = [], []
    for i in range(count):
        text = ["".join(random.choices(syllables, k=random.randrange(1, 4))) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            text[::10] = [random.choice(["zonk", "zonker", "vix"]) + random.choice(["", "te", "ru"]) for _ in text[::10]]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.mark.parametrize("hot", [toxicity.HOT, 40])
def test_evidence_equals_the_plain_models(spark, documents, hot):
    rows, labels = made(60)
    more = rows + [(None, None), (900, ""), (901, " \n"), (902, "zonkba ZONKERS x"), (902, "zonkba ZONKERS x"), (903, "zonk " * 5000)]
    frame = spark.createDataFrame(labels + [(None, 1), (3, 9)], "doc_id bigint, toxic int")
    got = toxicity.score_documents(documents(more), frame, hot=hot).select("row.doc_id", "row.n_chars", "evidence", "positions", "score", "predicted").orderBy(F.col("doc_id").asc_nulls_last()).collect()
    held = {r[0] for r in spark.createDataFrame(labels, "doc bigint, l int").where(F.pmod(F.xxhash64("doc"), F.lit(toxicity.CALIBRATE)) == 0).collect()}
    plain = PlainModels(*[[t for (i, t), (_, y) in zip(rows, labels) if y == side and i not in held] for side in (0, 1)])
    margin = next(m for m in toxicity.MARGINS if abs(plain.evidence(more[0][1], m) - got[0]["evidence"] / toxicity.SCALE) < 0.01)
    assert got[0]["doc_id"] == 0
    want = sorted((i or -1, len(t or ""), plain.evidence(t, margin), sum(map(len, (t or "").split())) + len((t or "").split())) for i, t in more)
    found = sorted((r["doc_id"] or -1, r["n_chars"], r["evidence"] / toxicity.SCALE, r["positions"]) for r in got)
    assert [w[:2] + w[3:] for w in want] == [f[:2] + f[3:] for f in found]
    assert all(abs(w[2] - f[2]) <= 1e-5 * (w[3] + 1) for w, f in zip(want, found))
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    scores = {r["doc_id"]: r["score"] for r in got}
    assert min(scores[i] for i, y in labels if y) > max(scores[i] for i, y in labels if not y)


def test_defined_cases(spark, documents):
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    assert toxicity.score_documents(documents([]), labels).count() == 0
    for some, want in ((labels.where("false"), 1 / 3), (labels.withColumn("toxic", F.lit(0)), None)):
        got = toxicity.score_documents(documents([(1, "a b"), (2, None)]), some).collect()
        assert len({r["score"] for r in got}) == 1 and not any(r["predicted"] for r in got)
        assert want is None or abs(got[0]["score"] - want) < 1e-9


def test_fit_finds_a_logistic_function():
    x = np.linspace(0, 2, 400)
    n = np.full(400, 1000.0)
    toxic = n / (1 + np.exp(-(-3 + 5 * x)))
    offset, slope = toxicity.fit(x, n, toxic)
    assert abs(offset + 3) < 0.1 and abs(slope - 5) < 0.1


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op12(spark, sf).collect()}
    docs = {r["doc_id"] for r in table(spark, sf, "documents").select("doc_id").collect()}
    assert set(got) == docs
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in table(spark, sf, "labels").collect() if got[r["doc_id"]]["held_out"]]
    caught = [p for y, p in held if y == 1]
    clean = [p for y, p in held if y == 0]
    # some 240 toxic documents are learned from here, in four languages
    assert sum(caught) / len(caught) >= 0.7 and sum(clean) / len(clean) <= 0.02
