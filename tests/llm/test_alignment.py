"""Aligned tokens against whole texts encoded by the libraries and plain counting."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slicelake.llm import alignment, common, queries
from slicelake.llm.common import table

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(texts):
    """The contract on whole texts."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {v: k for k, v in _characters().items()}
    aligned = []
    for text in texts:
        raw = (" " + text).encode() if text else b""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            aligned.append([])
            continue
        ends = [set(), set()]
        for side, some in enumerate((bytes_a, bytes_b)):
            at = 0
            for t in some:
                at += len(t)
                ends[side].add(at)
        groups = [([], []) for _ in ends[0] & ends[1]]
        cuts = sorted(ends[0] & ends[1])
        for side, (ids, some) in enumerate(((ids_a, bytes_a), (ids_b, bytes_b))):
            at = group = 0
            for i, t in zip(ids, some):
                at += len(t)
                groups[group][side].append(i)
                group += at == cuts[group]
        aligned.append(groups)
    links = [Counter((x, y) for ga, gb in groups for x in ga for y in gb) for groups in aligned]
    count = Counter(p for some in links for p in some)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    for groups, some in zip(aligned, links):
        written = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        yield (
            sum(len(ga) for ga, _ in groups), sum(len(gb) for _, gb in groups), len(groups), sum(some.values()),
            sum(n for (x, y), n in some.items() if count[x, y] == most[x]), sum(n * count[p] for p, n in some.items()),
            hashlib.sha256(written.encode()).hexdigest() if groups else "",
        )


def _characters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "\n a \n", "a\tb c", "a\r\nb", "é漢😀 x", "x 漢字😀😀 y\nz",
    "a▁b c", "<|endoftext|> <s> </s>", "a\x00b c", "it's\n's 'll", "x\u00a0y z", "x\x1c y", "e\u0301 a", "1234 5,678.9%", "a" * 3000, "漢" * 400,
    "one two " * 2000, "ﬁ ½ Ⅷ", "x\u2028y z", "x \u3000 y", ".\nThe\n.", "  \n  x\n ",
]


def rows_of(frame):
    return sorted(tuple(r[n] for n in ["doc_id", *NAMES]) for r in frame.collect())


@pytest.mark.parametrize("hot", [alignment.HOT, 30])
def test_alignment_equals_whole_texts(spark, documents, hot):
    random.seed(4)
    parts = [" ", " ", "\n", "  ", "\t", "word", "Haus", "é", "漢", "😀", "▂", ".", "'s", "12", "\u00a0", "ing", "<"]
    texts = ODD + ["".join(random.choices(parts, k=random.randrange(40))) for _ in range(150)] + ODD[-3:]
    got = alignment.align_corpus(documents(list(enumerate(texts))), A, B, hot=hot)
    want = sorted((i, *x) for i, x in enumerate(plain(texts)))
    assert rows_of(got.select("row.doc_id", *NAMES)) == want
    written = {r["doc_id"]: r["groups"] for r in got.select("row.doc_id", "row.row", "groups").collect()}
    assert all(hashlib.sha256(written[i].encode()).hexdigest() == x[-1] for i, *x in want if x[-1])


def test_units_forgotten_and_pairs_flushed(spark, documents, monkeypatch):
    aligner = alignment.Aligner(A, B)
    texts = ["some words here", "other words there", "some words here"]
    first = [(n.tolist(), g, p.tolist(), t.tolist()) for n, g, p, t in aligner.align(texts)]
    monkeypatch.setattr(alignment, "MAX_UNITS", 2)
    again = [x for text in texts for x in aligner.align([text])]
    assert [(n.tolist(), g, p.tolist(), t.tolist()) for n, g, p, t in again] == first
    assert len(aligner.units) == 0


def test_defined_cases(spark, documents):
    assert alignment.align_corpus(documents([]), A, B).count() == 0
    got = alignment.align_corpus(documents([(None, "x y"), (None, "x y"), (1, None)]), A, B).collect()
    assert sorted(r["count_sum"] for r in got) == [0, 4, 4]


def test_frequent_takes_whole_classes(spark):
    rows = spark.range(1, 2000).select(F.col("id").alias("n"))
    assert common.frequent(rows, "n", 5000)[1] and common.frequent(rows, "n", 5000)[0].count() == 1999
    some, complete = common.frequent(rows, "n", 100)
    got = sorted(r["n"] for r in some.collect())
    assert not complete and 0 < len(got) <= 100 and got == list(range(2000 - len(got), 2000))
    assert common.frequent(rows, "n", 1)[0].count() == 0


def test_query_equals_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    want = sorted((r["doc_id"], *x) for r, x in zip(docs, plain([r["text"] for r in docs])))
    assert rows_of(queries.op13(spark, sf)) == want
