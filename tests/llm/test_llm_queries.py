"""The registered corpus queries and the pipeline on the smallest tables."""

import base64
import hashlib
import re
import struct
import zlib

import corpus_pipeline
import oracle
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from slicelake.llm import queries
from slicelake.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLES:
        assert oracle.compare(frame, oracle.connect(SF), queries.ORACLES[name]) is None
    else:
        assert frame.count() > 0


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents").withColumnRenamed("lang", "row")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = corpus_pipeline.stored(after, name)
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] >= counts[4] > 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert r["n_tokens"] == len(r["ids"]) > 0


def test_pipeline_takes_no_documents(spark):
    docs = table(spark, SF, "documents").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def word_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    return {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def test_op8_equals_the_library(spark, texts):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op8(spark, SF).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_op4_equals_the_library(spark, word_ids):
    start = 0
    got = {r["doc_id"]: r for r in queries.op4(spark, SF).collect()}
    for i in sorted(word_ids):
        ids = [*word_ids[i], 2]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        assert got[i]["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)


def test_op10_equals_the_library(spark, texts, word_ids):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op10(spark, SF).collect()}
    assert got == {i: (len(t.encode()), len(word_ids[i]), len(word_ids[i]) > 2048) for i, t in texts.items()}


def test_op5_equals_brute_force(spark, texts):
    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        sets[i] = {tuple(words[k : k + 4]) for k in range(max(len(words) - 3, 1))} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op5(spark, SF).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_op9_equals_brute_force(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in table(spark, SF, "pages").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = {r["page_id"]: r for r in queries.op9(spark, SF).collect()}
    assert set(got) == set(pages)
    for i, body in pages.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(body), digest)
        mine = first[body] == i
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if mine else ("revisit", first[body]))


def test_op6_keeps_its_law(spark, texts):
    rows = queries.op6(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    sizes, slots, shard_of = {}, {}, {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert shard_of.setdefault(raw, r["shard"]) == r["shard"]     # groups of equal texts stay together
    assert set(sizes) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
