"""The dealt operators against brute force, libraries and round trips, with their defined cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slicelake.llm import (
    byte_bpe, components, decontaminate, line_dedup, minhash, quality_rules, sharding, suffix_dedup, token_counts,
    token_files, warc,
)

RANKS, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "no id"), (5, "é漢😀 <|endoftext|> x y"), (6, "a" * 5000), (7, "lorem ipsum " * 3000)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    found = WORD.findall(text or "")
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    count, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(inside)


def test_statistics_and_base_rules(documents):
    rows = ODD + [(8, "a b c a b c d"), (9, "x x x x"), (10, "l#1\nl#1\n\n\nl#1"), (11, words(0, 60))]
    got = quality_rules.judge(documents(rows), quality_rules.RuleList()).select("row.doc_id", "row.text", "judged.*").collect()
    assert len(got) == len(rows)
    for r in got:
        want = stats(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"])


def test_rules_learn_a_threshold():
    random.seed(1)
    x = np.array([[random.random(), random.random()] for _ in range(900)])
    good = ~((x[:, 0] > 0.7) & (x[:, 1] <= 0.4))
    rules = quality_rules.cover(x, good, ["words", "symbol_share"])
    assert rules.rules
    rejected = np.zeros(len(x), bool)
    for rule in rules.rules:
        rejected |= quality_rules._holds(x, [(["words", "symbol_share"].index(f), u, a) for f, u, a in rule])
    assert (rejected == ~good).mean() > 0.97 and not (rejected & good).any()
    assert not quality_rules.cover(x, np.ones(900, bool), ["words", "symbol_share"]).rules


def test_learned_rules_keep_clean_documents(spark, documents):
    good = [(i, words(i * 100, 80)) for i in range(60)]
    bad = [(100 + i, " ".join(f"w{i}{k}###" for k in range(80))) for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (1, None)], "doc_id bigint, quality int")
    kept = quality_rules.keep_good(documents(good + bad), labels)
    assert kept.columns == ["doc_id", "text", "row", "doc", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in good}
    assert quality_rules.learn_rules(documents([]), labels).rules == ()


def test_line_dedup(documents):
    shared, other = "A Shared line of text", "  a shared LINE of text\t"
    rows = [(3, f"{other}\nthree"), (1, f"one\n{shared}\n{shared}"), (2, shared), (4, "short\nshort"), (5, "short"), (None, f"{shared}\nnone"), *ODD]
    got = {}
    for r in line_dedup.mark_lines(documents(rows)).select("row.doc_id", "row.text", "n_lines", "n_dropped", "kept").collect():
        got[r["doc_id"], r["text"]] = (r["n_lines"], r["n_dropped"], r["kept"])
    assert got[1, rows[1][1]] == (3, 0, rows[1][1]) and got[2, shared] == (1, 1, "")
    assert got[3, rows[0][1]] == (2, 1, "three") and got[None, rows[5][1]] == (2, 1, "none")
    assert got[4, "short\nshort"] == (2, 0, "short\nshort") and got[1, None] == (1, 0, "")
    left = line_dedup.drop_repeated_lines(documents(rows))
    assert left.columns == ["doc_id", "text", "row", "doc", "n_chars"] and left.count() == len(rows)
    assert line_dedup.drop_repeated_lines(documents([])).count() == 0


def test_line_dedup_ships_a_text_once(spark):
    docs = spark.createDataFrame([(1, "a line of words\nmore of them"), (2, "A line of words "), (3, None)], "Doc bigint, Body string")
    marked = line_dedup.mark_lines(docs, "doc", "body")
    left = {r["Doc"]: (r["Body"], r["kept"]) for r in marked.select("row.*", "kept").collect()}
    assert left == {1: ("a line of words\nmore of them",) * 2, 2: ("A line of words ", ""), 3: (None, "")}
    plan = marked.select("row.Doc", "kept")._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    carried = [plan.left().output().apply(i).dataType().simpleString() for i in range(plan.left().output().size())]
    assert sorted(carried) == ["bigint", "bigint", "string"]      # id, hash of the text, text


def test_line_keys_are_made_once(spark):
    ends = ["", " ", "\t", "\x0b", "\x0c", "\r", " \t\r", "\u00a0", "\u2003", "\x1f"]
    lines = [a + body + b for a in ends for b in ends for body in ("", "A b\tC", "ÉA é Z", "x")]
    text = "\n".join(lines)
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "\n")], "doc_id bigint, text string")
    keys = {r["doc_id"]: r["k"] for r in docs.select("doc_id", line_dedup.line_keys(F.col("text")).alias("k")).collect()}
    lower = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    assert keys == {1: [x.strip(" \t\n\x0b\x0c\r").translate(lower) for x in lines], 2: [""], 3: ["", ""]}
    plan = line_dedup.mark_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    made = [x for x in plan.split("\n") if "trim(" in x]
    assert made and all("posexplode" in x or "Filter" not in x and "Project" not in x for x in made)     # not behind it


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(documents, encoding):
    random.seed(2)
    letters = "aeiou thnsr'  \n\t12.,é漢😀"
    rows = ODD + [(100 + n, "".join(random.choices(letters, k=random.choice([1, 9, 80, 2000])))) for n in range(40)]
    done = byte_bpe.encode_documents(documents(rows), RANKS, public_tokenizers.PATTERN)
    got = sorted(((r["row"]["doc_id"] or 0, r["ids"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in done.collect()), key=repr)
    want = []
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((i or 0, ids, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = byte_bpe.decode_documents(done, RANKS, public_tokenizers.PATTERN)
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for _, t in rows)


def test_long_pieces_merge_like_the_library(encoding):
    bpe = byte_bpe.loaded(RANKS, public_tokenizers.PATTERN)
    for text in ("ab" * 700, "." * 900, " " * 700 + "x", "".join(random.Random(3).choices("abcdefgh", k=3000))):
        assert np.concatenate([x for _, x in bpe.encode([text])]).tolist() == encoding.encode_ordinary(text)


def library_counts(texts):
    tokenizer = Tokenizer.from_file(WORDS)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_counts(documents):
    rows = ODD + [(8, "x" * 300 + " y"), (9, ("word" * 40 + " ") * 9), (10, "á ́ \x1c \x85 'S 12  z"), (11, words(0, 3000))]
    done = token_counts.count_tokens(documents(rows), WORDS).collect()
    want = library_counts([r[1] for r in rows])
    got = sorted((r["row"]["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in done)
    assert got == sorted((i or 0, len((t or "").encode()), len(x), len(x) > 2048) for (i, t), x in zip(rows, want))
    assert token_counts.count_tokens(documents([]), WORDS).count() == 0


def test_transducer_at_chunk_borders():
    machine = token_counts.Transducer(WORDS)
    for length in (1, 63, 64, 65, 126, 127, 128, 129, 300):
        text = ("q" * length + " ") * 5
        for _ in range(2):  # before and after compiling
            assert machine.emissions(np.frombuffer(text.encode(), np.uint8)).sum() == len(library_counts([text])[0])


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1001):
        x = (rng.integers(0, 1 << 32, n, np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        assert (token_files.unpack(*token_files.pack(x), n) == x).all()


def test_token_files(documents):
    rows = ODD + [(i, words(i, i)) for i in range(20, 60)]
    got = token_files.digests(token_files.token_files(documents(rows), WORDS, 2)).collect()
    assert len(got) == len(rows)
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    ids = [np.array([*x, 2], "<u4") for x in library_counts([t for _, t in rows])]
    assert Counter((r["doc"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, ids))
    assert [r["doc"] for r in sorted(got, key=lambda r: r["start"])] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert token_files.token_files(documents([]), WORDS, 2).count() == 0


def test_minhash_against_brute_force(documents):
    random.seed(4)
    base = [f"b{k}" for k in range(150)]
    texts = [" ".join(base)] + [" ".join("z%d" % random.randrange(10**6) if random.random() < p else w for w in base) for p in [0.01] * 30 + [0.04] * 30 + [0.1] * 30]
    texts += [words(1000 * k, 100) + " " + " ".join(base[:60]) for k in range(30)] + texts[:5] + ["A b", "a  B", "c"]
    rows = list(enumerate(texts)) + [(1000, None), (1001, " "), (None, texts[0]), (3, texts[3])]
    sets = {i: frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if (w := (t or "").lower().split()) else frozenset() for i, t in rows if i is not None}
    want = {i: i for i in sets}
    for _ in sets:
        changed = False
        for i in sets:
            for j in sets:
                if want[j] < want[i] and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    want[i], changed = want[j], True
        if not changed:
            break
    for block, deep in ((1024, 20_000), (8, 20)):
        got = minhash.near_duplicates(documents(rows), words=4, block=block, deep=deep).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc"] is not None:
                assert (r["n_shingles"], r["component"]) == (len(sets[r["doc"]]), want[r["doc"]])
            assert r["kept"] == (r["component"] == r["doc"])
    assert minhash.near_duplicates(documents([])).count() == 0
    assert minhash.drop_near_duplicates(documents(rows)).columns == ["doc_id", "text", "row", "doc", "n_chars"]


def test_pairs_of_deep_lists_that_share_one_coordinate(documents):
    rows, want, single = [], {}, 0
    for k in range(0, 120, 2):
        rows += [(k, words(1000 * k, 60)), (k + 1, words(1000 * k + 19, 60))]
        a, b = (minhash.Shingler(1).of(t) for _, t in rows[-2:])
        shared = minhash.signature(a) == minhash.signature(b)
        hits = (minhash.signature(a).view("<u2") == minhash.signature(b).view("<u2")).sum()
        linked = shared.any() and hits >= minhash.matches(50) and minhash.similar(a, b, 50)
        want |= {k: k, k + 1: k if linked else k + 1}
        single += int(linked and shared.sum() == 1)
    assert single > 3
    for deep in (20_000, 1):
        got = minhash.near_duplicates(documents(rows), words=1, percent=50, deep=deep).collect()
        assert {r["doc"]: r["component"] for r in got} == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


def test_sharding(documents):
    rows = [(i, "x" * (i % 97)) for i in range(500)] + [(1000 + i, "hot" * 50) for i in range(250)] + ODD
    got = sharding.shard_documents(documents(rows), 5).collect()
    assert len(got) == len(rows)
    shards, slots, loads = {}, {}, Counter()
    by_crc = {(len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows}
    for r in got:
        assert (r["size"], r["crc"]) in by_crc
        assert shards.setdefault((r["size"], r["crc"]), r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    hot = shards[158, zlib.crc32(b"hot" * 50)]
    rest = [loads[s] for s in range(5) if s != hot]
    assert max(rest) - min(rest) <= 36_008      # one text of 36,000 bytes, which cannot be split
    assert sharding.shard_documents(documents([])).count() == 0


def test_differencing_beats_nothing_it_could():
    assert sorted(Counter(sharding.difference([8, 7, 6, 5, 4], 2)).values()) == [2, 3]
    random.seed(5)
    sizes = [random.randrange(1, 1000) for _ in range(400)]
    loads = Counter()
    for size, shard in zip(sizes, sharding.difference(sizes, 7)):
        loads[shard] += size
    assert max(loads.values()) - min(loads.values()) <= 2
    assert sharding.difference([], 3) == []


def test_warc_round_trip(spark):
    rows = [(5, "a"), (3, "a"), (9, "a"), (9, "b"), (None, "a"), (None, None), (11, ""), (12, "\x1f\x8b\x08 WARC/1.1 " * 50), (13, "long " * 50_000)]
    pages = spark.createDataFrame([(i, "http://x/ y\n", h, "extra") for i, h in rows], "page_id bigint, url string, html string, body string")
    want = Counter()
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, h in rows:
        body = (h or "").encode()
        revisit = first.get(h or "", i) != i
        want[i, len(body), warc.digest_of(body), "revisit" if revisit else "response", first[h or ""] if revisit else None] += 1
    archives = warc.write_archives(pages)
    for split in (40, 700, 1 << 23):
        got = Counter(tuple(r) for r in warc.read_archives(archives, with_payload=False, split=split).collect())
        assert got == want
    texts = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(archives).where("record_type = 'response' and page_id > 9").collect()}
    assert texts == {i: (h or "").encode() for i, h in rows if i and i > 9}
    large = warc.read_archives(warc.write_archives(pages, min_bytes=2)).where("record_type = 'revisit'")
    assert large.count() == 0
    assert warc.read_archives(warc.write_archives(pages.where("page_id = 0"))).count() == 0


def test_leaks(spark, documents):
    random.seed(6)
    items = [(k, words(1000 * k, 40)) for k in range(1, 6)] + [(90, None), (91, "too short")]
    edited = " ".join("zz%d" % i if i % 6 == 5 else w for i, w in enumerate(items[1][1].split()))
    rows = [(1, words(50_000, 100) + " " + items[0][1].upper() + "! " + words(60_000, 90)), (2, edited), (3, words(70_000, 300)), (4, " ".join(items[2][1].split()[:6]) + words(80_000, 80))]
    rows += [(100 + i, words(90_000 + 500 * i, 30) + " " + items[3][1]) for i in range(30)] + ODD
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc"], r["item"]): r["score"] for r in decontaminate.find_leaks(documents(rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 2), *((100 + i, 4) for i in range(30))}
    assert got[1, 1] == 1.0 and 0.6 < got[2, 2] < 1
    left = decontaminate.drop_leaks(documents(rows), bench)
    assert left.columns == ["doc_id", "text", "row", "doc", "n_chars"] and left.count() == len(rows) - 34  # two odd rows share ids 1 and 2
    assert decontaminate.find_leaks(documents([]), bench).count() == 0
    assert decontaminate.find_leaks(documents(rows), bench.where("item_id < 0")).count() == 0


def plain_score(a, b):
    """Best local alignment of two texts over that of a full copy, cell by cell."""
    a, b = a.lower().split(), b.lower().split()
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        here = [0]
        for j, y in enumerate(b):
            here.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, here[j] - 1))
        above, best = here, max(best, *here)
    return best / (2 * len(a))


@pytest.mark.parametrize("exact", [0, 1, 40])
def test_copies_do_not_hide_other_copies(spark, documents, exact):
    items = [(k, words(1000 * k, 40)) for k in (1, 2, 3)]

    def edited(k, step, tag):
        return " ".join(f"{tag}{i}" if i % step == step - 1 else w for i, w in enumerate(items[k - 1][1].split()))

    rows = [(i, words(20_000 + 500 * i, 30) + " " + items[0][1] + " " + words(21_000 + 500 * i, 30)) for i in range(exact)]
    rows += [(200, edited(1, 5, "y")), (201, words(50_000, 200) + " " + edited(1, 4, "z") + " " + words(51_000, 200))]
    rows += [(300 + i, words(60_000 + 500 * i, 20) + " " + edited(2, 4, "x")) for i in range(30)]     # one edited version, often
    rows += [(400, edited(2, 5, "v")), (401, edited(3, 5, "u")), (500, words(90_000, 300) + " " + words(3000, 5))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc"], r["item"]): r["score"] for r in decontaminate.find_leaks(documents(rows), bench).collect()}
    plain = {(d, i): plain_score(item, text) for d, text in rows for i, item in items}
    assert got == {k: v for k, v in plain.items() if v >= decontaminate.MIN_SCORE}
    assert {(200, 1), (201, 1), (400, 2), (401, 3)} <= set(got)


def test_items_of_one_or_two_words_leak(spark, documents):
    bench = spark.createDataFrame([(1, "Solo!"), (2, "two words"), (3, "now three words"), (4, " "), (5, None)], "item_id bigint, text string")
    rows = [(10, words(0, 30) + " solo, " + words(50, 30)), (11, "TWO words."), (12, "words two"), (13, words(0, 9) + " now three words"), (14, "solo two words"), (15, "soloist"), (16, None)]
    got = {(r["doc"], r["item"], r["score"]) for r in decontaminate.find_leaks(documents(rows), bench).collect()}
    assert got == {(10, 1, 1.0), (11, 2, 1.0), (13, 3, 1.0), (14, 1, 1.0), (14, 2, 1.0)}


def test_alignment_against_a_plain_table():
    random.seed(7)
    for _ in range(30):
        a, b = (np.array([random.choices(range(4), k=random.randrange(1, 12))], np.int32) for _ in range(2))
        table = np.zeros((a.shape[1] + 1, b.shape[1] + 1), int)
        for i in range(a.shape[1]):
            for j in range(b.shape[1]):
                step = 2 if a[0, i] == b[0, j] else -1
                table[i + 1, j + 1] = max(0, table[i, j] + step, table[i, j + 1] - 1, table[i + 1, j] - 1)
        assert decontaminate.align(a, b)[0] == table.max()


def test_repeats_against_brute_force(documents):
    random.seed(8)
    passage = words(0, 55)
    rows = [(100 + i, f"{words(1000 * (i + 1), 20 + i)} {passage.upper() if i % 2 else passage} {words(1000 * (i + 1) + 500, 30)}") for i in range(12)]
    rows += [(50, words(0, 49) + " end"), (51, words(99_000, 200)), (52, words(99_100, 120)), (53, words(200_000, 70) + " " + words(200_000, 70)), *ODD]
    found = {i: (t or "").lower().split() for i, t in rows if i is not None}
    holders = {}
    for i, w in found.items():
        for k in range(len(w) - 49):
            holders.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = {(i, k + x) for i, w in found.items() for k in range(len(w) - 49) if len(holders[tuple(w[k : k + 50])]) > 1 for x in range(50)}
    got = {(r["doc"], k) for r in suffix_dedup.find_repeats(documents(rows)).collect() for k in range(r["start"], r["end"])}
    assert got == want
    assert suffix_dedup.find_repeats(documents([])).count() == 0


def test_repeats_beyond_the_neighbours(documents):
    """Cores that many documents hold sort the two whose words before them agree far apart."""
    draw, rows = np.random.default_rng(5), []
    for i in range(400):
        core, alone = words(1000 * (i % 5), 30), i % 80 >= 60
        lead = words(20_000 + 100 * i if alone else 100_000 + 100 * (i % 80), 20)
        tail = " ".join(f"t{x}" for x in draw.integers(0, 10**6, 60))
        rows.append((i, f"{words(200_000 + 100 * i, 40)} {lead} {core} {tail}"))
    rows += [(500, " ".join([words(0, 30)] * 8)), (None, f"{words(100_000, 20)} {words(0, 30)} no id")]
    windows = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            windows.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = set()
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            if len(windows[tuple(w[k : k + 50])]) > 1:
                want |= {(i, p) for p in range(k, k + 50)}
    found = suffix_dedup.find_repeats(documents(rows)).collect()
    assert {(r["doc"], k) for r in found for k in range(r["start"], r["end"])} == want
    assert all(r["doc"] != r["other"] for r in found) and len(found) > 250


def test_every_window_is_looked_up_at_one_place():
    """Also in texts of equal words, and whatever texts are cut in the same pass."""
    random.seed(5)
    texts = [" ".join(random.choices("abcdefgh", k=n)) for n in (700, 49, 0, 50, 3, 300)] + ["x " * 120, "a b c " * 40]
    cut = suffix_dedup.Places()
    split, found = cut.of(texts)
    least, most = found.spans(np.arange(len(found.at)))
    inside = found.inside(np.arange(len(found.at)))
    seen = [(n, p - k) for n, p, a, b in zip(found.text, inside, least, most) for k in range(a, b + 1)]
    seen = sorted((n, s) for n, s in seen if 0 <= s <= len(split[n]) - 50)
    assert seen == [(n, s) for n, w in enumerate(split) for s in range(len(w) - 49)]
    for n, t in enumerate(texts):
        alone = cut.of([t])[1]
        assert alone.at.tolist() == inside[found.text == n].tolist()
        assert alone.hashes.tolist() == found.hashes[found.text == n].tolist()


def test_byte_bpe_with_ids_above_16_bits(tmp_path):
    """All pairs of bytes and some longer tokens: more ids than 16 bits hold."""
    random.seed(12)
    tokens = [bytes([b]) for b in range(256)] + [bytes([a, b]) for a in range(256) for b in range(256)]
    known = set(tokens)
    while len(tokens) < 80_000:
        word = bytes(random.choices(b"abcdefgh", k=random.randrange(3, 6)))
        if word not in known:
            known.add(word), tokens.append(word)
        if len(known) > 256 + 65536 + 30_000:
            break
    path = tmp_path / "wide.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    library = tiktoken.Encoding("wide", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    texts = [" ".join("".join(random.choices("abcdefghxyz", k=random.randrange(1, 12))) for _ in range(200)) for _ in range(5)]
    bpe = byte_bpe.ByteBpe(str(path), public_tokenizers.PATTERN)
    got = {}
    for i, ids in bpe.encode(texts):
        got.setdefault(i, []).extend(ids.tolist())
    assert [got[i] for i in range(5)] == [library.encode_ordinary(t) for t in texts]
    assert max(max(ids) for ids in got.values()) > 65_535


def test_tokenizers_that_look_across_words_are_refused():
    assert token_counts.word_tokenizer(WORDS)
    with pytest.raises(ValueError, match="white space"):
        token_counts.word_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_are_shared_only_where_tokens_stay_the_same():
    """Capitals, points, marks that join letters and special strings, against the library on whole texts."""
    random.seed(21)
    parts = ["Word", "word", "H", "h", "I", "É", "E", "\u0301", "\u0331", "\u0307", ",", ".", "..", "!?", " ", "\n", "'S", "'s", "5", "²", "<|endoftext|>", "<|ENDOFTEXT|>", "漢", "K", "ſ", ";x", "A.B,C"]
    library = Tokenizer.from_file(WORDS)
    encoder = token_files.WordEncoder(WORDS)
    assert encoder.shares
    for special in (True, False):
        some = [p for p in parts if special or "<" not in p]
        texts = ["".join(random.choices(some, k=random.randrange(0, 30))) for _ in range(400)]
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        ids, counts = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
        ends = np.cumsum(counts)
        got = [ids[a:b].tolist() for a, b in zip(np.concatenate([[0], ends]), ends)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_small_letters_are_asked_together():
    """Ids equal the library's on whole texts; the full tokenizer is asked only for words that the model alone does not settle."""
    random.seed(22)
    parts = ["wort", "straße", "é", "È", "ÿ", "×", "÷", "слово", "й", "Й", "ё", "ſ", "\u0301", ".", ",", "...", "'s", "'", " ", " ", "\n", "7", "Q", "ŉ", "σ", "<|endoftext|>"]
    texts = ["".join(random.choices(parts, k=random.randrange(0, 40))) for _ in range(600)] + ["", " ", "q" * 5000, ".a", "a."]
    library, encoder = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS)
    asked = []

    class Spy:
        def encode_batch_fast(self, some, **options):
            asked.extend(some)
            return library.encode_batch_fast(some, **options)

    encoder.tokenizer = Spy()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    for _ in range(2):       # new words, then known ones
        ids, counts = encoder.encode(data, offsets)
        ends = np.cumsum(counts)
        got = [ids[a:b].tolist() for a, b in zip(np.concatenate([[0], ends]), ends)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked and not {"wort", "straße", "слово", "q" * 5000} & set(asked)
    assert len(asked) == len(set(asked))


def test_ids_are_counted_while_texts_are_encoded(documents):
    rows = ODD + [(i, words(i, i)) for i in range(20, 60)]
    encoded = token_files.encode_ids(documents(rows), WORDS, 2)
    ranked = token_files.rank_ids(encoded, Tokenizer.from_file(WORDS).get_vocab_size())
    counts = Counter(i for x in library_counts([t for _, t in rows]) for i in [*x, 2])
    assert [counts[int(i)] for i in ranked[: len(counts)]] == sorted(counts.values(), reverse=True)
    assert encoded.where("tally is null").count() == len(rows) and set(encoded.columns) == {"doc", "ids", "tally"}
