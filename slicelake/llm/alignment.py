"""Alignment of two tokenizers' tokens by spans of bytes.

Tokenizer A is a byte-level BPE of the tokenizers library, B a BPE of sentencepiece with byte fallback; both
encode a space and the text (B adds the space itself). The libraries' spans are the coarse cuts: A's character
offsets, and the spans of the pieces in B's protobuf result. Where several tokens share a character (A) or
a piece is a byte (B), the coarse span is refined by the length of the decoded bytes. Where tokens of both end, the text is cut into groups.

Both tokenizers cut before a single blank or line feed between two other characters, and between a letter or digit and
one of ``POINTS``, whatever stands around: A's pattern starts a match there, and no piece of B goes over it (checked when the
vocabulary is loaded). So texts are cut into such units, a worker encodes and aligns a unit once, thousands in
one numpy pass, and a document is the sequence of its units.

The count of an id pair (in how many documents it is linked) is taken over the whole corpus: tasks count distinct pairs, Spark
sums them and finds the highest of each A id. A worker keeps the most frequent pairs, at most ``HOT``; the pairs of a document that are not
among them are joined with the full table. Documents' distinct pairs are stored once, sorted and as differences, so texts are encoded once.

Defined cases: a NULL or empty text, or one whose joined token bytes differ from the space and the text (it holds U+2581), has no
tokens: zeros and an empty digest. Rows are handled one by one, so repeated rows count twice as documents and
NULL ids need no rule. An empty table gives an empty result. Results carry ``row`` as a struct, so extra columns cannot clash. A text
without blanks is one unit and held in memory whole; pairs of a group are counted by distinct ids, not by occurrences.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from slicelake.llm.byte_bpe import IdStore, Pieces, gather
from slicelake.llm.common import column, frequent, ready, stored, whole_row
from slicelake.llm.token_counts import quiet_tokenizer

HOT = 1 << 20             # pairs a worker keeps
MAX_UNITS = 700_000       # distinct units a worker remembers
MAX_KNOWN = 1 << 23       # pairs of remembered units
LARGE = 1 << 12           # links of a group whose pairs are counted by distinct ids
POINTS = ",.;:!?"
FLUSH = 1 << 22           # pairs a task counts before it passes them on
BLANK = "▁"

ODD = re.compile(r"\s\s|[^\S \n]|\s\Z")       # white space that does not just separate two words
BREAK = re.compile(r"(?<=\S)(?=[ \n]\S)")


class BytesOfIds:
    """Byte-level vocabularies write bytes as characters: printable ones as themselves, the others from 256 on."""

    def __init__(self, tokenizer):
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}
        size = tokenizer.get_vocab_size()
        self.tokens = [bytes(byte[c] for c in tokenizer.id_to_token(i)) if all(c in byte for c in tokenizer.id_to_token(i)) else b"" for i in range(size)]


class Runs(IdStore):
    """Numbers of units, many units added at once."""

    def __init__(self):
        super().__init__()
        self.flat = self.flat.astype(np.int64)

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        n = len(lengths)
        self.flat = self._room(self.flat, self.used + len(values))
        self.starts, self.lengths = self._room(self.starts, self.count + n), self._room(self.lengths, self.count + n)
        self.flat[self.used : self.used + len(values)] = values
        self.starts[self.count : self.count + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.count : self.count + n] = lengths
        self.used, self.count = self.used + len(values), self.count + n


class Flat:
    """Byte strings of ids, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def of(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.bytes, self.starts[ids], self.lengths[ids])


class Aligner:
    """Both tokenizers and the units a worker knows."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = quiet_tokenizer(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = len(self.b)
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        if any(re.search(f"[^{BLANK}]{BLANK}|\n", p) for p in pieces):
            raise ValueError(f"{path_b} has pieces that go over the end of a word")
        over = "".join({m for p in pieces for m in re.findall(rf"([^\W_])[{POINTS}]", p)})
        self.unit = re.compile(rf"\s[^\s{POINTS}]*[^\W_{re.escape(over)}](?=[{POINTS}])|\s?\S+")
        self.is_byte = np.array([self.b.is_byte(i) for i in range(size)])
        self.bytes_a = Flat(BytesOfIds(self.a).tokens)
        self.bytes_b = Flat([
            bytes([int(p[1:-1], 16)]) if byte else p.replace(BLANK, " ").encode() for p, byte in zip(pieces, self.is_byte)
        ])
        # how an id is written: A's before another one and at its group's end, then B's
        numbers_a, numbers_b = [b"%d" % i for i in range(len(self.bytes_a.lengths))], [b"%d" % i for i in range(size)]
        self.written = [n + end for some, ends in ((numbers_a, b",|"), (numbers_b, b",;")) for end in (ends[:1], ends[1:]) for n in some]
        self.written_lengths = np.fromiter(map(len, self.written), np.int64, len(self.written))
        self.width = size
        self._forget()

    def _forget(self) -> None:
        self.units = Pieces()
        self.texts: list[bytes] = []                                # groups of a unit as they are written, each with its end
        # n_a, n_b, n_groups, n_links, whether the bytes are right; linked pairs and how often each is
        self.numbers, self.pairs, self.times = Runs(), Runs(), Runs()

    def cut(self, text: str) -> list[str]:
        """A space and the text, in units."""
        spaced = " " + text
        return BREAK.split(spaced) if ODD.search(spaced) else self.unit.findall(spaced)

    def _tokens_a(self, some: list[str], bases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit, id and byte offset of the end of every token."""
        found = self.a.encode_batch(some, add_special_tokens=False)
        ids = np.array(list(chain.from_iterable(e.ids for e in found)), np.int64)
        unit = np.repeat(np.arange(len(some)), [len(e.ids) for e in found])
        spans = np.array(list(chain.from_iterable(chain.from_iterable(e.offsets for e in found))), np.int64).reshape(-1, 2)
        exact = within(self.bytes_a.lengths[ids], unit) + bases[unit]
        # character offsets are byte offsets behind what is ASCII; elsewhere characters are turned into bytes
        wide = np.flatnonzero([not u.isascii() for u in some])
        chars = np.array([len(u) for u in some])
        firsts = np.cumsum(chars + 1) - chars - 1
        at = np.arange(int((chars + 1).sum())) - np.repeat(firsts, chars + 1)
        for i in wide.tolist():
            at[firsts[i] : firsts[i] + chars[i] + 1] = np.cumsum([0] + [len(c.encode()) for c in some[i]])
        coarse = at[firsts[unit] + spans[:, 1]] + bases[unit]
        # where the next token has a part of the last character, the decoded bytes say where this one ends
        shared = np.zeros(len(ids), bool)
        shared[:-1] = (unit[1:] == unit[:-1]) & (spans[1:, 0] < spans[:-1, 1])
        return unit, ids, np.where(shared, exact, coarse)

    def _tokens_b(self, some: list[str], bases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of B, which puts a blank before a text: the unit's own, or one in front of a line feed that no piece goes over."""
        own = [u[0] == " " for u in some]
        asked = [u[1:] if mine else u if u[0] == "\n" else "\n" + u for u, mine in zip(some, own)]
        skipped = [0 if mine else 1 if u[0] == "\n" else 2 for u, mine in zip(some, own)]
        protos = self.b.encode(asked, return_type="proto", num_threads=1)
        rows = [[(p.id, p.end) for p in list(proto.pieces)[skip:]] for proto, skip in zip(protos, skipped)]
        unit = np.repeat(np.arange(len(some)), [len(r) for r in rows])
        found = np.array(list(chain.from_iterable(chain.from_iterable(rows))), np.int64).reshape(-1, 2)
        ids = found[:, 0]
        before = np.array([1 if mine else 0 if u[0] == "\n" else -1 for u, mine in zip(some, own)])
        exact = within(self.bytes_b.lengths[ids], unit)
        # the spans of a character's bytes all end with it
        return unit, ids, np.where(self.is_byte[ids], exact, found[:, 1] + before[unit]) + bases[unit]

    def learn(self, some: list[str]) -> None:
        """Encode and align units."""
        raw = [u.encode() for u in some]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        bases = np.cumsum(sizes) - sizes
        a, b = self._tokens_a(some, bases), self._tokens_b(some, bases)
        right = np.ones(len(some), bool)
        text = np.frombuffer(b"".join(raw), np.uint8)
        for (unit, ids, _), known in ((a, self.bytes_a), (b, self.bytes_b)):
            lengths = np.bincount(unit, known.lengths[ids], len(some)).astype(np.int64)
            right &= lengths == sizes
            same = lengths == sizes
            decoded, own = known.of(ids[same[unit]]), text[np.repeat(same, sizes)]
            wrong = np.repeat(np.flatnonzero(same), sizes[same])[decoded != own]
            right[wrong] = False
        (unit_a, ids_a, ends_a), (unit_b, ids_b, ends_b) = ([x[right[t[0]]] for x in t] for t in (a, b))
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        links = in_a * in_b
        group_unit = unit_a[first_a]
        n = len(some)
        table = np.stack([
            np.bincount(unit_a, minlength=n), np.bincount(unit_b, minlength=n), np.bincount(group_unit, minlength=n),
            np.zeros(n, np.int64), right,
        ], axis=1).astype(np.int64)
        np.add.at(table[:, 3], group_unit, links)
        # every token of A with every one of B in its group; large groups by distinct ids
        small = links <= LARGE
        of_a = small[group_a]
        repeats = in_b[group_a[of_a]]
        left = np.repeat(ids_a[of_a], repeats)
        group = np.repeat(group_a[of_a], repeats)
        place = np.arange(len(left)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
        pairs, times, owner = left * self.width + ids_b[first_b[group] + place], np.ones(len(left), np.int64), group_unit[group]
        for g in np.flatnonzero(~small).tolist():
            x, count_x = np.unique(ids_a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            y, count_y = np.unique(ids_b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            pairs = np.concatenate([pairs, (x[:, None] * self.width + y).ravel()])
            times = np.concatenate([times, (count_x[:, None] * count_y).ravel()])
            owner = np.concatenate([owner, np.full(len(x) * len(y), group_unit[g])])
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=n)
        self.numbers.extend(table.ravel(), np.full(n, 5))
        self.pairs.extend(pairs[order], counts)
        self.times.extend(times[order], counts)
        # written by group, A's tokens before B's
        size_a = len(self.bytes_a.lengths)
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        kinds = np.concatenate([ids_a + size_a * last_a, ids_b + 2 * size_a + self.width * last_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        owner = np.concatenate([unit_a, unit_b])[order]
        lengths = np.bincount(owner, self.written_lengths[kinds[order]], n).astype(np.int64)
        flat, at = b"".join(map(self.written.__getitem__, kinds[order].tolist())), np.concatenate([[0], np.cumsum(lengths)]).tolist()
        self.texts += [flat[i:j] for i, j in zip(at, at[1:])]

    def align(self, texts: list[str]):
        """For every text: its numbers, its groups as written, its distinct pairs in order and how often each occurs."""
        cuts = [self.cut(t) if t else [] for t in texts]
        found = [np.fromiter(map(self.units.__getitem__, units), np.int64, len(units)) for units in cuts]
        for part in range(0, len(self.units.new), 4096):
            self.learn(self.units.new[part : part + 4096])
        self.units.new.clear()
        table = self.numbers.flat[: 5 * len(self.texts)].reshape(-1, 5)
        for numbers in found:
            sums = table[numbers].sum(0)
            if not len(numbers) or sums[4] != len(numbers):
                yield np.zeros(4, np.int64), None, np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            groups = b"".join(map(self.texts.__getitem__, numbers.tolist()))[:-1]
            units, counts = np.unique(numbers, return_counts=True)
            starts, lengths = self.pairs.starts[units], self.pairs.lengths[units]
            times = gather(self.times.flat, starts, lengths) * np.repeat(counts, lengths)
            pairs = gather(self.pairs.flat, starts, lengths)
            order = np.argsort(pairs)
            pairs = pairs[order]
            first = np.flatnonzero(np.diff(pairs, prepend=-1))
            yield sums[:4], groups, pairs[first], np.add.reduceat(times[order], first)
        if len(self.units) > MAX_UNITS or self.pairs.used > MAX_KNOWN:
            self._forget()


def within(lengths: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Running sums that start anew in every unit."""
    ends = np.cumsum(lengths)
    first = np.flatnonzero(np.diff(unit, prepend=-1))
    before = np.zeros(int(unit[-1]) + 1 if len(unit) else 0, np.int64)
    before[unit[first]] = ends[first] - lengths[first]
    return ends - before[unit]


_loaded: dict[tuple[str, str], Aligner] = {}


def loaded(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def align_documents(docs: DataFrame, path_a: str, path_b: str, text: str = "text", with_groups: bool = True) -> DataFrame:
    """``row`` (all columns but the text), ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``pairs``, ``times``.

    ``pairs`` holds the document's distinct pairs (A id times B's vocabulary plus B id) in rising order as differences, ``times`` how
    often each is linked; both are little-endian 64- and 32-bit numbers (32-bit pairs where the vocabularies allow).
    ``with_groups`` adds the groups as text, ``a1,a2|b1;a3|b2``.
    """
    import pyarrow as pa

    ready(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    staged = docs.select(whole_row(docs.select(*[column(c) for c in others])), column(text).alias("text"))
    names = [*COUNTS, "groups_sha256", "pairs", "times", *["groups"] * with_groups]
    kinds = [*[T.LongType()] * 4, T.StringType(), T.BinaryType(), T.BinaryType(), T.StringType()]
    schema = T.StructType([staged.schema["row"], *[T.StructField(n, k) for n, k in zip(names, kinds)]])
    width = pair_type(path_a, path_b)

    def run(batches):
        aligner = loaded(path_a, path_b)
        for batch in batches:
            out = [[] for _ in names]
            for numbers, groups, pairs, times in aligner.align([x.as_py() or "" for x in batch.column("text")]):
                digest = "" if groups is None else hashlib.sha256(groups).hexdigest()
                packed = np.diff(pairs, prepend=0).astype(width).tobytes(), times.astype("<u4").tobytes()
                for cells, value in zip(out, [*numbers.tolist(), digest, *packed, (groups or b"").decode()]):
                    cells.append(value)
            types = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *[pa.array(c, t) for c, t in zip(out, types)]], names=schema.names
            )

    return staged.mapInArrow(run, schema)


def pair_type(path_a: str, path_b: str) -> str:
    import sentencepiece

    sizes = quiet_tokenizer(path_a).get_vocab_size(), len(sentencepiece.SentencePieceProcessor(model_file=path_b))
    return "<u4" if sizes[0] * sizes[1] <= 1 << 32 else "<u8"


def _pairs_of(cell, width: str) -> np.ndarray:
    return np.cumsum(np.frombuffer(cell.as_buffer(), width).astype(np.int64))


def count_pairs(aligned: DataFrame, width: str, size_b: int) -> DataFrame:
    """``pair``, ``n`` (documents that hold it linked) and ``best`` (1 if no other pair of its A id has more)."""
    import pyarrow as pa

    def run(batches):
        held, size = [], 0

        def flush():
            pairs, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            for part in range(0, len(pairs), 1 << 18):
                some = slice(part, part + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[some]), pa.array(n[some].astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            for cell in batch.column("pairs"):
                held.append(_pairs_of(cell, width))
                size += len(held[-1])
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    counted = aligned.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = stored(counted, "pair-counts")
    first = F.floor(F.col("pair") / size_b)
    highest = counted.groupBy(first.alias("a")).agg(F.max("n").alias("most"))   # one row for each id of A
    return counted.join(F.broadcast(highest), first == F.col("a")).select(
        "pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best")
    )


def link_counts(aligned: DataFrame, pairs: DataFrame, width: str, hot: int = HOT) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum``, from the table of :func:`count_pairs`."""
    import pyarrow as pa

    spark = aligned.sparkSession
    most, complete = frequent(pairs, "n", hot)
    table = most.select("pair", "n", "best").toArrow()               # at most ``hot`` rows
    order = np.argsort(table.column("pair").to_numpy())
    kept = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy()[order] for c in ("pair", "n", "best")))
    base = [c for c in aligned.columns if c not in ("pairs", "times")]
    staged = aligned.select(F.struct(*[column(c) for c in base]).alias("known"), "pairs", "times")
    kinds = {"n_best": T.LongType(), "count_sum": T.LongType(), "cold": T.ArrayType(T.LongType()), "often": T.ArrayType(T.LongType())}
    schema = T.StructType([staged.schema["known"], *[T.StructField(n, k) for n, k in kinds.items()]])

    def run(batches):
        known, n, best = kept.value
        for batch in batches:
            out = [[], [], [], []]
            for cell, often in zip(batch.column("pairs"), batch.column("times")):
                pairs, times = _pairs_of(cell, width), np.frombuffer(often.as_buffer(), "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                some = at[hit]
                values = int(best[some] @ times[hit]), int(n[some] @ times[hit]), pairs[~hit], times[~hit]
                for cells, value in zip(out, values):
                    cells.append(value)
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("known"), *[pa.array(c, t) for c, t in zip(out, types)]], names=schema.names
            )

    looked = staged.mapInArrow(run, schema)
    if complete:
        return looked.select("known.*", "n_best", "count_sum")
    looked = stored(looked.withColumn("at", F.monotonically_increasing_id()), "pair-links")
    asked = looked.select("at", F.explode(F.arrays_zip("cold", "often")).alias("x")).select("at", "x.cold", "x.often")
    # a pair asked for here has no more documents than any that workers keep: no key is hot
    added = asked.join(pairs, F.col("cold") == F.col("pair")).groupBy(F.col("at").alias("added_at")).agg(
        F.sum(F.col("often") * F.col("best")).alias("more_best"), F.sum(F.col("often") * F.col("n")).alias("more_count")
    )
    return looked.join(added, F.col("at") == F.col("added_at"), "left").select(
        "known.*", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_count", F.lit(0))).alias("count_sum"),
    )


def align_corpus(
    docs: DataFrame, path_a: str, path_b: str, text: str = "text", with_groups: bool = True, hot: int = HOT
) -> DataFrame:
    """:func:`align_documents` with the corpus-wide counts of the pairs: ``n_best`` and ``count_sum``."""
    import sentencepiece

    width = pair_type(path_a, path_b)
    aligned = stored(align_documents(docs, path_a, path_b, text, with_groups), "aligned")
    size_b = len(sentencepiece.SentencePieceProcessor(model_file=path_b))
    pairs = stored(count_pairs(aligned, width, size_b), "pairs")
    return link_counts(aligned, pairs, width, hot)
