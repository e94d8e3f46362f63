"""Byte-level BPE: encoding by merges in padded numpy matrices, decoding by table lookup.

Texts are cut into the matches of the tokenizer's pattern. The distinct pieces of a batch that
are new to the worker become byte rows, bucketed by length and padded. In every round each row merges its
leftmost pair of minimum rank: ranks come from a hashed pair table, the row is compacted, rows
without a pair left leave the matrix. A piece that is itself a token is that token.

Work and memory stay bounded: pieces longer than ``WIDEST`` bytes merge with a heap instead of a matrix
(the same order of merges in n log n steps), texts are handled in runs of pieces, and the worker's
memory of pieces starts afresh after ``MAX_PIECES``.

Defined cases: a NULL or empty text has no ids. Rows are handled one by one, so repeated rows, NULL or repeated
ids and empty tables need no rule. Results carry ``row`` as a struct, so extra columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from slicelake.llm.common import HashedPairs, column, whole_row

WIDEST = 256              # bytes of a matrix row
BUCKETS = (4, 8, 16, 32, 64, 128, WIDEST)
RUN_PIECES = 200_000      # pieces handled at once
MAX_PIECES = 1_000_000    # distinct pieces a worker remembers
NONE = np.iinfo(np.int32).max


class Pieces(dict):
    """piece -> number; pieces seen for the first time are numbered and noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, piece):
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class IdStore:
    """The ids of numbered pieces in flat, doubling arrays."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    @staticmethod
    def _room(array: np.ndarray, needed: int) -> np.ndarray:
        if needed <= len(array):
            return array
        return np.concatenate([array, np.zeros(max(needed, 2 * len(array)) - len(array), array.dtype)])

    def add(self, rows: list[np.ndarray]) -> None:
        self.extend(np.concatenate(rows) if rows else np.zeros(0, np.int32), np.fromiter(map(len, rows), np.int64, len(rows)))

    def extend(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add rows that follow each other in ``ids``."""
        total, n = len(ids), len(lengths)
        self.flat = self._room(self.flat, self.used + total)
        self.starts, self.lengths = self._room(self.starts, self.count + n), self._room(self.lengths, self.count + n)
        self.flat[self.used : self.used + total] = ids
        self.starts[self.count : self.count + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.count : self.count + n] = lengths
        self.used, self.count = self.used + total, self.count + n

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these pieces, one after the other."""
        return gather(self.flat, self.starts[numbers], self.lengths[numbers])


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[start : start + length] of all pairs, concatenated."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(total)]


class ByteBpe:
    """The ranks of one rank file, ready to encode and decode."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        lefts, rights, merged = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    lefts.append(a), rights.append(b), merged.append(rank)
        self.pairs = HashedPairs()
        self.pairs.put(HashedPairs.key(np.array(lefts), np.array(rights)), np.array(merged, np.int32))
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self._forget()

    def _forget(self) -> None:
        self.pieces, self.store = Pieces(), IdStore()

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair (the id of the merged token), NONE if it does not merge; -1 marks padding."""
        out = np.full(a.shape, NONE, np.int32)
        real = (a >= 0) & (b >= 0)
        found = self.pairs.get(HashedPairs.key(a[real], b[real]))
        out[real] = np.where(found < 0, NONE, found)
        return out

    def _merge_matrix(self, ids: np.ndarray) -> None:
        """Merge every row of a matrix padded with -1, in place."""
        live, m = np.arange(len(ids)), ids.copy()
        ranks = self._pair_ranks(m[:, :-1], m[:, 1:])
        while len(live):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            going = best < NONE
            if not going.all():
                ids[live[~going]] = m[~going]
                live, m, ranks, at, best = live[going], m[going], ranks[going], at[going], best[going]
                if not len(live):
                    break
            rows, width = np.arange(len(live)), m.shape[1]
            m[rows, at] = best
            from_ = np.arange(width) + (np.arange(width) > at[:, None])     # what lies behind moves up
            m = np.take_along_axis(np.pad(m, ((0, 0), (0, 1)), constant_values=-1), from_, 1)
            from_ = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=NONE), from_, 1)
            for side in (at - 1, at):                                       # the two pairs that changed
                ok = (side >= 0) & (side < width - 1)
                ranks[rows[ok], side[ok]] = self._pair_ranks(m[rows[ok], side[ok]], m[rows[ok], side[ok] + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        first = self._pair_ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i) for i, r in enumerate(first.tolist()) if r < NONE]
        heapq.heapify(heap)
        rank_at = first.tolist() + [NONE]
        tokens, ranks = self._token, self.ranks
        while heap:
            rank, i = heapq.heappop(heap)
            if rank_at[i] != rank:
                continue
            j = after[i]
            ids[i], rank_at[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    nxt = after[k]
                    rank_at[k] = ranks.get(tokens(ids[k]) + tokens(ids[nxt]), NONE) if nxt < n else NONE
                    if rank_at[k] < NONE:
                        heapq.heappush(heap, (rank_at[k], k))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return np.array(out, np.int32)

    def _token(self, i: int) -> bytes:
        start = self.token_starts[i]
        return self.token_bytes[start : start + self.token_lengths[i]].tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = np.array([rank], np.int32)
            elif len(piece) > WIDEST:
                out[i] = self._merge_long(piece)
            else:
                buckets.setdefault(next(w for w in BUCKETS if len(piece) <= w), []).append(i)
        for width, members in buckets.items():
            for part in range(0, len(members), 1 << 14):
                rows = members[part : part + (1 << 14)]
                padded = b"".join(pieces[i].ljust(width, b"\0") for i in rows)
                ids = self.byte_ids[np.frombuffer(padded, np.uint8).reshape(len(rows), width)]
                lengths = np.fromiter((len(pieces[i]) for i in rows), np.int64, len(rows))
                ids[np.arange(width) >= lengths[:, None]] = -1
                self._merge_matrix(ids)
                for i, row in zip(rows, ids):
                    out[i] = row[row >= 0].copy()
        return out

    def _runs(self, text: str) -> Iterator[list[str]]:
        if len(text) <= 4 * RUN_PIECES:
            yield self.pattern.findall(text)
            return
        matches = (m.group() for m in self.pattern.finditer(text))
        while run := list(islice(matches, RUN_PIECES)):
            yield run

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, some of its ids) in order; many texts share one matrix."""
        waiting, size = [], 0
        for i, text in enumerate(texts):
            for run in self._runs(text):
                waiting.append((i, run))
                size += len(run)
                if size >= RUN_PIECES:
                    yield from self._encode_runs(waiting, size)
                    waiting, size = [], 0
        yield from self._encode_runs(waiting, size)

    def _encode_runs(self, runs: list[tuple[int, list[str]]], size: int) -> Iterator[tuple[int, np.ndarray]]:
        pieces = chain.from_iterable(run for _, run in runs)
        numbers = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, size)
        if self.pieces.new:
            self.store.add(self.encode_pieces([p.encode() for p in self.pieces.new]))
            self.pieces.new.clear()
        ids = self.store.of(numbers)
        ends = np.concatenate([[0], np.cumsum(self.store.lengths[numbers])])
        at = 0
        for i, run in runs:
            yield i, ids[ends[at] : ends[at + len(run)]]
            at += len(run)
        if len(self.pieces) > MAX_PIECES:
            self._forget()

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_bytes, self.token_starts[ids], self.token_lengths[ids]).tobytes()


_loaded: dict[tuple[str, str], ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    """The tokenizer, built once per worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def encode_documents(
    docs: DataFrame, path: str, pattern: str, text: str = "text", with_ids: bool = True
) -> DataFrame:
    """``row``, ``n_tokens``, the digests of ids and decoded bytes and, if wanted, ``ids``.

    ``row`` has all columns but the text, which does not travel back. The digest of the decoded
    bytes is made from the ids alone.
    """
    import pyarrow as pa

    others = [c for c in docs.columns if c != text]
    staged = docs.select(whole_row(docs.select(*[column(c) for c in others])), column(text).alias("text"))
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        added.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    schema = T.StructType([staged.schema["row"], *added])

    def run(batches):
        bpe = loaded(path, pattern)
        for batch in batches:
            n = batch.num_rows
            counts, kept = [0] * n, [[] for _ in range(n)]
            digests, decoded = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            for i, ids in bpe.encode(body.as_py() or "" for body in batch.column("text")):
                counts[i] += len(ids)
                digests[i].update(ids.astype("<u4").tobytes())
                decoded[i].update(bpe.decode(ids))
                if with_ids:
                    kept[i].append(ids)
            columns = [batch.column("row"), pa.array(counts, pa.int64()), pa.array([x.hexdigest() for x in digests]), pa.array([x.hexdigest() for x in decoded])]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = np.concatenate([np.zeros(0, np.int32), *chain.from_iterable(kept)])
                columns.append(pa.ListArray.from_arrays(offsets, ids))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return staged.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``row`` (all columns but the ids) and ``text``: the bytes of the ids, read as UTF-8."""
    import pyarrow as pa

    others = [c for c in encoded.columns if c != ids]
    staged = encoded.select(whole_row(encoded.select(*[column(c) for c in others])), column(ids).alias("ids"))
    schema = T.StructType([staged.schema["row"], T.StructField("text", T.StringType())])

    def run(batches):
        bpe = loaded(path, pattern)
        for batch in batches:
            texts = [bpe.decode(np.array(x.as_py() or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=schema.names)

    return staged.mapInArrow(run, schema)
