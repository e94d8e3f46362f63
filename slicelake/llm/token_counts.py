"""Token counts by a compiled transducer over bytes, run in lockstep over chunks.

White space separates words whose tokens do not depend on each other, so the tokenizer of the
library is compiled, word by word as they turn up, into a deterministic transducer: a trie of bytes
whose transition on white space emits the word's number of tokens and returns to the root.

All texts of a batch form one byte string, cut into chunks. Every chunk is a map from the state it is entered with to
the state it is left with and the tokens it emits. All chunks are advanced together, one
byte column at a time, from an unknown state: behind its first white space a chunk's run does not depend on the
entry, and a chunk without white space is longer than any compiled word and leaves every entry
in the dead state. So each map is constant in its end state, the prefix scan over the composed
maps is a shift by one, and only the bytes before the first white space are run again, from the state
the scan gives. Words that end outside the compiled states are counted by the library, once per batch, and
compiled for later.

Defined cases: NULL counts as empty: 0 bytes, 0 tokens. Special strings inside texts count as the library has
them by default. Rows are independent. Words over ``MAX_WORD`` bytes are never compiled; the
transducer starts afresh beyond ``MAX_STATES``, which changes speed only.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, types as T

from slicelake.llm.common import HashedPairs, column, slices, texts_of, whole_row

CHUNK = 128               # bytes; more than MAX_WORD, see above
MAX_WORD = 64
MAX_STATES = 1 << 21
RUN_BYTES = 4 << 20       # bytes run at once; a longer text is one run
ROOT, DEAD, UNKNOWN = 0, -1, -2
UNCOUNTED, LATER = -1, -2

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def quiet_tokenizer(path: str):
    """The library's tokenizer without truncation or padding, single-threaded like the task it runs in."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def word_tokenizer(path: str):
    """The library's tokenizer, refused if its tokens of a text are not those of the words between white space."""
    tokenizer = quiet_tokenizer(path)
    words = ["a", "The", "été", "x1.", "don't", "字"]

    def ids(text):
        return tokenizer.encode(text, add_special_tokens=False).ids

    for space in (" ", "  ", "\t", "\n", "\x0b", "\x0c", "\r\n"):
        if ids(space + space.join(words) + space) != [i for w in words for i in ids(w)]:
            raise ValueError(f"{path} does not drop white space between words")
    return tokenizer


class Transducer:
    """States are prefixes of words; ``emits`` is the number of tokens of the word that ends there."""

    def __init__(self, path: str):
        self.tokenizer = word_tokenizer(path)
        self._restart()

    def _restart(self) -> None:
        self.next, self.states = HashedPairs(16), 1
        self.emits = np.full(1 << 16, UNCOUNTED, np.int64)
        self.emits[ROOT] = 0      # white space after white space

    def count_words(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for part in range(0, len(words), 4096):
            some = [w.decode() for w in words[part : part + 4096]]
            done = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            out[part : part + len(some)] = [len(e.ids) for e in done]
        return out

    def compile(self, words: list[bytes], counts: np.ndarray) -> None:
        """Add the paths of words of at most MAX_WORD bytes, one byte of all words at a time."""
        short = [i for i, w in enumerate(words) if len(w) <= MAX_WORD]
        if not short:
            return
        if self.states > MAX_STATES:
            self._restart()
        lengths = np.fromiter((len(words[i]) for i in short), np.int64, len(short))
        width = int(lengths.max())
        bytes_ = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in short), np.uint8).reshape(-1, width)
        state = np.zeros(len(short), np.int64)
        for at in range(width):
            rows = np.flatnonzero(lengths > at)
            keys = HashedPairs.key(state[rows], bytes_[rows, at])
            to = self.next.get(keys)
            fresh = np.unique(keys[to < 0])
            if len(fresh):
                numbers = np.arange(self.states, self.states + len(fresh), dtype=np.int32)
                self.next.put(fresh, numbers)
                self.states += len(fresh)
                to = self.next.get(keys)
            state[rows] = to
        if self.states > len(self.emits):
            grown = np.full(2 * self.states, UNCOUNTED, np.int64)
            grown[: len(self.emits)] = self.emits
            self.emits = grown
        self.emits[state] = counts[short]

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = np.full(len(state), DEAD, np.int64)
        known = np.flatnonzero(state >= 0)
        out[known] = self.next.get(HashedPairs.key(state[known], byte[known]))
        out[state == UNKNOWN] = UNKNOWN
        return out

    def _emit(self, state: np.ndarray) -> np.ndarray:
        out = np.where(state == UNKNOWN, LATER, UNCOUNTED)
        out[state >= 0] = self.emits[state[state >= 0]]
        return out

    def emissions(self, data: np.ndarray) -> np.ndarray:
        """Tokens emitted at each byte of ``data``, which ends in white space."""
        chunks = -(-len(data) // CHUNK)
        bytes_ = np.full(chunks * CHUNK, 0x20, np.uint8)
        bytes_[: len(data)] = data
        bytes_ = bytes_.reshape(chunks, CHUNK)
        spaces = SPACE[bytes_]
        emitted = np.zeros((chunks, CHUNK), np.int64)
        state = np.full(chunks, UNKNOWN, np.int64)
        state[0] = ROOT
        for at in range(CHUNK):
            stops = spaces[:, at]
            emitted[stops, at] = self._emit(state[stops])
            state = self._step(state, bytes_[:, at])
            state[stops] = ROOT
        # the scan: a chunk is entered with the end of the one before; no white space at all means dead
        ends = np.where(state == UNKNOWN, DEAD, state)
        entry = np.concatenate([[ROOT], ends[:-1]])
        lanes, at = np.arange(1, chunks), 0
        state = entry[1:]
        while len(lanes) and at < CHUNK:
            stops = spaces[lanes, at]
            emitted[lanes[stops], at] = self._emit(state[stops])
            lanes, state = lanes[~stops], state[~stops]
            state = self._step(state, bytes_[lanes, at])
            at += 1
        flat = emitted.reshape(-1)[: len(data)]
        missing = np.flatnonzero(flat == UNCOUNTED)
        if len(missing):
            stops = np.flatnonzero(spaces.reshape(-1)[: len(data)])
            place = np.searchsorted(stops, missing)
            starts = np.where(place > 0, stops[place - 1] + 1, 0)
            raw, numbers, order = data.tobytes(), {}, []
            for a, b in zip(starts.tolist(), missing.tolist()):
                order.append(numbers.setdefault(raw[a:b], len(numbers)))
            words = list(numbers)
            counts = self.count_words(words)
            flat[missing] = counts[order]
            self.compile(words, counts)
        return flat


_loaded: dict[str, Transducer] = {}


def loaded(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``row`` (all columns but the text), ``n_bytes``, ``n_tokens`` and ``over_limit`` of every document."""
    import pyarrow as pa

    others = [c for c in docs.columns if c != text]
    staged = docs.select(whole_row(docs.select(*[column(c) for c in others])), column(text).alias("text"))
    schema = T.StructType([
        staged.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ])

    def run(batches):
        machine = loaded(path)
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            sizes = np.diff(offsets)
            counts = np.zeros(len(sizes), np.int64)
            for part in slices(sizes + 1, RUN_BYTES):
                texts = [data[a:b] for a, b in zip(offsets[part], offsets[1:][part])]
                joined = np.concatenate([x for t in texts for x in (t, [np.uint8(0x20)])])
                ends = np.cumsum(sizes[part] + 1)
                totals = np.cumsum(machine.emissions(joined))[ends - 1]
                counts[part] = np.diff(totals, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(sizes), pa.array(counts), pa.array(counts > limit)], names=schema.names
            )

    return staged.mapInArrow(run, schema)
