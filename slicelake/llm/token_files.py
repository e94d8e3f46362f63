"""Token ids in binary files: frequency-ranked, byte-aligned variable length, separate control bytes.

Ids are replaced by their rank in the corpus' frequency order, so frequent tokens need one byte. Four
numbers share a control byte with two bits each for their length (1 to 4 bytes); control bytes and
data bytes are separate streams, decoded by a numpy table from control byte to lengths.

A file is a sequence of blocks: ``MAGIC``, then five little-endian 64-bit numbers (documents, NULL ids among
them, tokens, control bytes, data bytes), the document ids and token counts as 64-bit numbers, the control and the data
bytes. A file holds a range of document ids in ascending order, the files together all of them.
The ranks (one number for each id of the vocabulary) are a file of their own.

Texts are encoded once, word by word: white space separates words whose tokens do not depend on each
other, so each worker asks the library for words it has not seen; words of small letters only are asked many in one call. Only ids are shuffled, by ranges of document id.
What passes the driver is bounded by the vocabulary; file names stay in a manifest table.

Defined cases: NULL counts as empty (only the end id). NULL ids come first; rows with equal ids
follow each other in the order of their ids' bytes. An empty table gives no files and no rows. Extra columns
are not read.
"""

from __future__ import annotations

import json
import re
import struct
from functools import cache
from itertools import repeat

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from slicelake.llm import files
from slicelake.llm.byte_bpe import IdStore, gather
from slicelake.llm.common import column, slices, stored, texts_of
from slicelake.llm.token_counts import quiet_tokenizer, word_tokenizer
from slicelake.session import work_dir

MAGIC = b"TOKIDS1\n"
HEADER = "<8s5q"
BLOCK_TOKENS = 1 << 20
RUN_BYTES = 4 << 20       # text bytes cut into words at once; a longer text is one run
MAX_WORDS = 1_000_000     # distinct words a worker remembers
ASKED = 1024              # words the library is asked at once

LENGTHS = np.array([[(control >> 2 * i & 3) + 1 for i in range(4)] for control in range(256)], np.int64)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    wide = np.zeros(-(-len(numbers) // 4) * 4, np.uint32)
    wide[: len(numbers)] = numbers
    size = 1 + (wide > 0xFF).astype(np.uint8) + (wide > 0xFFFF) + (wide > 0xFFFFFF)
    control = ((size.reshape(-1, 4) - 1) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    size[len(numbers) :] = 0
    raw = wide.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    starts = np.cumsum(sizes) - sizes
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = np.zeros(count, np.uint32)
    for byte in range(4):
        here = sizes > byte
        out[here] |= padded[starts[here] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


# what a tokenizer file must say, so that words may be lower-cased and cut between a letter and a point
SPLIT, LOWER = r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", '"Lowercase"'
CAPITAL = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
LETTER, POINT = 1, 2      # the sum tells that one is beside the other
KIND = sum(kind * np.isin(np.arange(256), list(x)) for kind, x in ((LETTER, b"abcdefghijklmnopqrstuvwxyz"), (POINT, b",.;:!?"))).astype(np.uint8)
LATIN, SIGNS = 0xC3, (0x97, 0xB7)     # first byte of U+00C0 to U+00FF, and second bytes of those that are no letters

# what it must say besides, so that the model alone gives the ids of words of small letters
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRETOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|" + SPLIT.replace("\\\\", "\\")}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff\u0430-\u044f]+")      # Latin and Cyrillic


def shared_words(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with the same tokens but fewer distinct words: A-Z lower-cased, a blank between a letter and a point.

    A capital before a character beyond ASCII stays, as that may be a mark that joins it; all stay where a special string may be.
    """
    after = np.append(text[1:], 0)
    special = ((text == ord("<")) & (after == ord("|"))).any()
    text = text if special else np.where(CAPITAL[text] & (after < 128), text | 32, text).astype(np.uint8)
    kind = KIND[text]
    latin = np.flatnonzero(text == LATIN)
    latin = latin[~np.isin(text[latin + 1], SIGNS)]
    kind[latin] = kind[latin + 1] = LETTER
    places = np.flatnonzero(kind[1:] + kind[:-1] == LETTER + POINT) + 1
    return np.insert(text, places, ord(" ")), offsets + np.searchsorted(places, offsets)


def plain_tokenizer(tokenizer):
    """The same model without the steps that leave words of ``PLAIN`` as they are, and the ids words end with; None if the file has other steps."""
    from tokenizers import Tokenizer, pre_tokenizers

    file = json.loads(tokenizer.to_str())
    model, suffix = file["model"], file["model"].get("end_of_word_suffix")
    steps = [(file[part] or {}).get(part + "s" if part == "normalizer" else "pretokenizers") for part in ("normalizer", "pre_tokenizer")]
    known = steps == [NORMALIZERS, PRETOKENIZERS] and model["type"] == "BPE" and suffix and not model.get("dropout")
    if not known or file["post_processor"] or any(PLAIN.fullmatch(t["content"]) for t in file["added_tokens"]):
        return None
    plain = Tokenizer(tokenizer.model)
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), level])
    vocabulary = tokenizer.get_vocab()
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return plain, last


class WordEncoder:
    """The library's ids, asked once for each distinct word."""

    def __init__(self, path: str):
        self.tokenizer = word_tokenizer(path)
        file = self.tokenizer.to_str()
        self.shares = SPLIT in file and LOWER in file
        self.plain = plain_tokenizer(self.tokenizer)
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.store = IdStore()

    def ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of these words, one after the other, and the number of ids of each."""
        plain = [i for i, w in enumerate(words) if PLAIN.fullmatch(w)] if self.plain else []
        others = sorted(set(range(len(words))).difference(plain))
        done = self.tokenizer.encode_batch_fast([words[i] for i in others], add_special_tokens=False)
        ids = [np.array(e.ids, np.int32) for e in done]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        if plain:
            tokenizer, last = self.plain
            joined = tokenizer.encode_batch_fast([" ".join([words[i] for i in plain])], add_special_tokens=False)[0]
            ids.insert(0, np.array(joined.ids, np.int32))
            ends = np.flatnonzero(last[ids[0]]) + 1
            if len(ends) != len(plain):
                raise ValueError("the ids of a word do not end where it ends")
            lengths = np.concatenate([np.diff(ends, prepend=0), lengths])
        order = np.argsort(plain + others)
        starts = np.cumsum(lengths) - lengths
        return gather(np.concatenate(ids), starts[order], lengths[order]), lengths[order]

    def _numbers(self, text: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words, and how many words each text has. Arrow finds the distinct words of a run."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(text)])
        split = pc.ascii_split_whitespace(texts)     # may give words of no length, which have no ids
        coded = split.values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self.words.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(numbers < 0)
        numbers[fresh] = np.arange(len(self.words), len(self.words) + len(fresh))
        new = distinct[fresh].tolist()
        self.words.update(zip(new, numbers[fresh].tolist()))
        for part in range(0, len(new), ASKED):
            self.store.extend(*self.ask(new[part : part + ASKED]))
        return numbers[coded.indices.to_numpy()], np.diff(split.offsets.to_numpy())

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts between the offsets, and the number of ids of each."""
        text, cuts = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if self.shares and len(text):
            text, cuts = shared_words(text, cuts)
        numbers, per_text = self._numbers(text, cuts)
        ends = np.concatenate([[0], np.cumsum(self.store.lengths[numbers])])
        ids = self.store.of(numbers)
        if len(self.words) > MAX_WORDS:
            self._forget()
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])


_loaded: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def encode_ids(docs: DataFrame, path: str, end_id: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc`` and ``ids``: little-endian 16-bit numbers where the vocabulary allows, else 32-bit.

    One more row for each task has only ``tally``: how often each id of the vocabulary occurs in its rows, as 64-bit numbers.
    """
    import pyarrow as pa

    wide, vocabulary = _width(path, end_id), _vocabulary(path, end_id)
    staged = docs.select(column(id).cast("bigint").alias("doc"), column(text).alias("text"))

    def run(batches):
        encoder, tally = _encoder(path), np.zeros(vocabulary, np.int64)
        names = ["doc", "ids", "tally"]
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            cells = []
            for part in slices(np.diff(offsets), RUN_BYTES):
                ids, counts = encoder.encode(data, offsets[part.start : part.stop + 1])
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype(wide)
                tally += np.bincount(ids, minlength=vocabulary)
                ends = ends + np.arange(1, len(ends) + 1)
                cells += [ids[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends]), ends)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(cells, pa.binary()), pa.nulls(len(cells), pa.binary())], names=names)
        if tally.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([tally.astype("<i8").tobytes()])], names=names)

    return staged.mapInArrow(run, "doc bigint, ids binary, tally binary")


@cache
def _vocabulary(path: str, end_id: int) -> int:
    return max(quiet_tokenizer(path).get_vocab_size(), end_id + 1)


def _width(path: str, end_id: int) -> str:
    return "<u2" if _vocabulary(path, end_id) <= 1 << 16 else "<u4"


def rank_ids(encoded: DataFrame, vocabulary: int) -> np.ndarray:
    """Ids by descending frequency over all documents; ids that never occur follow. One number for each id."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for cell in batch.column("tally"):
                total += np.frombuffer(cell.as_buffer(), "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    counts = encoded.where(F.col("tally").isNotNull()).select("tally").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    frequency = np.zeros(vocabulary, np.int64)
    for row in counts.collect():  # bounded by the vocabulary
        frequency[row["id"]] = row["n"]
    return np.argsort(-frequency, kind="stable").astype(np.uint32)


def write_files(encoded: DataFrame, ranked: np.ndarray, width: str, folder: str) -> DataFrame:
    """Write ids in ascending document order; the manifest: ``part``, ``path``, ``documents``, ``tokens``."""
    import pyarrow as pa

    files_schema = "part int, path string, documents bigint, tokens bigint"
    rank_of = np.empty(len(ranked), np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    rank_of = encoded.sparkSession.sparkContext.broadcast(rank_of)  # one number for each id of the vocabulary

    def run(batches):
        part = TaskContext.get().partitionId()
        path, out, documents, tokens = files.new_file(folder, part, ".tok"), None, 0, 0
        ranks = rank_of.value
        for batch in batches:
            cells = [np.frombuffer(x.as_buffer(), width) for x in batch.column("ids")]
            docs = np.asarray(batch.column("doc").fill_null(0))
            missing = batch.column("doc").null_count   # NULL ids sort first
            for some in slices(np.fromiter(map(len, cells), np.int64, len(cells)), BLOCK_TOKENS):
                counts = np.fromiter(map(len, cells[some]), np.int64, some.stop - some.start)
                control, data = pack(ranks[np.concatenate(cells[some])])
                nulls = max(0, min(missing, some.stop) - some.start)
                out = out or files.open_new(path)
                out.write(struct.pack(HEADER, MAGIC, len(counts), nulls, int(counts.sum()), len(control), len(data)))
                for block in (docs[some].astype("<i8").tobytes(), counts.astype("<i8").tobytes(), control, data):
                    out.write(block)
                documents, tokens = documents + len(counts), tokens + int(counts.sum())
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "path": [path], "documents": [documents], "tokens": [tokens]}
            )

    parts = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = encoded.where(F.col("tally").isNull()).select("doc", "ids")
    ordered = rows.repartitionByRange(parts, "doc").sortWithinPartitions("doc", "ids")
    return files.manifest(ordered.mapInArrow(run, files_schema), "token-files")


def read_files(written: DataFrame, ranked_path: str) -> DataFrame:
    """``doc``, ``start`` (ids of all documents before it), ``ids`` as 32-bit bytes, from the files."""
    import pyarrow as pa

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    placed = written.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    parts = int(written.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        with files.open_old(ranked_path) as stream:
            ranked = np.frombuffer(stream.read(), "<u4")
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with files.open_old(path) as stream:
                    while head := stream.read(struct.calcsize(HEADER)):
                        magic, n, nulls, tokens, control, data = struct.unpack(HEADER, head)
                        if magic != MAGIC:
                            raise ValueError(f"{path} is not a file of token ids")
                        docs, counts = (np.frombuffer(stream.read(8 * n), "<i8") for _ in range(2))
                        ids = ranked[unpack(stream.read(control), stream.read(data), tokens)].astype("<u4")
                        ends = np.cumsum(counts)
                        cells = [ids[a:b].tobytes() for a, b in zip(ends - counts, ends)]
                        starts, start = start + ends - counts, start + tokens
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(docs, mask=np.arange(n) < nulls), pa.array(starts), pa.array(cells, pa.binary())],
                            names=["doc", "start", "ids"],
                        )

    return placed.select("path", "start").repartition(parts).mapInArrow(run, "doc bigint, start bigint, ids binary")


def token_files(docs: DataFrame, path: str, end_id: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, write, read back: ``doc``, ``start``, ``ids`` (little-endian unsigned 32-bit numbers)."""
    spark = docs.sparkSession
    width = _width(path, end_id)
    encoded = stored(encode_ids(docs, path, end_id, id, text), "token-ids")
    ranked = rank_ids(encoded, _vocabulary(path, end_id))
    folder = work_dir(spark, "tokens")
    ranked_path = f"{folder}/ranks.u32"
    with files.open_new(ranked_path) as out:
        out.write(ranked.astype("<u4").tobytes())
    return read_files(write_files(encoded, ranked, width, folder), ranked_path)


def digests(read: DataFrame) -> DataFrame:
    """``doc``, ``start``, ``n_tokens``, ``ids_crc32`` of every document."""
    return read.select(
        "doc", "start", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
