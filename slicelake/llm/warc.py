"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Every record is a gzip member of its own. Of records with equal payloads of at least ``min_bytes`` bytes the one
with the smallest page id is a response, the others are revisits that name it. A revisit has no
payload; its length is kept in the extension field ``WARC-Payload-Length``.

The reader cuts archives into byte ranges. A task looks for the gzip magic in its range, takes a candidate for a
member if its first bytes decode to a WARC version line, and owns the records that start inside its
range; the last one may end beyond it. A record whose member then does not decode, or whose payload does
not have its digest, fails the read.

Only digests and ids are shuffled to find repeats; payloads move once, by page id.

Defined cases: a NULL payload is empty. Rows with the same smallest id are all responses; repeated revisits
stay repeated. A NULL id counts as larger than any id; without any id all are responses. NULL urls become
``urn:page:<id>``. An empty table gives no archives and no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from slicelake.llm import files
from slicelake.llm.common import column
from slicelake.session import work_dir

SPLIT_BYTES = 8 << 20
ROLL_BYTES = 256 << 20
READ_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"      # pages have no time of their own
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def decide(pages: DataFrame, id: str, payload: str, url: str | None, min_bytes: int) -> DataFrame:
    """``page``, ``url``, ``body``, ``revisit`` and ``first`` (the response's page id) of every page."""
    body = F.coalesce(column(payload), F.lit(""))
    base = pages.select(
        column(id).cast("bigint").alias("page"),
        (column(url) if url else F.lit(None)).cast("string").alias("url"),
        body.alias("body"),
        F.sha1(body).alias("sha1"),
    )
    large = base.where(F.octet_length("body") >= min_bytes).select("page", "sha1")
    firsts = large.groupBy("sha1").agg(F.min("page").alias("first"))
    revisits = (
        large.join(firsts, "sha1")
        .where(~F.col("page").eqNullSafe(F.col("first")))
        .select(F.col("page").alias("p"), F.col("sha1").alias("s"), "first")
        .distinct()
    )
    same = F.col("page").eqNullSafe(F.col("p")) & (F.col("sha1") == F.col("s"))
    return base.join(revisits, same, "left").select("page", "url", "body", F.col("s").isNotNull().alias("revisit"), "first")


def _name(page: int | None) -> str:
    return f"urn:page:{'none' if page is None else page}"


def _page(name: str) -> int | None:
    number = name.strip("<>").rpartition(":")[2]
    return None if number == "none" else int(number)


def record(page: int | None, url: str | None, body: bytes, revisit: bool, first: int | None, date: str = DATE) -> bytes:
    """One compressed record."""
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_name(page)}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else _name(page)}",
        f"WARC-Payload-Digest: sha1:{digest_of(body)}", f"WARC-Payload-Length: {len(body)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{_name(first)}>",
        ]
    block = HTTP % len(body) + (b"" if revisit else body)
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_archives(
    pages: DataFrame, id: str = "page_id", payload: str = "html", url: str | None = "url", min_bytes: int = 0,
    folder: str | None = None,
) -> DataFrame:
    """Write the archives; their manifest: ``path``, ``size``, ``records``."""
    import pyarrow as pa

    folder = folder or work_dir(pages.sparkSession, "warc")

    def run(batches):
        part, out, written = TaskContext.get().partitionId(), None, []

        def close():
            out.close()
            return pa.RecordBatch.from_pylist([written[-1]])

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = files.new_file(folder, part, ".warc.gz")
                    out = files.open_new(path)
                    written.append({"path": path, "size": 0, "records": 0})
                data = record(row["page"], row["url"], row["body"].encode(), row["revisit"], row["first"])
                out.write(data)
                written[-1]["size"] += len(data)
                written[-1]["records"] += 1
                if written[-1]["size"] >= ROLL_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    decided = decide(pages, id, payload, url, min_bytes)
    return files.manifest(decided.mapInArrow(run, "path string, size bigint, records bigint"), "warc-files")


def members(stream, low: int, high: int) -> Iterator[bytes]:
    """The decoded records whose member starts in [low, high)."""
    position = low
    while position < high:
        stream.seek(position)
        window = stream.read(min(READ_BYTES, high - position) + 2)     # a magic may begin at the last byte
        at = window.find(MAGIC)
        if at < 0:
            position += max(1, len(window) - 2)
            continue
        position += at
        if position >= high:
            return
        stream.seek(position)
        data = stream.read(READ_BYTES)
        try:
            start = zlib.decompressobj(31).decompress(data, 8)
        except zlib.error:
            start = b""
        if not start.startswith(b"WARC/1."):
            position += 1      # the magic was part of something else
            continue
        unpack, used = zlib.decompressobj(31), len(data)
        out = [unpack.decompress(data)]
        while not unpack.eof:
            data = stream.read(READ_BYTES)
            if not data:
                raise ValueError(f"The record at byte {position} has no end")
            used += len(data)
            out.append(unpack.decompress(data))
        yield b"".join(out)
        position += used - len(unpack.unused_data)


def parse(data: bytes) -> dict:
    """The fields of a decoded record, its payload checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and digest_of(payload) != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have its digest")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "payload_bytes": int(fields["WARC-Payload-Length"]) if revisit else len(payload),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def read_archives(archives: DataFrame, with_payload: bool = True, split: int = SPLIT_BYTES) -> DataFrame:
    """Every record of the archives in ``path`` and ``size``, read in byte ranges."""
    import pyarrow as pa

    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    if with_payload:
        kinds["payload"], schema = pa.binary(), schema + ", payload binary"
    shape = pa.schema(list(kinds.items()))

    def run(batches):
        for batch in batches:
            for path, low, high in zip(*(batch.column(c).to_pylist() for c in ("path", "low", "high"))):
                rows, held = [], 0
                with files.open_old(path) as stream:
                    for data in members(stream, low, high):
                        rows.append({k: v for k, v in parse(data).items() if k in kinds})
                        held += len(data) if with_payload else 200
                        if held > READ_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, shape)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, shape)

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = archives.where(F.col("size") > 0).select(
        "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split).cast("bigint"))).alias("low"), "size"
    ).select("path", "low", F.least(F.col("low") + split, F.col("size")).alias("high"))
    return ranges.repartition(parts).mapInArrow(run, schema)
