"""WARC archives of pages as seekable Zstandard bundles, with an index of every record.

Records are grouped into independent Zstandard frames of about ``frame_bytes``; a bundle ends with a
skippable frame that holds the seek table (compressed and plain size of each frame), so any reader
of the seekable format can jump to a frame, and any Zstandard reader can read the whole. The index is
a table: record id, bundle, frame, and the record's offset and length inside the plain frame.

Of records with equal payloads of ``revisit_bytes`` or more, the one with the smallest page_id is a
response and the others are revisits that name it. Each task writes bundles of its own under fresh
names; only bundles of tasks that ended well are in the index, so a task that runs again does no
harm. Nothing is grouped in one task: the digests' groups are reduced to their smallest id.

Defined cases: a null html is an empty payload; rows that repeat page_id and payload are one response
and revisits of that id; null page_ids come after all others, and a revisit of one refers to null;
a null url becomes ``urn:page:`` and the id; control characters and blanks in urls are escaped. An
empty table writes no bundle. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyscope.llm.common import uri_of, written

REVISIT_BYTES = 100
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 28
#: Fixed values of the formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "page_id bigint, record_id string, record_type string, refers_to bigint, bundle string, "
    "frame int, offset bigint, length bigint"
)
_NAMESPACE = uuid.UUID("5a3c1b52-7f0e-4a56-9d6b-0e6a5c2f1d10")


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}/{copy}')}>"


def target_uri(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page: dict, captured: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, whose length is the full payload's."""
    payload = (page["html"] or "").encode()
    revisit = page["record_type"] == "revisit"
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {page['record_type']}",
        f"WARC-Record-ID: {page['record_id']}",
        f"WARC-Date: {captured}",
        f"WARC-Target-URI: {target_uri(page['url'], page['page_id'])}",
        f"WARC-Payload-Digest: sha256:{page['digest']}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {record_id(page['refers_to'], page['digest'], 1)}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record; a damaged record is an error."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record here: {lines[0][:40]!r}")
    warc = dict(line.split(": ", 1) for line in lines[1:])
    size = int(warc["Content-Length"])
    if block[size:] != b"\r\n\r\n":
        raise ValueError(f"record {warc['WARC-Record-ID']} has a wrong length")
    http_head, _, payload = block[:size].partition(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in http_head.decode().split("\r\n")[1:])
    return warc, http, payload


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *frame) for frame in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the end of an open bundle."""
    end = file.size()
    file.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("the bundle has no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(end - 9 - count * width)
    table, frames, start = file.read(count * width), [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", table, i * width)
        frames.append((start, packed, plain))
        start += packed
    return frames


class _Bundle:
    """One open bundle file: frames go out as they fill."""

    def __init__(self, folder: str, frame_bytes: int):
        self.uri = f"{uri_of(folder)}/bundle-{uuid.uuid4().hex}.warc.zst"
        store, path = fs.FileSystem.from_uri(self.uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = store.open_output_stream(path, compression=None)
        self.packer = zstandard.ZstdCompressor(level=3)
        self.frame_bytes = frame_bytes
        self.frames: list[tuple[int, int]] = []
        self.plain: list[bytes] = []
        self.filled = self.bytes = 0

    def add(self, data: bytes) -> tuple[int, int]:
        place = len(self.frames), self.filled
        self.plain.append(data)
        self.filled += len(data)
        if self.filled >= self.frame_bytes:
            self.flush()
        return place

    def flush(self) -> None:
        if self.plain:
            packed = self.packer.compress(b"".join(self.plain))
            self.out.write(packed)
            self.frames.append((len(packed), self.filled))
            self.bytes += len(packed)
            self.plain, self.filled = [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()


def decided(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, copy, record_type and refers_to of each row."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    # the id as text, so that null ids meet in joins and all that follows keeps one partitioning
    rows = pages.select("page_id", "url", "html").withColumns(
        {
            "digest": F.sha2(payload, 256),
            "who": F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
            "bytes": F.octet_length(payload),
        }
    )
    narrow = rows.where(F.col("bytes") >= revisit_bytes).select("digest", "who", "page_id")
    # an id that is null comes last, so it is only the smallest where there is no other
    firsts = (
        narrow.groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
        .select("digest", "first")
    )
    later = (
        narrow.join(firsts, "digest")
        .groupBy("digest", "who")
        .agg(F.first("first").alias("first"))
        .withColumn("shared", F.lit(True))
    )
    copies = W.partitionBy("digest", "who").orderBy("url")
    response = (
        F.col("shared").isNull() | F.col("page_id").eqNullSafe(F.col("first")) & (F.col("copy") == 1)
    )
    return (
        rows.join(later, ["digest", "who"], "left")
        .withColumn("copy", F.row_number().over(copies))
        .withColumn("record_type", F.when(response, "response").otherwise("revisit"))
        .withColumn("refers_to", F.when(~response, F.col("first")))
        .select("page_id", "url", "html", "digest", "copy", "record_type", "refers_to")
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    captured: str = "1970-01-01T00:00:00Z",
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
    revisit_bytes: int = REVISIT_BYTES,
) -> DataFrame:
    """Writes all pages as bundles in ``folder`` (shared by all executors); gives the index table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle = None
        for batch in batches:
            out = []
            for page in batch.to_dict("records"):
                for key in ("page_id", "refers_to"):
                    page[key] = None if pd.isna(page[key]) else int(page[key])
                bundle = bundle or _Bundle(folder, frame_bytes)
                page["record_id"] = record_id(page["page_id"], page["digest"], page["copy"])
                data = record(page, captured)
                frame, offset = bundle.add(data)
                out.append(
                    (
                        page["page_id"],
                        page["record_id"],
                        page["record_type"],
                        page["refers_to"],
                        bundle.uri,
                        frame,
                        offset,
                        len(data),
                    )
                )
                if bundle.bytes >= bundle_bytes:
                    bundle.close()
                    bundle = None
            frame_out = pd.DataFrame(out, columns=[c.split()[0] for c in INDEX.split(", ")])
            yield frame_out.astype({"page_id": "Int64", "refers_to": "Int64"})
        if bundle:
            bundle.close()

    rows = decided(pages, revisit_bytes).withColumns(
        {"page_id": F.col("page_id").cast("bigint"), "refers_to": F.col("refers_to").cast("bigint")}
    )
    return written(rows.mapInPandas(run, INDEX), "warc-index")


@lru_cache(maxsize=64)
def _opened(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    file = store.open_input_file(path)
    return file, read_seek_table(file)


def _frame(uri: str, number: int) -> bytes:
    file, frames = _opened(uri)
    start, packed, plain = frames[number]
    file.seek(start)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)


def read_records(index: DataFrame) -> DataFrame:
    """The records that ``index`` names (any part of it), each frame read once by its place.

    page_id, record_id, record_type, refers_to, url, payload (null for a revisit), payload_bytes and
    payload_digest of the full payload. A response's digest is computed from its payload and held
    against the header.
    """
    schema = (
        "page_id bigint, record_id string, record_type string, refers_to bigint, url string, "
        "payload binary, payload_bytes bigint, payload_digest string"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, plain = None, b""
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (row.bundle, row.frame) != at:
                    at, plain = (row.bundle, row.frame), _frame(row.bundle, row.frame)
                warc, http, payload = parse(plain[row.offset : row.offset + row.length])
                digest = warc["WARC-Payload-Digest"].removeprefix("sha256:")
                kind = warc["WARC-Type"]
                if warc["WARC-Record-ID"] != row.record_id or kind != row.record_type:
                    raise ValueError(f"the index leads {row.record_id} to another record")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of {row.record_id} is damaged")
                out.append(
                    (
                        row.page_id,
                        row.record_id,
                        kind,
                        row.refers_to,
                        warc["WARC-Target-URI"],
                        payload if kind == "response" else None,
                        int(http["Content-Length"]),
                        digest,
                    )
                )
            frame_out = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            yield frame_out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return (
        index.repartition("bundle", "frame")
        .sortWithinPartitions("bundle", "frame", "offset")
        .mapInPandas(run, schema)
    )
