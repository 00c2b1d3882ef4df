"""Cost-balanced packing of documents into sequences of bounded length.

A piece of n tokens costs ``linear * n + quadratic * n * n``, the work of a transformer that attends
within pieces. Documents wait in a buffer of ``buffered`` sequences' tokens. When it is full, what is
longer than a sequence is cut into whole sequences; the rest, in descending order, goes piece by
piece to the sequence of the lowest cost with room for it. A piece that fits nowhere is cut over the
cheapest sequences with any room. As many sequences are opened as the tokens fill completely, so
nothing is padded; what is left over waits for the next buffer. At the end of a task, the last
tokens, fewer than one sequence, fill sequences whose lengths are powers of two.

Packing needs no shuffle: a task packs the documents it reads. A task holds one buffer of ids.

Defined cases: a null or empty text is the end token alone; repeated rows are packed once each; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyscope.llm.batches import parts
from tallyscope.llm.tokens import WordTokenizer

END = 2
ROOM = 4096
BUFFERED = 256
#: Fixed ratio: quadratic part of a token's attention against its linear part.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


class Packer:
    """Packs documents of one task. ``add`` and ``finish`` return finished pieces.

    A piece is (document, start, length, sequence, offset); a document is any object.
    """

    def __init__(self, first_sequence: int, room: int = ROOM, buffered: int = BUFFERED):
        self.room, self.buffered = room, buffered
        self.sequence = first_sequence
        self.waiting: list[tuple[object, int, int]] = []
        self.tokens = 0

    def add(self, document: object, length: int) -> list[tuple]:
        self.waiting.append((document, 0, length))
        self.tokens += length
        return self._pack() if self.tokens >= self.room * self.buffered else []

    def finish(self) -> list[tuple]:
        out = self._pack()
        while self.waiting:  # fewer tokens than one sequence: powers of two, largest first
            size, offset = 1 << (self.tokens.bit_length() - 1), 0
            while offset < size:
                document, start, length = self.waiting.pop()
                part = min(length, size - offset)
                out.append((document, start, part, self.sequence, offset))
                offset += part
                if part < length:
                    self.waiting.append((document, start + part, length - part))
            self.sequence += 1
            self.tokens -= size
        return out

    def _pack(self) -> list[tuple]:
        out, rest = [], []
        for document, start, length in self.waiting:
            while length >= self.room:
                out.append((document, start, self.room, self.sequence, 0))
                self.sequence += 1
                start, length = start + self.room, length - self.room
            if length:
                rest.append((document, start, length))
        rest.sort(key=lambda piece: -piece[2])
        count = sum(piece[2] for piece in rest) // self.room
        cost, used = np.zeros(count), np.zeros(count, np.int64)

        def place(piece: tuple, at: int, part: int) -> None:
            out.append((piece[0], piece[1], part, self.sequence + at, int(used[at])))
            used[at] += part
            cost[at] += LINEAR * part + QUADRATIC * part * part

        left = []
        for piece in rest:
            fits = used <= self.room - piece[2]
            if fits.any():
                place(piece, int(np.argmin(np.where(fits, cost, np.inf))), piece[2])
                continue
            document, start, length = piece
            while length and (used < self.room).any():
                at = int(np.argmin(np.where(used < self.room, cost, np.inf)))
                part = min(length, self.room - int(used[at]))
                place((document, start), at, part)
                start, length = start + part, length - part
            if length:
                left.append((document, start, length))
        self.sequence += count
        self.waiting = left
        self.tokens = sum(piece[2] for piece in left)
        return out


def pack(docs: DataFrame, vocabulary: str, room: int = ROOM, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``vocabulary`` is the path of a tokenizer file that drops white space; documents end with END.
    ``room`` is a power of two.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    )
    id_type = None

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        ids = [d[1][start : start + length] for d, start, length, _, _ in pieces]
        columns = {
            "doc_id": pa.array([p[0][0] for p in pieces], id_type),
            "start": pa.array([p[1] for p in pieces], pa.int64()),
            "length": pa.array([p[2] for p in pieces], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
            "doc_tokens": pa.array([len(p[0][1]) for p in pieces], pa.int64()),
            "sequence_id": pa.array([p[3] for p in pieces], pa.int64()),
            "offset": pa.array([p[4] for p in pieces], pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        words = WordTokenizer(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 32, room)
        end = np.array([END], np.uint32)
        for part in parts(batches):
            id_type = part.schema.field("doc_id").type
            done = []
            ids = words.encode(part.column("text").to_pylist())
            for doc_id, own in zip(part.column("doc_id").to_pylist(), ids, strict=True):
                document = (doc_id, np.concatenate((own, end)))
                done += packer.add(document, len(document[1]))
            if done:
                yield rows(done)
        done = packer.finish()
        if done:
            yield rows(done)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
