"""Harmonic packing of documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k has the lengths in (capacity / (k + 1), capacity / k], and a bin of
class k is closed with its k-th document. Every worker fills the bins of its own rows, in one pass, without waiting for
another; a sequence never crosses workers, so nothing is shuffled.

What a closed bin leaves free takes documents too. Closed bins with more than a sliver of room wait in a small pool; a
document that fits into one of them goes whole into the tightest, and only one that fits into none starts or joins a
bin of its class. When the pool is full, the next document is cut so that its head fills the roomiest bin. A document
of more than the capacity fills whole sequences first. At the end of the worker's rows what still has room is
run together and cut every `capacity` ids, so a worker pads one sequence, and slivers.

Defined results: a null or empty text is the end id alone; null and repeated doc_ids are packed row by row; an
empty table gives an empty result; columns other than doc_id and text are ignored; a text of any length is packed whole.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.store import small_batches
from tidebars.llm.tokens import encoded

#: Closed bins that wait for documents that fit, and the part of the capacity that isn't worth waiting for.
POOL, SLIVER = 256, 1 / 512


class Piece(NamedTuple):
    """ids[start : start + len(ids)] of a document of doc_tokens ids."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


class Packer:
    """One worker's bins. add() and finish() give whole sequences: lists of pieces."""

    def __init__(self, capacity: int, pool: int = POOL):
        self.capacity, self.most = capacity, pool
        self.sliver = int(capacity * SLIVER)
        self.open: dict[int, list[Piece]] = {}
        #: Closed bins by room, with a number that tells bins of the same room apart.
        self.rooms: list[tuple[int, int]] = []
        self.waiting: dict[int, list[Piece]] = {}
        self.number = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        n, start = len(ids), 0
        while n - start >= self.capacity:
            yield [Piece(doc_id, start, ids[start : start + self.capacity], n)]
            start += self.capacity
        while start < n:
            rest = n - start
            at = bisect.bisect_left(self.rooms, (rest, -1))
            if at < len(self.rooms):
                size = rest
            elif len(self.rooms) >= self.most:
                at, size = len(self.rooms) - 1, self.rooms[-1][0]
            else:
                k = self.capacity // rest
                own = self.open.setdefault(k, [])
                own.append(Piece(doc_id, start, ids[start:].copy() if start else ids, n))
                if len(own) == k:
                    yield from self._wait(self.open.pop(k), self.capacity - sum(len(p.ids) for p in own))
                return
            room, name = self.rooms.pop(at)
            held = self.waiting.pop(name)
            # what waits holds its own ids alone, not those of the document around
            held.append(Piece(doc_id, start, ids[start : start + size].copy() if size < n else ids, n))
            start += size
            yield from self._wait(held, room - size)

    def _wait(self, pieces: list[Piece], room: int) -> Iterator[list[Piece]]:
        if room <= self.sliver:
            yield pieces
            return
        self.number += 1
        bisect.insort(self.rooms, (room, self.number))
        self.waiting[self.number] = pieces

    def finish(self) -> Iterator[list[Piece]]:
        """What still has room, run together and cut at the capacity."""
        left = [p for _, name in self.rooms for p in self.waiting[name]] + [p for k in sorted(self.open) for p in self.open[k]]
        self.open, self.rooms, self.waiting = {}, [], {}
        own: list[Piece] = []
        room = self.capacity
        for p in left:
            at = 0
            while at < len(p.ids):
                take = min(room, len(p.ids) - at)
                own.append(Piece(p.doc_id, p.start + at, p.ids[at : at + take], p.doc_tokens))
                at, room = at + take, room - take
                if not room:
                    yield own
                    own, room = [], self.capacity
        if own:
            yield own


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_tokens long"


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_tokens[, ids].

    sequence_id: the partition's number times 2**33 and a running number; padded_tokens: the sequence's length after padding
    (a power of two stays, else the capacity); ids (with_ids): the piece's ids, little-endian 32-bit.
    """
    schema = pa.schema([*((c.split()[0], pa.int64()) for c in _PIECE.split(", ")), *([("ids", pa.binary())] if with_ids else [])])

    def pieces(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        packer = Packer(capacity)
        rows: list[tuple] = []

        def place(sequence: list[Piece]) -> None:
            nonlocal number
            total = sum(len(p.ids) for p in sequence)
            padded = total if total & (total - 1) == 0 else capacity
            offset = 0
            for p in sequence:
                rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids), p.doc_tokens, number, offset, total, padded, *([p.ids.tobytes()] if with_ids else [])))
                offset += len(p.ids)
            number += 1

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, ids in encoded(batch.column(1), tokenizer_path, end_id):
                for sequence in packer.add(doc_ids[i], ids.astype("<u4")):
                    place(sequence)
                if len(rows) >= 10_000:
                    yield batch_of()
        for sequence in packer.finish():
            place(sequence)
        if rows:
            yield batch_of()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pieces, _PIECE + (", ids binary" if with_ids else ""))
