"""Token-ID / binary output: concatenated ids with Elias-Fano document boundaries.

A token file ("shard") is one byte string:

    magic "TBEF0001" | n_docs u64 | n_ids u64 | first_doc_id i64 | n_null u64 | id_width u64 | 2 section lengths u64
    Elias-Fano of the documents' ends | Elias-Fano of doc_id - first_doc_id | ids, id_width bytes each

Ends of documents take about 2 + log2(n_ids / n_docs) bits each and a sampled select structure; no table of
64-bit offsets is kept. Shards hold whole documents in ascending doc_id and stand, with their counts, in a
Parquet dataset, so that any store Spark can reach can hold them.

Defined results: a null text is an empty text (it has its end id alone); a null doc_id sorts first; rows that
repeat a doc_id follow one another, by a hash of their texts; an empty table makes no shard; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.llm.store import materialize, small_batches
from tidebars.llm.tokens import encoded, vocabulary_size

MAGIC = b"TBEF0001"
HEAD = struct.Struct("<8sQQqQQQQ")
EF_HEAD = struct.Struct("<QQBxxxxxxxQQ")
#: One select sample for so many values.
SAMPLE = 256
#: Ids after which a shard ends with its document.
SHARD_IDS = 2_000_000


class EliasFano:
    """A non-decreasing sequence of integers in [0, universe]."""

    def __init__(self, data: bytes):
        self.n, self.universe, self.low_bits, low_bytes, high_bytes = EF_HEAD.unpack_from(data)
        at = EF_HEAD.size
        self.low = np.frombuffer(data, np.uint8, low_bytes, at)
        self.high = np.frombuffer(data, np.uint8, high_bytes, at + low_bytes)
        self.samples = np.frombuffer(data, np.uint32, -(-self.n // SAMPLE), at + low_bytes + high_bytes)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((universe >> bits) + n + 1, np.uint8)
        high[at] = 1
        packed_low, packed_high = np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little")
        samples = at[::SAMPLE].astype(np.uint32)
        pad = -(EF_HEAD.size + len(packed_low) + len(packed_high)) % 4
        packed_high = np.concatenate([packed_high, np.zeros(pad, np.uint8)])
        return EF_HEAD.pack(n, universe, bits, len(packed_low), len(packed_high)) + packed_low.tobytes() + packed_high.tobytes() + samples.tobytes()

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(-1, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it on, at most SAMPLE ones are passed."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        left, bit = i % SAMPLE, int(self.samples[i // SAMPLE])
        byte, skip, seen = bit // 8, bit % 8, 0
        while True:
            window = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
            window[:skip] = 0
            ones = np.flatnonzero(window)
            if left < seen + len(ones):
                at = byte * 8 + int(ones[left - seen])
                return ((at - i) << self.low_bits) | int(self._lows(i, i + 1)[0])
            seen, byte, skip = seen + len(ones), byte + 64, 0

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        return (at.astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(0, self.n)


def pack_shard(doc_ids: list[int | None], ids: list[np.ndarray], id_width: int) -> bytes:
    """doc_ids ascending, nulls first; ids: those of each document."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) for x in ids]) if ids else np.zeros(0, np.int64)
    n_ids = int(ends[-1]) if len(ids) else 0
    span = int(known[-1]) - first if len(known) else 0
    bounds = EliasFano.encode(ends, n_ids)
    names = EliasFano.encode(known.astype(np.uint64) - np.uint64(first % (1 << 64)), span)
    kind = {2: np.uint16, 4: np.uint32}[id_width]
    if any(len(x) and int(x.max()) > np.iinfo(kind).max for x in ids):
        raise ValueError(f"an id does not fit in {id_width} bytes")
    body = np.concatenate(ids).astype(kind).tobytes() if ids else b""
    return HEAD.pack(MAGIC, len(doc_ids), n_ids, first, len(doc_ids) - len(known), id_width, len(bounds), len(names)) + bounds + names + body


class Shard:
    """A token file's bytes, read without decoding more than is asked for."""

    def __init__(self, data: bytes):
        magic, self.n_docs, self.n_ids, self.first, self.n_null, width, n_bounds, n_names = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        self.ends = EliasFano(data[at : at + n_bounds])
        self.names = EliasFano(data[at + n_bounds : at + n_bounds + n_names])
        self.ids = np.frombuffer(data, {2: np.uint16, 4: np.uint32}[width], self.n_ids, at + n_bounds + n_names)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + (self.names.all() + np.uint64(self.first % (1 << 64))).astype(np.int64).tolist()

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)].astype(np.uint32)


_SHARD = "part int, seq int, n_docs long, n_ids long, before long, data binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None, path: str, id_width: int | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Texts encoded and written to path, in ascending doc_id over all shards (by part, seq).

    id_width: bytes an id; as many as the vocabulary and end_id need unless given. An id that doesn't fit is an error.
    """
    if id_width is None:
        id_width = 2 if max(vocabulary_size(tokenizer_path), (end_id or 0) + 1) <= 1 << 16 else 4

    def shards(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        names: list = []
        ids: list = []
        held = earlier = 0

        def flush():
            row = {"part": part, "seq": seq, "n_docs": len(names), "n_ids": held, "before": earlier, "data": pack_shard(names, ids, id_width)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("before", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, own in encoded(batch.column(1), tokenizer_path, end_id):
                names.append(doc_ids[i])
                ids.append(own)
                held += len(own)
                if held >= shard_ids:
                    yield flush()
                    names, ids, held, seq, earlier = [], [], 0, seq + 1, earlier + held
        if names:
            yield flush()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    # the hash splits a doc_id that holds very many rows over several ranges
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    rows.select("doc_id", "text").mapInArrow(shards, _SHARD).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in all shards), n_tokens, ids_crc32.

    A shard knows the ids before it in its part; those of the parts before are running sums over one short row a part, of
    which there are no more than the writer had partitions, so they are broadcast and no shard's bytes are moved.
    """
    files = spark.read.parquet(path)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = materialize(parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")), "token-file-bases")

    def documents(batches):
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(data.as_py())
                ids, ends = shard.ids.astype("<u4"), shard.ends.all().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(), pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("base"), "data").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
