"""Token ids as directly addressable codes.

An id is cut into chunks of ``bits`` bits. Level 0 holds the low chunk of every id, level 1 the next chunk of the ids that need
one, and so on. Each level has a bitmap that tells which of its entries go on, and a directory of counts before every block of
that bitmap; entry ``i`` goes on at place ``rank(i)`` of the next level. Any id is found that way with one look per level.

A file is a Parquet table of segments in ascending ``doc_id`` order. A segment holds whole documents.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeweave.llm.common import documents_of
from lakeweave.llm.tokens import encoder, slices_of, tokenizer_path

# Fixed values of the format.
MAGIC = b"DAC1"
BLOCK_BYTES = 64
HEADER = struct.Struct("<4sBBQQ")  # magic, bits, levels, ids, documents
LEVEL = struct.Struct("<QQ")  # entries, blocks

#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 20

SEGMENTS = "part int, seq int, before long, n_ids long, segment binary"


def encode_segment(ids: np.ndarray, lengths: np.ndarray, doc_ids: list, bits: int = 8) -> bytes:
    """Bytes of one segment. ``lengths`` are the ids of each document; a ``doc_id`` may be None."""
    if not 1 <= bits <= 16:
        raise ValueError("bits must lie between 1 and 16")
    store = np.uint8 if bits <= 8 else np.dtype("<u2")
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        chunk = (rest & np.uint32((1 << bits) - 1)).astype(store)
        rest = rest >> np.uint32(bits)
        goes_on = rest > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        bitmap = np.pad(bitmap, (0, -len(bitmap) % BLOCK_BYTES))
        ones = np.bitwise_count(bitmap).reshape(-1, BLOCK_BYTES).sum(axis=1, dtype=np.uint32)
        directory = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")
        levels.append(LEVEL.pack(len(chunk), len(ones)) + chunk.tobytes() + bitmap.tobytes() + directory.tobytes())
        rest = rest[goes_on]
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    names = np.array([d if d is not None else 0 for d in doc_ids], dtype="<i8")
    head = HEADER.pack(MAGIC, bits, len(levels), len(ids), len(doc_ids))
    return b"".join([head, known.tobytes(), names.tobytes(), np.asarray(lengths, dtype="<u8").tobytes(), *levels])


class Segment:
    """A view of a segment's bytes."""

    def __init__(self, data: bytes):
        magic, self.bits, n_levels, self.n_ids, self.n_docs = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        at = HEADER.size
        known = np.frombuffer(data, np.uint8, self.n_docs, at)
        at += self.n_docs
        names = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.lengths = np.frombuffer(data, "<u8", self.n_docs, at).astype(np.int64)
        at += 8 * self.n_docs
        self.doc_ids = [int(d) if k else None for d, k in zip(names, known, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        store = np.dtype(np.uint8 if self.bits <= 8 else "<u2")
        self.levels = []
        for _ in range(n_levels):
            entries, blocks = LEVEL.unpack_from(data, at)
            at += LEVEL.size
            chunk = np.frombuffer(data, store, entries, at)
            at += entries * store.itemsize
            bitmap = np.frombuffer(data, np.uint8, blocks * BLOCK_BYTES, at)
            at += blocks * BLOCK_BYTES
            directory = np.frombuffer(data, "<u4", blocks, at)
            at += 4 * blocks
            self.levels.append((chunk, bitmap, directory))

    def id_at(self, i: int) -> int:
        """Id number ``i``: one chunk, one bit and one count per level, no decoding of neighbours."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (chunk, bitmap, directory) in enumerate(self.levels):
            value |= int(chunk[i]) << (k * self.bits)
            byte, bit = divmod(i, 8)
            if not bitmap[byte] >> bit & 1:
                break
            block = byte // BLOCK_BYTES
            inside = np.bitwise_count(bitmap[block * BLOCK_BYTES : byte]).sum(dtype=np.int64)
            i = int(directory[block]) + int(inside) + int(bitmap[byte] & ((1 << bit) - 1)).bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All ids, level by level from the last one."""
        higher = np.zeros(0, dtype=np.uint32)
        for chunk, bitmap, _ in reversed(self.levels):
            value = chunk.astype(np.uint32)
            goes_on = np.unpackbits(bitmap, count=len(chunk), bitorder="little").astype(bool)
            value[goes_on] |= higher << np.uint32(self.bits)
            higher = value
        return higher


def write_codes(docs: DataFrame, target: str, path: str | None = None, end_id: int = 2, keeps_space: bool = False, bits: int = 8, segment_ids: int = SEGMENT_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts and writes the segments to the folder ``target``.

    A null or empty text has the end id alone. Null ids come first; rows of equal id are ordered by a hash of their text, which also deals
    them to several tasks where one id, or none, has many rows.
    """
    path = path or tokenizer_path("word_bpe_49k.json")

    def segments(batches):
        own, part = encoder(path, keeps_space), TaskContext.get().partitionId()
        held, names, seq, before = [], [], 0, 0

        def close():
            nonlocal held, names, seq, before
            ids = np.concatenate([x for x, _ in held])
            data = encode_segment(ids, np.concatenate([n for _, n in held]), names, bits)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "segment": pa.array([data], pa.binary())})
            held, names, seq, before = [], [], seq + 1, before + len(ids)
            return row

        for batch in batches:
            for a, b in slices_of(batch.column(1)):
                ids, lengths = own.flat_ids(batch.column(1).slice(a, b - a))
                held.append((np.insert(ids, np.cumsum(lengths), np.uint32(end_id)), lengths + 1))
                names += batch.column(0).slice(a, b - a).to_pylist()
                if sum(len(x) for x, _ in held) >= segment_ids:
                    yield close()
        if held:
            yield close()

    rows = documents_of(docs, id_col, text_col).withColumn("dealt", F.xxhash64("text")).repartitionByRange("doc_id", "dealt").sortWithinPartitions("doc_id", "dealt", "text")
    rows.select("doc_id", "text").mapInArrow(segments, SEGMENTS).write.parquet(target)


def read_codes(spark: SparkSession, target: str) -> DataFrame:
    """Segments with ``start``, the number of ids in all segments before."""
    stored = spark.read.schema(SEGMENTS).parquet(target)
    # One row for each range partition that wrote the folder, so the table is as small as that setting.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return stored.join(F.broadcast(base), "part").select("segment", (F.col("base") + F.col("before")).alias("start"))


def stored_documents(segments: DataFrame) -> DataFrame:
    """Each document as the files have it: ``doc_id, start, n_tokens, ids_crc32`` of its ids as 32-bit little-endian numbers."""

    def decode(batches):
        for batch in batches:
            for data, start in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                segment = Segment(data.as_py())
                ids = segment.ids().astype("<u4")
                ends = segment.starts
                crc = [zlib.crc32(ids[ends[k] : ends[k + 1]].tobytes()) for k in range(segment.n_docs)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(segment.doc_ids, pa.int64()), "start": pa.array(start + ends[:-1], pa.int64()), "n_tokens": pa.array(segment.lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return segments.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
