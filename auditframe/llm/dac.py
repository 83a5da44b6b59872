"""Operator 8: token ids as directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level 0 holds the lowest
chunk of every id; a bitmap says which ids go on in the next level, and a rank
directory (set bits before every 512-bit block) finds the place of id i there.
Any id is read with one look per level, without decoding its neighbours.

Ids are written in ascending document order as segments of whole documents;
each segment is one blob (layout below) in a row of a Parquet table, written by
the task that holds the range of documents.

Segment layout, little-endian: 4 bytes ``DAC1``; u32 documents; u32 levels;
i64 document ids; u8 id-is-known flags; u64 first id of each document and the
total; then per level u64 number of chunks, the chunks, and (but for the last
level) the bitmap, lowest bit first, and u64 ranks of its blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.bpe import word_end_encoder
from auditframe.llm.common import Scratch, arrow_map

MAGIC = b"DAC1"
LEVEL_BITS = 8
BLOCK_BITS = 512
END_ID = 2
#: A segment ends with the document that brings it to so many ids.
SEGMENT_IDS = 1 << 18


class Level:
    """One level: its chunks, and where an id goes on, in the next level."""

    def __init__(self, chunks: np.ndarray, bitmap: np.ndarray | None, ranks: np.ndarray | None):
        self.chunks, self.bitmap, self.ranks = chunks, bitmap, ranks

    def goes_on(self, i: int) -> bool:
        return self.bitmap is not None and bool(self.bitmap[i >> 3] >> (i & 7) & 1)

    def rank(self, i: int) -> int:
        """Set bits before bit i, from the directory and one block."""
        block = i // BLOCK_BITS
        first = block * BLOCK_BITS // 8
        ones = int(np.bitwise_count(self.bitmap[first:i >> 3]).sum()) + int(self.ranks[block])
        return ones + int(self.bitmap[i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else ones


def encode_levels(ids: np.ndarray) -> list[Level]:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunks = (rest & 0xFF).astype(np.uint8)
        rest = rest >> LEVEL_BITS
        more = rest > 0
        if not more.any():
            return [*levels, Level(chunks, None, None)]
        bitmap = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(np.bitwise_count(bitmap).astype(np.uint64), np.arange(0, len(bitmap), BLOCK_BITS // 8))
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<u8")
        levels.append(Level(chunks, bitmap, ranks))
        rest = rest[more]


class Segment:
    """A read segment: ``access`` for one id, ``document`` for a document's ids."""

    def __init__(self, blob: bytes):
        magic, docs, levels = struct.unpack_from("<4sII", blob)
        if magic != MAGIC:
            raise ValueError("not a DAC1 segment")
        at = 12

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.known, self.starts = take("<i8", docs), take("u1", docs), take("<u8", docs + 1)
        self.levels = []
        for k in range(levels):
            n = int(take("<u8", 1)[0])
            chunks = take("u1", n)
            last = k == levels - 1
            size = -(-n // 8)
            self.levels.append(Level(chunks, None if last else take("u1", size), None if last else take("<u8", -(-size // (BLOCK_BITS // 8)) + 1)))

    def access(self, i: int) -> int:
        """The i-th id of the segment."""
        value, shift = 0, 0
        for level in self.levels:
            value |= int(level.chunks[i]) << shift
            if not level.goes_on(i):
                break
            i, shift = level.rank(i), shift + LEVEL_BITS
        return value

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a..b-1: each level's stretch is found by rank."""
        out, where, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for level in self.levels:
            out[where] |= level.chunks[a:b].astype(np.uint32) << np.uint32(shift)
            if level.bitmap is None:
                break
            bits = np.unpackbits(level.bitmap[a >> 3:-(-b // 8)], bitorder="little")[a & 7:(a & 7) + b - a]
            where = where[bits.astype(bool)]
            if not len(where):
                break
            a = level.rank(a)
            b, shift = a + len(where), shift + LEVEL_BITS
        return out

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def pack_segment(documents: list[tuple[int | None, bytes]]) -> bytes:
    """Documents (id, ids as little-endian u32 bytes) -> one segment."""
    sizes = [len(ids) // 4 for _, ids in documents]
    levels = encode_levels(np.frombuffer(b"".join(ids for _, ids in documents), "<u4"))
    out = [
        struct.pack("<4sII", MAGIC, len(documents), len(levels)),
        np.array([i or 0 for i, _ in documents], "<i8").tobytes(), np.array([i is not None for i, _ in documents], "u1").tobytes(),
        np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes(),
    ]
    for level in levels:
        out += [struct.pack("<Q", len(level.chunks)), level.chunks.tobytes()]
        if level.bitmap is not None:
            out += [level.bitmap.tobytes(), level.ranks.tobytes()]
    return b"".join(out)


def write_segments(
    scratch: Scratch, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
    segment_ids: int = SEGMENT_IDS,
) -> DataFrame:
    """(part, segment, start, n_ids, blob): the written segments; ``start`` counts
    the ids before a segment in its part. Parts hold ascending ranges of ids.

    Ids are those of the library's plain call: a special token written out in a
    text gets its own id. Null text: only the end id. Null ids come first; rows that repeat an id
    follow each other in the order of a hash of their text."""
    end = np.array([end_id], "<u4").tobytes()
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_end_encoder(path), TaskContext.get().partitionId()
        held, size, start, segment = [], 0, 0, 0

        def close() -> pa.RecordBatch:
            row = (part, segment, start, size, pack_segment(held))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["part", "segment", "start", "n_ids", "blob"])

        for batch in batches:
            texts = (text.as_py() for text in batch.column(1))
            for i, ids in zip(batch.column(0).to_pylist(), encoder.ids(texts), strict=True):
                ids += end
                held.append((i, ids))
                size += len(ids) // 4
                if size >= segment_ids:
                    yield close()
                    held, start, segment, size = [], start + size, segment + 1, 0
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("h"))
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    return scratch.write(ordered.mapInArrow(run, "part int, segment int, start bigint, n_ids bigint, blob binary"))


def read_segments(segments: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) per document, read from the segments.
    Only the total of each part (one row per part) reaches the driver."""
    totals = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before = np.zeros(max(totals, default=0) + 2, np.int64)
    for part, n in totals.items():
        before[part + 1] = n
    before = np.cumsum(before)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, start, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            segment = Segment(blob.as_buffer().to_pybytes())
            n = len(segment.doc_ids)
            crc = [zlib.crc32(segment.document(k).astype("<u4").tobytes()) for k in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment.doc_ids, mask=segment.known == 0), pa.array(segment.starts[:-1].astype(np.int64) + start + before[part]),
                 pa.array(np.diff(segment.starts.astype(np.int64))), pa.array(crc, pa.int64())],
                names=["id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(segments.select("part", "start", "blob"), run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
