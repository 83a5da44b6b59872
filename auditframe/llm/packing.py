"""Operator 9: best-fit packing of tokenised documents into fixed-length sequences.

Best-fit decreasing needs only the lengths: pieces of one length are
interchangeable. Spark counts the pieces of each length (at most ``capacity``
different ones) and numbers the pieces of a length; the fit runs over the
counts, longest first, placing all pieces of a length at once. A segment tree
over the remaining capacities finds the tightest open bins for a length in
logarithmic time. The fit's records (runs of piece numbers -> runs of
sequences) then place every piece by its length and number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditframe.llm.bpe import byte_level_encoder
from auditframe.llm.common import Scratch, arrow_map

CAPACITY = 2048
END_ID = 0
#: Pieces of one length are numbered in so many independent parts.
NUMBERING_PARTS = 256


def token_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the pieces of every document's ids."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = (text.as_py() for text in batch.column(1))
        row, piece, start, length, crc = [], [], [], [], []
        for i, ids in enumerate(byte_level_encoder(path).ids(texts)):
            ids += end
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or capacity, n, capacity), n]
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                row.append(i)
                piece.append(p)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(ids[4 * a:4 * b]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=["id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(
        docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), run,
        "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which have open bins, and
    the smallest such capacity that is at least a given length."""

    def __init__(self, size: int):
        self._leaves = 1 << size.bit_length()
        self._open = [False] * (2 * self._leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self._leaves
        self._open[i] = is_open
        while i > 1:
            i //= 2
            self._open[i] = self._open[2 * i] or self._open[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        i = length + self._leaves
        if self._open[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self._open[i + 1]:
                i += 1
                while i < self._leaves:
                    i = 2 * i if self._open[2 * i] else 2 * i + 1
                return i - self._leaves
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Exact best-fit decreasing over ``counts`` (length -> number of pieces).

    Records (length, first number, pieces per sequence, first sequence, offset):
    piece ``first + j`` of that length goes to sequence ``sequence + j // per``
    at ``offset + length * (j % per)``. A bin just used for a length is the
    tightest for its next piece, so a bin takes as many as fit. Bins of equal
    state are kept as runs; the number of records depends on the capacity, not
    on the number of pieces."""
    tree, runs = CapacityTree(capacity), {}

    def put(remaining: int, first: int, number: int) -> None:
        if number and remaining:
            runs.setdefault(remaining, []).append((first, number))
            tree.set(remaining, True)

    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, number = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, bins = capacity, -(-left // (capacity // length))
                first, opened = opened, opened + bins
            else:
                first, bins = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            per = room // length
            full = min(bins, left // per)
            rest = min(left - full * per, per) if full < bins else 0
            out.append((length, number, per, first, capacity - room))
            put(room - per * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), bins - full - bool(rest))
            number += full * per + rest
            left -= full * per + rest
    return out


def _numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``number``: 0, 1, ... within each length. A length is
    numbered in parts by a hash of the piece, so that a frequent one is spread."""
    part = F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.lit(NUMBERING_PARTS))
    spread = pieces.withColumn("part", part)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("length", "part").count().select(
        "length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skipped"))
    inside = Window.partitionBy("length", "part").orderBy("id", "piece", "start", "ids_crc32")
    return (spread.withColumn("number", F.row_number().over(inside) - 1).join(offsets, ["length", "part"])
            .withColumn("number", F.col("number") + F.col("skipped")).drop("part", "skipped"))


def pack(
    scratch: Scratch, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    Documents of more than ``capacity`` ids (with the end id) are cut into
    pieces of ``capacity``, the first of which may be shorter. Ids are those of
    the library's plain call: a special token written out in a text gets its own
    id. Null text is empty: only the end id. Every row is packed, also rows that repeat an id;
    extra columns are ignored; an empty table gives an empty result."""
    pieces = scratch.write(token_pieces(docs, path, id_col, text_col, capacity, end_id))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    records = np.array(sorted(best_fit_decreasing(counts, capacity)), np.int64).reshape(-1, 5)
    lengths, firsts = records[:, 0], records[:, 1]
    begins = np.searchsorted(lengths, np.arange(capacity + 2))

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        length, number = np.asarray(batch.column(3)), np.asarray(batch.column(5))
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for value in np.unique(length):
            rows = np.flatnonzero(length == value)
            a, b = begins[value], begins[value + 1]
            at = a + np.searchsorted(firsts[a:b], number[rows], "right") - 1
            j = number[rows] - firsts[at]
            sequence[rows] = records[at, 3] + j // records[at, 2]
            offset[rows] = records[at, 4] + value * (j % records[at, 2])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
            names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return arrow_map(
        _numbered(pieces).select("id", "piece", "start", "length", "ids_crc32", "number"), place,
        "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
