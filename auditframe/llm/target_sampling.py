"""Operator 13: target-distribution importance resampling by bit-sliced sums.

Features are all runs of 1 to 3 words; a feature's bucket is the CRC-32 of its
UTF-8 bytes modulo ``BUCKETS``. A bucket's gain compares how often the target
texts and the raw texts use it; a document's weight is the sum of the gains of
its features. Gumbel noise from a hash of the id makes the highest scores a draw
without replacement in proportion to the weights.

The sum is bit-sliced. The bucket counts of a document are planes of ``BUCKETS``
bits: plane k holds bit k of every count. The gains are planes as well, in two's
complement: the last plane counts negative. The weight is the sum over pairs of
planes of popcount(count plane AND gain plane) times a power of two, exactly.

CRC-32 is linear, so the CRC of joined strings follows from those of its parts:
crc(a + b) = shift(crc(a), len(b)) ^ crc(b). Each word is hashed once; the runs
of two and three words are combined from their words' CRCs.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import Scratch, arrow_map
from auditframe.llm.importance import kth_largest
from auditframe.operators.ordinals import with_ordinal

BUCKETS = 10_000
MAX_WORDS = 3
#: Documents of fewer words are scored but not drawn.
LEAST_WORDS = 20
#: So many of a hundred eligible documents are drawn.
DRAWN_PERCENT = 5
SEED = 42
#: Texts are hashed together up to so many bytes; a longer text in blocks of so many.
GROUP_BYTES = 1 << 20
#: Documents whose planes are summed together (their counts are a matrix).
GROUP_DOCS = 64

#: The bytes that belong to words, A-Z lowered; all others separate.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_POLY = 0xEDB88320


@functools.cache
def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """``low[n]``: what n zero bytes (0..63) do to a CRC register, as 4 tables of
    256 entries, one for each byte of it; ``high[j]``: the same for 64 * 2**j bytes."""

    def apply(columns: list[int], value: int) -> int:
        out = 0
        for i in range(32):
            if value >> i & 1:
                out ^= columns[i]
        return out

    def tables(columns: list[int]) -> np.ndarray:
        out = np.zeros((4, 256), np.uint32)
        for k in range(4):
            for i in range(8):
                out[k, 1 << i:2 << i] = out[k, :1 << i] ^ np.uint32(columns[8 * k + i])
        return out

    byte = []
    for i in range(32):
        c = 1 << i
        for _ in range(8):
            c = c >> 1 ^ (_POLY if c & 1 else 0)
        byte.append(c)
    low, columns = [], [1 << i for i in range(32)]
    for _ in range(64):
        low.append(tables(columns))
        columns = [apply(byte, c) for c in columns]
    high = []
    for _ in range(26):
        high.append(tables(columns))
        columns = [apply(columns, c) for c in columns]
    return np.stack(low), np.stack(high)


def shift_crc(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRCs after ``length`` more bytes, less those bytes' own part."""
    low, high = _shift_tables()

    def step(t, c: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        parts = [(c >> np.uint32(8 * k)) & np.uint32(255) for k in range(4)]
        if n is None:
            return t[0][parts[0]] ^ t[1][parts[1]] ^ t[2][parts[2]] ^ t[3][parts[3]]
        return t[n, 0, parts[0]] ^ t[n, 1, parts[1]] ^ t[n, 2, parts[2]] ^ t[n, 3, parts[3]]

    out = step(low, crc, length & 63)
    rest, j = length >> 6, 0
    while (rest >> j).any():
        at = np.flatnonzero(rest >> j & 1)
        out[at] = step(high[j], out[at])
        j += 1
    return out


def _blocks(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(words carried over, words) of one text, in blocks cut at separators: a
    block begins with the last ``MAX_WORDS - 1`` words of the one before."""
    text = text.translate(_TABLE)
    if len(text) <= GROUP_BYTES:
        yield 0, text.split()
        return
    a, before = 0, []
    while a < len(text):
        b = text.find(b" ", a + GROUP_BYTES)
        b = len(text) if b < 0 else b
        words = before + text[a:b].split()
        yield len(before), words
        before, a = words[1 - MAX_WORDS:], b


def _features(group: list[tuple[int, int, list[bytes]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, row of each feature, row of each word) of groups
    (row, words carried over, words); carried words only begin features."""
    words = [w for _, _, ws in group for w in ws]
    n = len(words)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    sizes = np.array([len(ws) for _, _, ws in group])
    row = np.repeat(np.array([r for r, _, _ in group]), sizes)
    piece = np.repeat(np.arange(len(group)), sizes)
    at = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    new = at >= np.repeat(np.array([c for _, c, _ in group]), sizes)
    length = np.fromiter(map(len, words), np.int64, n)
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    spaced = crc ^ shift_crc(np.full(n, zlib.crc32(b" "), np.uint32), length)
    buckets, rows, run = [crc[new] % BUCKETS], [row[new]], crc
    for k in range(2, MAX_WORDS + 1):
        if n < k:
            break
        run = shift_crc(run[:-1], length[k - 1:] + 1) ^ spaced[k - 1:]
        keep = (piece[k - 1:] == piece[:n - k + 1]) & new[k - 1:]
        buckets.append(run[keep] % BUCKETS)
        rows.append(row[k - 1:][keep])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(rows), row[new]


def text_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket of each feature, row of each feature, row of each word) of
    consecutive groups of rows; a row may spread over several groups."""
    group, size = [], 0
    for i, text in enumerate(texts.cast(pa.large_binary())):
        for carried, words in _blocks(text.as_py() or b""):
            group.append((i, carried, words))
            size += sum(map(len, words))
            if size >= GROUP_BYTES:
                yield _features(group)
                group, size = [], 0
    yield _features(group)


def bucket_counts(texts: DataFrame, text_col: str) -> np.ndarray:
    """Features per bucket over all rows: each task adds up its own vector, and
    the sums per bucket (a fixed number) come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for bucket, _, _ in text_features(batch.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    sums = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[np.asarray(sums.column(0))] = np.asarray(sums.column(1))
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed target share over the raw share) per bucket."""
    s_all, t_all = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array(
        [math.floor(1000 * math.log((float(t + 1) * s_all) / (float(s + 1) * t_all))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def bit_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits of the last axis as planes of 64-bit words, one
    plane per bit on a new first axis (two's complement for negative values)."""
    pad = -values.shape[-1] % 64
    planes = []
    for k in range(bits):
        packed = np.packbits((values >> k & 1).astype(np.uint8), axis=-1, bitorder="little")
        packed = np.pad(packed, [(0, 0)] * (values.ndim - 1) + [(0, (values.shape[-1] + pad) // 8 - packed.shape[-1])])
        planes.append(np.ascontiguousarray(packed).view("<u8"))
    return np.stack(planes)


def gain_planes(gains: np.ndarray) -> np.ndarray:
    """Two's complement planes of the gains; the last one is the sign."""
    return bit_planes(gains, max(int(np.abs(gains).max(initial=0)).bit_length(), 1) + 1)


def plane_weights(counts: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """Exact sums of counts times gains per row of ``counts``; ``gains`` are planes."""
    out = np.zeros(len(counts), np.int64)
    for k, plane in enumerate(bit_planes(counts, max(int(counts.max(initial=0)).bit_length(), 1))):
        for j, gain in enumerate(gains):
            ones = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) << (k + j)
            out += -ones if j == len(gains) - 1 else ones
    return out


def gumbel_units(id_hash: np.ndarray) -> np.ndarray:
    """floor(-1000 * ln(-ln(u))) with u from 32 bits of a hash."""
    return np.array([math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in id_hash.tolist()], np.int64)


def _id_hash(c: Column, seed: int) -> Column:
    """The first 8 hex digits of sha256('<seed>:<id>') as a number; a null id is
    hashed as the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def score(scratch: Scratch, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row of ``docs``."""
    planes = gain_planes(bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, text_col)))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        n_words, n_features, weight = (np.zeros(n, np.int64) for _ in range(3))
        for bucket, row, word_row in text_features(batch.column(1)):
            n_words += np.bincount(word_row, minlength=n)
            n_features += np.bincount(row, minlength=n)
            order = np.argsort(row, kind="stable")
            bucket, row = bucket[order], row[order]
            present = np.unique(row)
            for a in range(0, len(present), GROUP_DOCS):
                part = present[a:a + GROUP_DOCS]
                lo, hi = np.searchsorted(row, part[0]), np.searchsorted(row, part[-1], "right")
                cell = np.searchsorted(part, row[lo:hi]) * BUCKETS + bucket[lo:hi]
                counts = np.bincount(cell, minlength=len(part) * BUCKETS).reshape(len(part), BUCKETS)
                weight[part] += plane_weights(counts, planes)
        total = weight + gumbel_units(np.asarray(batch.column(2)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *map(pa.array, (n_words, n_features, weight, total))], names=["id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), _id_hash(F.col(id_col), seed).alias("h"))
    return scratch.write(arrow_map(rows, run, "id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"))


def target_resample(
    scratch: Scratch, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    least_words: int = LEAST_WORDS, drawn_percent: int = DRAWN_PERCENT, seed: int = SEED,
) -> DataFrame:
    """(id, n_features, weight, score, rank) per row of ``docs``.

    ``rank`` counts the drawn documents from 1, highest score first, ties to the
    smaller id (null ids last); it is null for the others. Null or blank text has
    no feature and weight 0. Rows that repeat an id share its noise and are drawn
    one by one. Extra columns are ignored; an empty ``docs`` gives an empty
    result; without target texts the smoothed raw counts alone give the gains.

    Only the candidates down to the score of the last draw are sorted: its score
    comes from counts per range of scores."""
    scored = score(scratch, docs, target, id_col, text_col, seed)
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = drawn_percent * eligible.count() // 100
    columns = ["id", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    least = kth_largest(eligible, "score", drawn)
    chosen = (F.col("n_words") >= least_words) & (F.col("score") >= least)
    ranked = with_ordinal(
        scored.where(chosen).select(*columns), [F.desc("score"), F.asc_nulls_last("id"), "weight", "n_features"], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.select(*columns, "rank").unionByName(scored.where(~chosen).select(*columns, F.lit(None).cast("bigint").alias("rank")))
