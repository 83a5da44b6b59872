"""Operator 7: embedding near-duplicates by random-hyperplane sign hashing.

Each of several tables hashes a vector to the signs of its dot products with
the table's hyperplanes; vectors that share a bucket of any table are candidates.
A wider sign sketch rules most false candidates out inside the join; the rest
are verified by their exact cosine. Equal vectors are one class (by 128 bits of
label and components), so a frequent vector is compared once. Links are counted
and closed to components.

With angle t between two vectors a sign agrees with probability 1 - t / pi. The
bits of a table follow the number of classes (a bucket holds few classes by
chance), the number of tables follows from the bits, so that a pair at the
threshold is missed by all tables with probability ``MISS``.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import Scratch, arrow_map
from auditframe.llm.components import connected_components

THRESHOLD = 0.93
MISS = 1e-6
#: Classes that share a bucket by chance, about.
CHANCE_CLASSES = 16
SKETCH_BITS = 256
#: The sketch keeps pairs within so many standard deviations of a pair at the threshold.
SKETCH_SIGMAS = 6.5
_SEED = 0xC051


def tables_for(classes: int, threshold: float) -> tuple[int, int]:
    """(bits per table, number of tables)."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(60, max(8, math.ceil(math.log2(max(classes, 1) / CHANCE_CLASSES + 1))))
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree**bits))


@functools.cache
def _planes(dims: int, bits: int, stream: int) -> np.ndarray:
    return np.random.default_rng([_SEED, stream, dims]).standard_normal((dims, bits))


def _classes(vectors: DataFrame) -> DataFrame:
    """(id, h1, h2, scope, vec): 128 bits that identify label and components, 64 bits
    for label and number of components; all null for vectors that link with nothing."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h1, h2, scope, raw = [], [], [], []
        for cell, label in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            v = None
            if label is not None and cell.is_valid and len(cell.values) and not cell.values.null_count:
                v = np.asarray(cell.values, np.float64) + 0.0
                if not np.isfinite(v).all() or not v.any():
                    v = None
            if v is None:
                for column in (h1, h2, scope, raw):
                    column.append(None)
                continue
            # the last slash ends the label, the number of components tells where they begin
            data, group = v.tobytes(), f"{label}/{len(v)}".encode()
            whole = np.frombuffer(hashlib.blake2b(data + group, digest_size=16).digest(), "<i8")
            h1.append(int(whole[0]))
            h2.append(int(whole[1]))
            scope.append(int.from_bytes(hashlib.blake2b(group, digest_size=8).digest(), "little", signed=True))
            raw.append(data)
        longs = [pa.array(column, pa.int64()) for column in (h1, h2, scope)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(raw, pa.binary())], names=["id", "h1", "h2", "scope", "vec"])

    return arrow_map(vectors, run, "id bigint, h1 bigint, h2 bigint, scope bigint, vec binary")


def _numbered(rows: DataFrame) -> DataFrame:
    """(node, h1, h2, first_id, size, scope, vec) per class of ``rows``. ``node`` is a
    number of its own for each, good once the table is written: no two classes share
    one, whatever their hashes."""
    classes = rows.where("h1 is not null").groupBy("h1", "h2").agg(
        F.min("id").alias("first_id"), F.count("*").alias("size"), F.first(F.struct("scope", "vec")).alias("x"))
    return classes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "first_id", "size", "x.*")


def _hashed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(node, scope, s0..s3, keys): sign sketch, and the bucket in every table."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = batch.column(2)
        sizes = np.array([len(x.as_buffer()) // 8 for x in raw])
        sketch = np.zeros((len(raw), SKETCH_BITS // 64), np.int64)
        keys = np.zeros((len(raw), tables), np.int64)
        weight = (1 << np.arange(bits, dtype=np.int64))
        for dims in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dims)
            m = np.stack([np.frombuffer(raw[int(r)].as_buffer(), np.float64) for r in rows])
            # a common scale keeps products of huge or tiny components finite
            m = m / np.abs(m).max(axis=1, keepdims=True)
            sketch[rows] = np.packbits(m @ _planes(dims, SKETCH_BITS, 0) > 0, axis=1).view(np.int64)
            for t in range(tables):
                keys[rows, t] = (m @ _planes(dims, bits, t + 1) > 0) @ weight
        ends = np.arange(len(raw) + 1, dtype=np.int32) * tables
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(4)],
             pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))],
            names=["node", "scope", "s0", "s1", "s2", "s3", "keys"])

    return arrow_map(classes.select("node", "scope", "vec"), run,
                     "node bigint, scope bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, keys array<bigint>")


def _sketches_near(threshold: float) -> Column:
    p = math.acos(threshold) / math.pi
    most = int(SKETCH_BITS * p + SKETCH_SIGMAS * math.sqrt(SKETCH_BITS * p * (1 - p))) + 1
    return sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(4)), F.lit(0)) <= most


def _scaled(v: np.ndarray) -> np.ndarray:
    """``v`` times the power of two that brings its largest component to 0.5 up to 1:
    products stay finite and no component is rounded."""
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def _verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs of one label and length whose cosine reaches the threshold. A bucket
    is a hash, so classes of two scopes may meet in it."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = (_scaled(np.frombuffer(v.as_buffer(), np.float64)) for v in (x, y))
            keep.append(a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(classes.select(F.col("node").alias("a"), F.col("vec").alias("va"), F.col("scope").alias("ga")), "a").join(
        classes.select(F.col("node").alias("b"), F.col("vec").alias("vb"), F.col("scope").alias("gb")), "b").where("ga = gb")
    return arrow_map(both.select("a", "b", "va", "vb"), run, "a bigint, b bigint")


def near_vectors(
    scratch: Scratch, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``vectors``.

    Rows are compared when their labels are equal and not null and their vectors
    have the same number of components. Null, empty and zero vectors and those
    with null or non-finite components link with nothing. ``n_links`` counts
    the other rows linked directly, equal vectors included. Null ids take part
    but never name a component that has another id. Rows that repeat an id are
    counted each. Extra columns are ignored; an empty table gives an empty result."""
    rows = scratch.write(_classes(vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))))
    classes = scratch.write(_numbered(rows))
    hashed = scratch.write(_hashed(classes, *tables_for(classes.count(), threshold)))
    spread = hashed.select("node", "s0", "s1", "s2", "s3", "scope", F.posexplode("keys").alias("table", "key")).select(
        "node", "s0", "s1", "s2", "s3", F.xxhash64("scope", "table", "key").alias("bucket"))
    x, y = spread.alias("x"), spread.alias("y")
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node")) & _sketches_near(threshold)).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    links = scratch.write(_verified(pairs, classes, threshold))
    scratch.drop(hashed)
    components = scratch.write(connected_components(scratch, links))
    sizes = classes.select("node", "size")
    ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ends.join(sizes.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.sum("size").alias("others"))
    labelled = (
        classes.select("node", "h1", "h2", "first_id", "size").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        .join(linked.withColumnRenamed("a", "node"), "node", "left")
        .withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("size") - 1))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = scratch.write(labelled.join(least, "component").select("h1", "h2", "n_links", "component_id"))
    return (
        rows.select("id", "h1", "h2").join(of_class, ["h1", "h2"], "left")
        .select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))
