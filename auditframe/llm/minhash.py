"""Operator 10: near-duplicate texts by circulant MinHash.

Signatures use two permutations only: ``sigma`` scatters a shingle over a
universe of 2**22 places, ``pi`` orders that universe, and coordinate k of a
signature is the least ``pi`` value found at the shingles' places shifted
round the circle by k. The first bands * rows coordinates are banded; the low
bits of all 256 coordinates make a sketch that rules pairs out before their
full sets are compared.

Work inside a hot bucket stays linear in the first round: each member is paired
with the bucket's hub only, the member that shares its buckets with most others.
The exact links give components; a bucket whose members lie in one component is
finished. The first round also keeps
what each member lacks of its hub and has beyond it; from these differences the
exact overlap of two members follows without their sets. So the second round
compares the members of every open bucket with another member of it, drawn at
random per bucket, and the families of many near copies come together. The last
round pairs members of the buckets that are still open across components, so no
link between two components is lost; far members of a large family make no pair
rows there. Every link rests on the full shingle sets.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from auditframe.llm.common import Scratch, arrow_map, plain_names
from auditframe.llm.components import connected_components
from auditframe.llm.textscan import mix64, shingle_set, text_slices, word_hashes

UNIVERSE_BITS = 22
COORDINATES = 256
#: A pair of similarity s differs in a sketch bit with probability (1 - s) / 2;
#: the sketch keeps pairs within this many standard deviations of that mean.
SKETCH_SIGMAS = 6.5
_SEED = 0x5EED_C1AC


@functools.cache
def _windows() -> np.ndarray:
    """Row p: pi at places p, p + 1, ... round the circle, one per coordinate."""
    pi = np.random.default_rng(_SEED).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:COORDINATES]]), COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Circulant MinHash of a non-empty shingle set (sigma: the hash's high bits)."""
    places = (mix64(shingles) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    windows, out = _windows(), None
    for i in range(0, len(places), 256):
        low = windows[places[i:i + 256]].min(axis=0)
        out = low if out is None else np.minimum(out, low)
    return out


def node_of(shingles: np.ndarray) -> int:
    """Signed 64-bit identity of a shingle set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _row_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, raw, offs in text_slices(texts):
        words, at = word_hashes(raw, offs)
        for i in range(len(offs) - 1):
            yield shingle_set(words[at[i]:at[i + 1]], k)


def _band_keys(sigs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per row of ``sigs`` and band."""
    keys = np.zeros((len(sigs), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        keys = mix64(keys * np.uint64(0x9E6C_63D0_876A_3F2B) + sigs[:, j:bands * rows:rows])
    return keys.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n, node, s0..s3, bands) per row; node and the rest null for empty sets."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, node, sigs, full = [], [], [], []
        for s in _row_sets(batch.column(1), k):
            n.append(len(s))
            full.append(len(s) > 0)
            node.append(node_of(s) if len(s) else 0)
            if len(s):
                sigs.append(signature(s))
        full = np.array(full)
        m = np.array(sigs, np.uint32).reshape(len(sigs), COORDINATES)
        sketch = np.zeros((len(full), COORDINATES // 64), np.int64)
        sketch[full] = np.packbits((m & 1).astype(np.uint8), axis=1).view(np.int64)
        keys = _band_keys(m, bands, rows).reshape(-1)
        ends = np.concatenate([[0], np.cumsum(full)]) * bands
        empty = ~full
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64(), mask=empty)]
            + [pa.array(sketch[:, i], mask=empty) for i in range(4)]
            + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))],
            names=["id", "n", "node", "s0", "s1", "s2", "s3", "bands"],
        )

    return arrow_map(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run,
        "id bigint, n bigint, node bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, bands array<bigint>",
    )


def _near(percent: int, a: str, b: str) -> Column:
    """Could sets a and b be similar enough, by their sizes and sketches?"""
    p = (1 - percent / 100) / 2
    most = int(COORDINATES * p + SKETCH_SIGMAS * (COORDINATES * p * (1 - p)) ** 0.5) + 1
    apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(4)), F.lit(0))
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (apart <= most)


def _set_table(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, shingles) of the wanted classes, read from the text of each
    class's first document (found by id, confirmed by its node)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = list(_row_sets(batch.column(0), k))
        yield pa.RecordBatch.from_arrays(
            [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.large_binary())],
            names=["node", "shingles"],
        )

    ids = wanted.select(F.col("first_id").alias("_first")).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(
        ids, F.col("_id").eqNullSafe(F.col("_first")), "left_semi").select("text")
    return arrow_map(texts, run, "node bigint, shingles binary").dropDuplicates(["node"])


def _similar(shared, a, b, percent: int):
    """100 * intersection >= percent * union, on numbers and on Columns."""
    return 100 * shared >= percent * (a + b - shared)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked, n_a, lacks, has) per pair: are the full sets similar enough,
    and where they are not far apart, what b lacks of a and has beyond it."""
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        linked, size, lacks, has = [], [], [], []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            sa, sb = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            shared = np.intersect1d(sa, sb, assume_unique=True)
            linked.append(_similar(len(shared), len(sa), len(sb), percent))
            size.append(len(sa))
            near = 3 * len(shared) >= len(sa) + len(sb) - len(shared)
            lacks.append(np.setdiff1d(sa, shared, assume_unique=True).view(np.int64) if near else None)
            has.append(np.setdiff1d(sb, shared, assume_unique=True).view(np.int64) if near else None)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(size, pa.int64()), pa.array(lacks, kind), pa.array(has, kind)],
            names=["a", "b", "linked", "n_a", "lacks", "has"])

    return arrow_map(both.select("a", "b", "sa", "sb"), run,
                     "a bigint, b bigint, linked boolean, n_a bigint, lacks array<bigint>, has array<bigint>")


def _overlap_enough(percent: int) -> Column:
    """True unless the differences of p and q from their bucket's hub are known
    and their exact overlap is too small."""
    def size(c: Column) -> Column:
        return F.size(c).cast("bigint")

    lost = size(F.col("p.lacks")) + size(F.col("q.lacks")) - size(F.array_intersect("p.lacks", "q.lacks"))
    shared = F.col("p.n_hub") - lost + size(F.array_intersect("p.has", "q.has"))
    unknown = F.col("p.lacks").isNull() | F.col("q.lacks").isNull()
    return F.when(unknown, F.lit(True)).otherwise(_similar(shared, F.col("p.n"), F.col("q.n"), percent))


def _relabelled(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """(node, component) after components (nodes of ``merged``) came together;
    a node without a label is its own component."""
    to = merged.select(F.col("node").alias("component"), F.col("component").alias("merged"))
    moved = labels.join(to, "component", "left").select("node", F.coalesce("merged", "component").alias("component"))
    new = to.join(labels.select("component"), "component", "left_anti").select(F.col("component").alias("node"), F.col("merged").alias("component"))
    return moved.union(new)


def _shared_buckets(scratch: Scratch, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, node) of the buckets with two members at least, and (bucket, hub)."""
    all_ = classes.select("node", F.explode("bands").alias("bucket"))
    sizes = all_.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.write(all_.join(sizes, "bucket"))
    shares = members.groupBy("node").agg(F.sum("size").alias("shared"))
    hubs = members.select("bucket", "node").join(shares, "node").groupBy("bucket").agg(
        F.max(F.struct("shared", "node"))["node"].alias("hub"))
    return members.select("bucket", "node"), scratch.write(hubs)


def _open_buckets(members: DataFrame, hubs: DataFrame, narrow: DataFrame, labels: DataFrame, apart: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with their known
    differences from the bucket's hub: (bucket, node, n, s0..s3, component,
    n_hub, lacks, has)."""
    labelled = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("bucket")
    is_hub = F.col("node") == F.col("hub")
    none = F.array().cast("array<bigint>")
    inside = labelled.join(open_.join(hubs, "bucket"), "bucket")
    return inside.join(narrow, "node").join(apart, ["hub", "node"], "left").withColumns({
        "n_hub": F.when(is_hub, F.col("n")).otherwise(F.col("n_hub")),
        "lacks": F.when(is_hub, none).otherwise(F.col("lacks")), "has": F.when(is_hub, none).otherwise(F.col("has"))}).drop("hub")


def _linked_classes(
    scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, shingle_words: int = 5,
    similarity_percent: int = 80, bands: int = 32, rows_per_band: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """(id, n, node) per row of ``docs``, and (node, first_id, component) per class:
    its smallest id and the smallest node that its links reach."""
    percent = similarity_percent
    sig = scratch.write(signatures(docs, id_col, text_col, shingle_words, bands, rows_per_band))
    classes = scratch.write(
        sig.where("node is not null").groupBy("node")
        .agg(F.min("id").alias("first_id"), F.first(F.struct("n", "s0", "s1", "s2", "s3", "bands")).alias("x"))
        .select("node", "first_id", "x.*")
    )
    members, hubs = _shared_buckets(scratch, classes)
    rows, wide, classes = scratch.write(sig.select("id", "n", "node")), classes, scratch.write(classes.drop("bands"))
    scratch.drop(sig, wide)
    narrow = classes.drop("first_id")
    star = members.join(hubs, "bucket").where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    x, y = narrow.alias("x"), narrow.alias("y")
    pairs = scratch.write(
        star.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
        .where(_near(percent, "x", "y")).select("a", "b")
    )

    def sets_of(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = scratch.write(classes.select("node", "first_id").join(nodes, "node"))
        return scratch.write(_set_table(docs, wanted, id_col, text_col, shingle_words))

    sets = sets_of(pairs)
    tested = scratch.write(_confirm(pairs, sets, percent))
    scratch.drop(sets)
    first = scratch.write(connected_components(scratch, tested.where("linked")))

    apart = tested.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.col("n_a").alias("n_hub"), "lacks", "has")

    rest = scratch.write(_open_buckets(members, hubs, narrow, first, apart))
    known = rest.where("lacks is not null")
    drawn = known.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), "node")).alias("q")).select("bucket", "q.node")
    p, q = rest.alias("p"), known.join(drawn, ["bucket", "node"], "left_semi").alias("q")
    linked = p.join(q, (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.component") != F.col("q.component"))
                    & F.col("p.lacks").isNotNull() & _near(percent, "p", "q") & _overlap_enough(percent))
    merged = connected_components(scratch, linked.select(F.col("p.component").alias("a"), F.col("q.component").alias("b")).distinct())
    second = scratch.write(_relabelled(first, scratch.write(merged)))
    scratch.drop(rest)

    rest = scratch.write(_open_buckets(members, hubs, narrow, second, apart))
    p, q = rest.alias("p"), rest.alias("q")
    across = (
        p.join(q, (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.component") < F.col("q.component")) & _near(percent, "p", "q")
               & _overlap_enough(percent))
        .select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"),
                F.col("p.component").alias("ca"), F.col("q.component").alias("cb")).distinct()
    )
    pairs2 = scratch.write(across.join(pairs, ["a", "b"], "left_anti"))
    scratch.drop(rest)
    sets2 = sets_of(pairs2)
    good = _confirm(pairs2.select("a", "b"), sets2, percent).where("linked")
    links2 = pairs2.join(good, ["a", "b"], "left_semi").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    label = _relabelled(second, scratch.write(connected_components(scratch, links2)))
    scratch.drop(sets2)

    return rows, classes.select("node", "first_id").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(
    scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options,
) -> DataFrame:
    """(id, n_shingles, node, component_id, kept) per row of ``docs``.

    Rows with the same shingle set are one class (``node``; null for an empty
    set, which links with nothing). Classes are linked when
    100 * intersection >= similarity_percent * union of their full sets;
    ``component_id`` is the smallest id reachable, ``kept`` marks the rows that
    have it. With 32 bands of 4 rows a pair at similarity 0.8 misses every band
    with probability 5e-8.

    Null or blank text: empty set, component of its own id. Null id: takes part
    in linking, never names a component unless it has no other id (kept then
    compares null-safely). Rows that repeat an id share its fate. Extra
    columns are ignored; an empty table gives an empty result.
    """
    rows, class_label = _linked_classes(scratch, docs, id_col, text_col, **options)
    least = scratch.write(class_label.groupBy("component").agg(F.min("first_id").alias("component_id")))
    of_node = scratch.write(class_label.join(least, "component").select("node", "component_id"))
    return (
        rows.join(of_node, "node", "left")
        .select("id", F.col("n").alias("n_shingles"), "node",
                F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    )


def _with_node(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """``docs`` with ``_node``, the identity of the row's shingle set (null: empty)."""
    text_at, names = docs.columns.index(text_col), [*docs.columns, "_node"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nodes = [node_of(s) if len(s) else None for s in _row_sets(batch.column(text_at), k)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=names)

    return arrow_map(docs, run, StructType([*docs.schema.fields, StructField("_node", LongType())]))


def keep_one_per_group(
    scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, **options,
) -> DataFrame:
    """One document of ``docs`` per group of near-duplicates (all columns): that with
    the group's smallest id (null only if it has no other), found by id, shingle
    set and a hash of the text. Rows that repeat id and text are one document and
    share its fate. Rows with an empty set link with nothing and all stay."""
    names, docs = docs.columns, plain_names(docs)
    id_col, text_col = (f"c{names.index(c)}" for c in (id_col, text_col))
    rows, classes = _linked_classes(scratch, docs, id_col, text_col, shingle_words, **options)
    first = F.struct(F.col("first_id").isNull().alias("unnamed"), F.col("first_id").alias("_id"), F.col("node").alias("_set"))
    least = classes.groupBy("component").agg(F.min(first).alias("w")).select("w._id", "w._set")
    listed = rows.where("node is not null").groupBy("id", "node").agg(F.count("*").alias("_listed"))
    winners = scratch.write(
        least.join(listed, least["_id"].eqNullSafe(listed["id"]) & (F.col("_set") == F.col("node"))).select("_id", "_set", "_listed"))
    # a set or, where it is empty, a hash of the text: blank texts do not meet in one task
    keyed = _with_node(docs, text_col, shingle_words).withColumn("_key", F.coalesce("_node", F.xxhash64(id_col, text_col)))
    found = keyed.join(winners, (keyed["_key"] == winners["_set"]) & keyed[id_col].eqNullSafe(winners["_id"]), "left")
    out = found.where("_node is null or _listed = 1")
    if not winners.where("_listed > 1").isEmpty():
        again = scratch.write(found.where("_node is not null and _listed > 1").withColumn("_hash", F.xxhash64(text_col)))
        one = again.groupBy("_id", "_set").agg(F.min("_hash").alias("_least"))
        same = again["_id"].eqNullSafe(one["_id"]) & (again["_set"] == one["_set"]) & (again["_hash"] == one["_least"])
        out = out.select(*docs.columns).unionByName(again.join(one, same, "left_semi").select(*docs.columns))
    return out.select(*docs.columns).toDF(*names)
