"""Operator 4: exact dedup through a minimal perfect hash of known digests.

Historical digests are spread over buckets by their leading bits. Each bucket
gets a hash-and-displace function that maps its n digests one to one onto slots
0..n-1; a slot holds the full digest and the winner's locator. A lookup finds
the slot of any digest by arithmetic and compares all its bytes, so digests
that are not in the history never match; those rows are grouped on their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import Scratch, ascii_lower, plain_names

#: Mean number of digests in a bucket and in one displacement group of it.
BUCKET_KEYS = 256
GROUP_KEYS = 4
_PRIME = 2**31 - 1
_MULTIPLIER = 48271


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text with A-Z lower-cased; null is empty."""
    return F.sha2(F.encode(ascii_lower(F.coalesce(text, F.lit(""))), "UTF-8"), 256)


def _piece(digest: Column, i: int) -> Column:
    """The i-th 32-bit piece of a hex digest."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")


def _place(h2, h3, seed, n):
    """Slot of a key under a displacement seed: on Columns and on arrays alike."""
    return (h2 + seed * h3) % _PRIME * _MULTIPLIER % _PRIME % n


def displacements(digests: list[str]) -> list[int]:
    """Seeds, one per displacement group, that place the distinct digests of a
    bucket one to one on 0..n-1 (largest groups first, smallest seed that fits)."""
    n = len(digests)
    h = np.array([[int(d[8 * i:8 * i + 8], 16) for i in (1, 2, 3)] for d in digests], np.int64).reshape(n, 3)
    groups = -(-n // GROUP_KEYS)
    of = h[:, 0] % groups
    taken, seeds = np.zeros(n, bool), [0] * groups
    for g in np.argsort(-np.bincount(of, minlength=groups), kind="stable"):
        keys = h[of == g]
        if not len(keys):
            continue
        first = 0
        while True:
            tries = np.arange(first, first + 512)[:, None]
            at = np.sort(_place(keys[:, 1], keys[:, 2], tries, n), axis=1)
            fits = ~taken[at].any(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1)
            if fits.any():
                hit = int(fits.argmax())
                seeds[g] = first + hit
                taken[at[hit]] = True
                break
            first += 512
    return seeds


class DigestIndex:
    """Minimal perfect hash over distinct digests: ``functions`` (bucket, n,
    seeds) and ``slots`` (bucket, slot, digest, keep_id, group_size)."""

    def __init__(self, scratch: Scratch, entries: DataFrame):
        """``entries``: (digest, keep_id, group_size), digests distinct."""
        self.buckets = max(1, -(-entries.count() // BUCKET_KEYS))

        def build(frame: pd.DataFrame) -> pd.DataFrame:
            seeds = displacements(frame["digest"].tolist())
            return pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "n": [len(frame)], "seeds": [seeds]})

        keyed = entries.withColumn("bucket", self.bucket(F.col("digest")))
        self.functions = scratch.write(
            keyed.select("bucket", "digest").groupBy("bucket").applyInPandas(build, "bucket bigint, n bigint, seeds array<bigint>"))
        self.slots = scratch.write(
            keyed.join(self.functions, "bucket").withColumn("slot", self.slot(F.col("digest")))
            .select("bucket", "slot", "digest", "keep_id", "group_size"))

    def bucket(self, digest: Column) -> Column:
        return _piece(digest, 0) % self.buckets

    @staticmethod
    def slot(digest: Column) -> Column:
        """Needs the bucket's ``n`` and ``seeds`` beside the digest."""
        seed = F.element_at("seeds", (_piece(digest, 1) % F.size("seeds") + 1).cast("int"))
        return _place(_piece(digest, 2), _piece(digest, 3), seed, F.col("n"))

    def lookup(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``digest``) plus ``bucket``, ``slot``, ``keep_id`` and
        ``group_size`` of the slot; the last two null where the slot's digest
        differs in any byte or the bucket is empty."""
        placed = (
            rows.withColumn("bucket", self.bucket(F.col("digest"))).join(self.functions, "bucket", "left")
            .withColumn("slot", self.slot(F.col("digest"))).drop("n", "seeds")
        )
        held = self.slots.withColumnRenamed("digest", "held_digest")
        found = placed.join(held, ["bucket", "slot"], "left")
        same = F.col("held_digest") == F.col("digest")
        return (found.withColumn("member", F.coalesce(same, F.lit(False)))
                .withColumn("keep_id", F.when(F.col("member"), F.col("keep_id")))
                .withColumn("group_size", F.when(F.col("member"), F.col("group_size"))).drop("held_digest"))


def digest_groups(rows: DataFrame) -> DataFrame:
    """(id, digest) rows -> (digest, keep_id: largest id, group_size)."""
    return rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))


def exact_duplicates(
    scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: DataFrame | None = None,
) -> DataFrame:
    """(id, digest, keep_id, group_size, kept, member, bucket, slot) per row.

    Texts are equal when identical after lower-casing A-Z; null is empty. The
    row with the largest id of equal texts stays. ``history`` (digest, keep_id,
    group_size; digests distinct) holds texts of earlier batches: rows found
    there are repeats of the historical winner and none of them stays. Without
    it, the history is that of the table itself: the digests it holds more than
    once. Rows whose digest is not in the index are grouped by digest.

    Rows that repeat both id and text are one document listed again; each of
    them is returned and has the same fate. Null ids never win over others; a
    group of null ids only has a null keep_id and its rows stay.
    """
    rows = scratch.write(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest")))
    known = history if history is not None else digest_groups(rows).where("group_size > 1")
    index = DigestIndex(scratch, scratch.write(known.select("digest", "keep_id", "group_size")))
    found = scratch.write(index.lookup(rows))
    others = found.where(~F.col("member")).drop("keep_id", "group_size")
    alone = others.join(digest_groups(others), "digest")
    out = found.where("member").unionByName(alone)
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    if history is not None:
        stays = stays & ~F.col("member")
    return out.withColumn("kept", stays).select("id", "digest", "keep_id", "group_size", "kept", "member", "bucket", "slot")


def keep_one_per_text(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per distinct text (all columns): that with the
    largest id; of rows that repeat id and text, any one."""
    names, docs = docs.columns, plain_names(docs)
    id_col, text_col = (f"c{names.index(c)}" for c in (id_col, text_col))
    found = exact_duplicates(scratch, docs, id_col, text_col)
    winners = scratch.write(
        found.where("kept").groupBy("id", "digest").agg(F.count("*").alias("_listed"))
        .select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "_listed"))
    hashed = docs.withColumn("_text_digest", text_digest(docs[text_col]))
    kept = hashed.join(winners, (hashed["_text_digest"] == winners["_digest"]) & docs[id_col].eqNullSafe(winners["_id"]))
    again = kept.where("_listed > 1").dropDuplicates(["_id", "_digest"])
    return kept.where("_listed = 1").unionByName(again).select(*docs.columns).toDF(*names)
