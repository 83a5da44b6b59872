"""Result table as a bucketed delta store (S8, U6 for many small updates).

Rows lie in buckets by a hash of their key. A batch of updates is written as a delta
next to the base, for the buckets it touches only; nothing else is rewritten. A
reader takes, per key, the row of the latest delta (or the base). Compaction folds
the deltas of buckets that have gathered enough of them into a new base of those
buckets. A manifest, one small JSON file per version and written last, names the
folders that make up the table: a batch is in the table when its manifest is there,
and a batch that is replayed writes the same version again. ``vacuum`` removes what
no kept manifest names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from auditframe.operators.ordinals import with_ordinal
from auditframe.session import cut_lineage, delete_path, path_exists, replace_text

#: Buckets of a table; choose it so that a bucket's base is a file or a few.
BUCKETS = 64
#: Deltas a bucket gathers before ``compact`` folds them.
FOLD_AFTER = 4


class DeltaStore:
    """A table (key, columns, position) under ``root``; ``position`` is the place of
    a key's first appearance, 1, 2, ..."""

    def __init__(self, spark: SparkSession, root: str, schema: str | StructType, key: str = "sample_id", buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = [f.name for f in self.schema.fields]
        if key not in self.columns or {"position", "bucket", "order"} & set(self.columns):
            raise ValueError("the schema needs the key and must leave position, bucket and order to the store")

    # ------------------------------------------------------------- manifests
    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        if not path_exists(self.spark, f"{self.root}/manifest"):
            return []
        fs, p = self._fs(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None, below: int | None = None) -> dict:
        """A version's manifest (default: the latest, of those under ``below``)."""
        known = [v for v in self.versions() if (below is None or v < below) and version in (None, v)]
        if not known:
            return {"version": 0, "epoch": -1, "next": 1, "parts": []}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/manifest/{known[-1]:010d}.json").first()[0])

    def _commit(self, manifest: dict) -> None:
        replace_text(self.spark, f"{self.root}/manifest/{manifest['version']:010d}.json", json.dumps(manifest))

    # ------------------------------------------------------------------ rows
    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str) -> list[int]:
        """Write ``rows`` (columns, position, bucket); the buckets that it holds."""
        kept = [*self.columns, "position", "bucket"]
        rows.select(*kept).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{folder}")
        fs, p = self._fs(f"{self.root}/{folder}")
        return sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(p) if s.isDirectory())

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """All written rows of the buckets with ``order``: later parts stand higher."""
        schema = StructType([*self.schema.fields]).add("position", LongType()).add("bucket", IntegerType())
        out = self.spark.createDataFrame([], StructType([*schema.fields]).add("order", IntegerType()))
        for i, part in enumerate(manifest["parts"]):
            wanted = [b for b in part["buckets"] if buckets is None or b in buckets]
            if wanted:
                found = self.spark.read.schema(schema).parquet(f"{self.root}/{part['folder']}").where(F.col("bucket").isin(wanted))
                out = out.unionByName(found.withColumn("order", F.lit(i)))
        return out

    def _latest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in self.columns if c != self.key] + ["position", "bucket"]
        won = rows.groupBy(self.key).agg(F.max_by(F.struct(*others), "order").alias("w"))
        return won.select(self.key, "w.*")

    def read(self, version: int | None = None) -> DataFrame:
        """The table (columns, position) as of a version."""
        return self._latest(self._rows(self.manifest(version))).select(*self.columns, "position")

    # --------------------------------------------------------------- changes
    def upsert(self, updates: DataFrame, epoch: int | None = None) -> int:
        """Merge ``updates`` (columns and ``version``, larger = later); the new
        version. Keys keep their position; new ones follow in (version, key) order.
        A batch of an epoch that is in the table is written again as that version."""
        before = self.manifest()
        if epoch is not None and before["epoch"] >= epoch:
            repeated = [v for v in self.versions() if self.manifest(v)["epoch"] >= epoch]
            before = self.manifest(below=repeated[0])
        others = [c for c in self.columns if c != self.key]
        last = updates.groupBy(self.key).agg(F.max_by(F.struct(*others, "version"), "version").alias("u"))
        batch = cut_lineage(last.select(self.key, *[F.col(f"u.{c}").alias(c) for c in others], F.col("u.version").alias("version"), self._bucket().alias("bucket")))
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]
        held = self._rows(before, touched).groupBy(self.key).agg(F.max_by("position", "order").alias("position"))
        placed = batch.join(held, self.key, "left")
        fresh = with_ordinal(placed.where("position is null").drop("position"), ["version", self.key], "place")
        fresh = fresh.withColumn("position", F.col("place") + F.lit(before["next"] - 1)).drop("place")
        rows = cut_lineage(placed.where("position is not null").unionByName(fresh))
        added = rows.agg(F.max("position")).first()[0]
        version = before["version"] + 1
        folder = f"delta-{version:010d}"
        after = {
            "version": version, "epoch": before["epoch"] if epoch is None else epoch, "next": max(before["next"], (added or 0) + 1),
            "parts": [*before["parts"], {"folder": folder, "buckets": self._write(rows, folder)}]}
        self._commit(after)
        return version

    def compact(self, fold_after: int = FOLD_AFTER) -> int:
        """Fold the parts of buckets that lie in more than ``fold_after`` of them."""
        before = self.manifest()
        count = {}
        for part in before["parts"]:
            for b in part["buckets"]:
                count[b] = count.get(b, 0) + 1
        full = sorted(b for b, n in count.items() if n > fold_after)
        if not full:
            return before["version"]
        version = before["version"] + 1
        folder = f"base-{version:010d}"
        held = self._write(self._latest(self._rows(before, full)), folder)
        rest = [{"folder": p["folder"], "buckets": [b for b in p["buckets"] if b not in full]} for p in before["parts"]]
        # the folded rows stand first: what other buckets hold does not meet them
        self._commit({**before, "version": version, "parts": [{"folder": folder, "buckets": held}, *[p for p in rest if p["buckets"]]]})
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last ``keep`` versions and the folders only they name."""
        known = self.versions()
        kept = {p["folder"] for v in known[-keep:] for p in self.manifest(v)["parts"]}
        fs, p = self._fs(self.root)
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith(("delta-", "base-")) and name not in kept:
                delete_path(self.spark, f"{self.root}/{name}")
        for v in known[:-keep]:
            delete_path(self.spark, f"{self.root}/manifest/{v:010d}.json")


def upsert_stream_into(store: DeltaStore, updates_dir: str, checkpoint: str, fold_after: int = FOLD_AFTER):
    """Structured Streaming: files landing in ``updates_dir`` become deltas of the
    store, one per micro-batch; buckets are folded as they fill. Of rows that repeat
    a key in a batch, the last in (file, row) order wins."""
    stream = store.spark.readStream.schema(store.schema).parquet(updates_dir).withColumn(
        "version", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))

    def merge(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            store.upsert(batch, epoch)
            store.compact(fold_after)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
