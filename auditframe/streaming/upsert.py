"""Incremental result upsert as a Structured Streaming job.

The reference has no streaming operator; its incremental piece is the
result-table upsert (S8) fed by runs and reruns. Here a stream of new result
rows (files landing in a folder) is merged into the result table by
``foreachBatch``: each micro-batch is upserted with the batch S8 plan and the
new table version is written to a fresh path, so a failed batch never leaves
a half-written table. A replayed batch (same epoch id) starts again from the
newest version below its own and writes the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.plans.inference import upsert


def table_version_path(root: str, epoch: int) -> str:
    return f"{root.rstrip('/')}/v{epoch:010d}"


def upsert_stream(
    spark: SparkSession,
    updates_dir: str,
    schema: str,
    table_root: str,
    checkpoint: str,
    initial: DataFrame | None = None,
    key: str = "sample_id",
):
    """Start the streaming upsert; returns the ``StreamingQuery``.

    ``schema`` describes the update files (Parquet) and must contain ``key``;
    the table keeps ``position`` (first appearance) like the batch upsert. Of
    rows that repeat a key in one batch, the last in (file, row) order wins.
    """
    if initial is not None:
        initial.write.mode("overwrite").parquet(table_version_path(table_root, 0))
    stream = spark.readStream.schema(schema).parquet(updates_dir).withColumn(
        "version", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))

    def merge(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        current = latest_table(spark, table_root, below=epoch + 1)
        if current is None:
            cols = [c for c in batch.columns if c not in (key, "version")]
            current = spark.createDataFrame([], f"{key} string, " + ", ".join(
                f"{f.name} {f.dataType.simpleString()}" for f in batch.schema.fields if f.name in cols
            ) + ", position bigint")
        merged = upsert(current, batch, key)
        merged.write.mode("overwrite").parquet(table_version_path(table_root, epoch + 1))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def latest_table(spark: SparkSession, table_root: str, below: int | None = None) -> DataFrame | None:
    """The newest complete table version (the commit protocol writes
    ``_SUCCESS`` last), of those below version number ``below`` if it is given."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(table_root)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return None
    versions = sorted(
        st.getPath().getName() for st in fs.listStatus(path)
        if st.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))
    )
    if below is not None:
        versions = [v for v in versions if int(v[1:]) < below]
    if not versions:
        return None
    return spark.read.parquet(f"{table_root.rstrip('/')}/{versions[-1]}")
