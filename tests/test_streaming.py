"""Streaming upsert of result rows (incremental S8)."""

import os
import tempfile

from auditframe.streaming.upsert import latest_table, upsert_stream


def test_stream_upsert(spark):
    root = tempfile.mkdtemp(prefix="af-stream-")
    upd = os.path.join(root, "updates")
    table = os.path.join(root, "table")
    ckpt = os.path.join(root, "ckpt")
    spark.createDataFrame([("one", "new comment"), ("three", "c")], "sample_id string, comment string") \
        .write.parquet(os.path.join(upd, "batch1"))
    initial = spark.createDataFrame([("one", "a", 1), ("two", "b", 2)], "sample_id string, comment string, position bigint")
    q = upsert_stream(spark, os.path.join(upd, "*"), "sample_id string, comment string", table, ckpt, initial=initial)
    q.awaitTermination(120)
    got = sorted((r["position"], r["sample_id"], r["comment"]) for r in latest_table(spark, table).collect())
    assert got == [(1, "one", "new comment"), (2, "two", "b"), (3, "three", "c")]


def test_replayed_batch_and_repeated_keys(spark):
    import shutil

    from auditframe.streaming.upsert import table_version_path

    root = tempfile.mkdtemp(prefix="af-stream-")
    upd, table, ckpt = (os.path.join(root, x) for x in ("updates", "table", "ckpt"))
    schema = "sample_id string, comment string"
    spark.createDataFrame([("one", "first"), ("two", "b"), ("one", "last")], schema).coalesce(1).write.parquet(os.path.join(upd, "batch1"))
    initial = spark.createDataFrame([("one", "a", 1)], schema + ", position bigint")
    upsert_stream(spark, os.path.join(upd, "*"), schema, table, ckpt, initial=initial).awaitTermination(120)
    want = [(1, "one", "last"), (2, "two", "b")]
    assert sorted((r["position"], r["sample_id"], r["comment"]) for r in latest_table(spark, table).collect()) == want
    # the batch is replayed after its table was written but before it was committed
    os.remove(os.path.join(ckpt, "commits", "0"))
    shutil.rmtree(os.path.join(ckpt, "commits"), ignore_errors=True)
    upsert_stream(spark, os.path.join(upd, "*"), schema, table, ckpt).awaitTermination(120)
    assert os.path.exists(table_version_path(table, 1))
    assert sorted((r["position"], r["sample_id"], r["comment"]) for r in latest_table(spark, table).collect()) == want
