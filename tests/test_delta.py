"""The delta store against a dictionary."""

import os
import random
import tempfile

import pytest

from auditframe.streaming.delta import DeltaStore, upsert_stream_into

SCHEMA = "sample_id string, comment string"


def _store(spark, buckets=8):
    return DeltaStore(spark, os.path.join(tempfile.mkdtemp(prefix="af-delta-"), "t"), SCHEMA, buckets=buckets)


def _rows(df):
    return sorted((r["position"], r["sample_id"], r["comment"]) for r in df.collect())


def test_batches_compaction_and_vacuum(spark):
    store, rng, held, place = _store(spark), random.Random(2), {}, {}
    assert _rows(store.read()) == []
    for batch in range(5):
        rows = [(f"s{rng.randrange(30)}", f"c{batch}_{i}", i) for i in range(12)]
        store.upsert(spark.createDataFrame(rows, SCHEMA + ", version int"))
        last = {k: (v, i) for k, v, i in rows}
        for k, (v, _) in sorted(last.items(), key=lambda x: (x[1][1], x[0])):
            held[k] = v
            place.setdefault(k, len(place) + 1)
    want = sorted((place[k], k, v) for k, v in held.items())
    assert _rows(store.read()) == want
    before = store.manifest()
    store.compact(fold_after=2)
    assert _rows(store.read()) == want and store.manifest()["parts"][0]["folder"].startswith("base-")
    assert len(store.manifest()["parts"]) <= len(before["parts"]) + 1
    store.upsert(spark.createDataFrame([("s1", "again", 1), ("new", "n", 2)], SCHEMA + ", version int"))
    want = sorted({(p, k, "again" if k == "s1" else v) for p, k, v in want} | {(place.get("s1", len(place) + 1), "s1", "again"), (len(place) + 1 + ("s1" not in place), "new", "n")})
    assert _rows(store.read()) == want
    store.compact(fold_after=0)
    store.vacuum(keep=1)
    assert _rows(store.read()) == want and len(store.versions()) == 1
    assert [n for n in os.listdir(store.root) if n.startswith("delta-")] == []


def test_a_delta_touches_its_buckets_only(spark):
    store = _store(spark, buckets=64)
    store.upsert(spark.createDataFrame([(f"k{i}", "x", 1) for i in range(200)], SCHEMA + ", version int"))
    store.upsert(spark.createDataFrame([("k3", "y", 1)], SCHEMA + ", version int"))
    assert [len(p["buckets"]) for p in store.manifest()["parts"]] == [64 if len(store.manifest()["parts"][0]["buckets"]) == 64 else len(store.manifest()["parts"][0]["buckets"]), 1]
    assert store.read().where("comment = 'y'").count() == 1 and store.read(version=1).where("comment = 'y'").count() == 0


def test_replayed_epoch_is_the_same_version(spark):
    store = _store(spark)
    batches = [spark.createDataFrame([("a", f"x{e}", 1), (f"n{e}", "y", 2)], SCHEMA + ", version int") for e in range(3)]
    for e, b in enumerate(batches):
        store.upsert(b, epoch=e)
    want = _rows(store.read())
    assert store.upsert(batches[2], epoch=2) == 3
    assert _rows(store.read()) == want == [(1, "a", "x2"), (2, "n0", "y"), (3, "n1", "y"), (4, "n2", "y")]


def test_stream(spark):
    store = _store(spark)
    root = tempfile.mkdtemp(prefix="af-delta-")
    updates, checkpoint = os.path.join(root, "u"), os.path.join(root, "c")
    spark.createDataFrame([("one", "first"), ("two", "b"), ("one", "last")], SCHEMA).coalesce(1).write.parquet(os.path.join(updates, "b1"))
    upsert_stream_into(store, os.path.join(updates, "*"), checkpoint).awaitTermination(120)
    spark.createDataFrame([("two", "c"), ("three", "d")], SCHEMA).coalesce(1).write.parquet(os.path.join(updates, "b2"))
    upsert_stream_into(store, os.path.join(updates, "*"), checkpoint).awaitTermination(120)
    got = {r["sample_id"]: (r["position"], r["comment"]) for r in store.read().collect()}
    assert got == {"one": (2, "last"), "two": (1, "c"), "three": (3, "d")}


def test_reserved_columns(spark):
    with pytest.raises(ValueError):
        DeltaStore(spark, "/tmp/x", "sample_id string, position bigint")
