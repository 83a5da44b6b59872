"""Importance resampling (5) and the pipeline."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from auditframe.llm import importance as I

SF = "/root/testdata/sf0.01"


def test_kth_largest(spark):
    values = [int(x) for x in np.random.default_rng(4).integers(-10**15, 10**15, 500)] + [7, 7, 7]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for k in (1, 2, 250, 502, 503):
        assert I.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_held_out_accuracy(spark, scratch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["id"]: r["kept"] for r in I.resample(scratch, docs, labels).collect()}
    sample = I.sample_labels(labels)
    assert len(got) == docs.count()
    held = [(got[int(i)], bool(g)) for i, g, h in zip(sample.ids, sample.good, sample.hold) if h and int(i) in got]
    clean, junk = [k for k, g in held if g], [k for k, g in held if not g]
    assert len(clean) > 50 and len(junk) > 5
    assert np.mean(clean) >= 0.97 and np.mean(junk) <= 0.2


def test_plain_version(spark, scratch):
    """The model, weights and cut by loops over strings of the same buckets."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model, scored = I.fit(scratch, docs, labels)
    sample, rows = I.sample_labels(labels), docs.select("doc_id", "text").collect()
    train = {int(i) for i, g, h in zip(sample.ids, sample.good, sample.hold) if g and not h}
    raw, target, grams = np.zeros(1 << I.BUCKET_BITS), np.zeros(1 << I.BUCKET_BITS), {}
    for r in rows:
        found = [b for _, b, _ in I._grams(pa.array([r["text"]]))]
        grams[r["doc_id"]] = np.concatenate(found) if found else np.zeros(0, int)
        np.add.at(raw, grams[r["doc_id"]], 1)
        if r["doc_id"] in train:
            np.add.at(target, grams[r["doc_id"]], 1)
    ratios = np.log((target + I.PRIOR) / (raw * target.sum() / raw.sum() + I.PRIOR))
    weights = {i: I.NORMAL_GRAMS * ratios[g].sum() / (len(g) + I.NEUTRAL_GRAMS) for i, g in grams.items()}
    got = {r["id"]: r for r in scored.collect()}
    assert all(abs(got[i]["log_weight"] - w) < 1e-6 for i, w in weights.items())
    assert model.k == sum(r["log_weight"] >= model.cut for r in got.values())
    assert sum(r["key"] >= model.least_key for r in got.values()) == model.k
    noise = np.array([r["key"] / I.KEY_UNITS - r["log_weight"] for r in got.values()])
    assert abs(noise.mean() - 0.5772) < 0.15 and abs(noise.std() - 1.2825) < 0.15


def test_resample_awkward(spark, scratch, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, 0), (10, 0, 0), (13, 0, 0), (None, 1, 0), (4, None, 0), (1, 1, 0), (99, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    assert I.resample(scratch, awkward, labels).count() == awkward.count()
    kept = I.keep_resampled(scratch, awkward, labels)
    assert kept.columns == awkward.columns and kept.count() <= awkward.count()
    assert I.keep_resampled(scratch, awkward, labels.limit(0)).count() == awkward.count()
    assert I.resample(scratch, nothing, labels).collect() == [] and I.keep_resampled(scratch, nothing, labels).collect() == []


def test_gumbel_draws_by_weight():
    """Of two weights the larger is first with its softmax probability."""
    h = np.random.default_rng(0).integers(-2**63, 2**63 - 1, (2, 200_000))
    a, b = I._keys(np.full(200_000, 1.0), h[0]), I._keys(np.zeros(200_000), h[1])
    assert abs((a > b).mean() - 1 / (1 + np.exp(-1))) < 0.01


def test_pipeline_against_brute_force(spark):
    from test_dedup import LOWER, components
    from test_tokens import check_packing

    from auditframe.llm.common import Scratch

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scratch = Scratch(spark, "test")
    kept = {r["id"] for r in I.resample(scratch, docs, labels).where("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept]
    last = {}
    for i, t in rows:
        last[(t or "").translate(LOWER)] = max(i, last.get((t or "").translate(LOWER), i))
    rows = [(i, t) for i, t in rows if last[(t or "").translate(LOWER)] == i]
    left = {i for i, _, c in components(rows, 5, 80) if i == c}
    got = E.queries()["pipeline"](spark, SF).collect()
    assert {r["doc_id"] for r in got} == left
    check_packing(got, [(i, t) for i, t in rows if i in left], 2048)


def test_stages_on_awkward_tables(spark, awkward, nothing):
    extra = awkward.selectExpr("doc_id", "text", "'en' lang", "'s' source", "0L n_chars", "1 id", "2 _keep_id")
    for _, stage in P.STAGES:
        for docs in (extra, extra.limit(0)):
            out = stage(spark, docs, SF)
            if stage is not P.packing:
                assert out.columns == list(P.COLUMNS)
            assert (out.count() == 0) == (docs.count() == 0)


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["quality", "exact", "near", "packing"] and P.ORACLE_SQL is None


#: Names that the stages' operators use themselves, and names that differ in case only.
TAKEN = ("_id", "_digest", "_text_digest", "_listed", "_set", "_node", "_key", "_hash", "_least", "_id_hash", "id", "digest", "node", "row", "h", "c0",
         "c1", "keep_id", "kept", "w", "bucket", "component", "first_id", "text_")


def test_stages_keep_columns_of_any_name(spark, scratch, awkward):
    from auditframe.llm.exact_dedup import keep_one_per_text
    from auditframe.llm.importance import keep_resampled
    from auditframe.llm.minhash import keep_one_per_group

    docs = awkward.select("doc_id", "text", *[F.lit(i).alias(name) for i, name in enumerate(TAKEN)])
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (8, 0, 0), (13, 0, 1)], "doc_id bigint, quality int, toxic int")
    plain = docs.select("doc_id", "text")
    for stage in (keep_one_per_text, keep_one_per_group, lambda s, d: keep_resampled(s, d, labels)):
        out = stage(scratch, docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert all([r[n] for n in TAKEN] == list(range(len(TAKEN))) for r in rows)
        assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(map(tuple, stage(scratch, plain).collect()))
