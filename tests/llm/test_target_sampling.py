"""Operator 13 against a direct computation, and its parts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from auditframe.llm import target_sampling as T

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return _WORD.findall((text or "").translate(_LOWER))


def features(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target):
    """docs: (doc_id, text); rows (doc_id, n_features, weight, score, rank)."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    s_all, t_all = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((float(t[b] + 1) * float(s_all + 10000)) / (float(s[b] + 1) * float(t_all + 10000))))

    rows = []
    for i, text in docs:
        f = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    eligible = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for rank, r in enumerate(eligible[:5 * len(eligible) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def run(spark, scratch, docs, target):
    from pyspark.sql import functions as F

    out = T.target_resample(scratch, docs, target).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
    return sorted(map(tuple, out.collect()), key=str)


@pytest.fixture
def target(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "Theta iota, kappa lambda!", None, "", "12 13 14 alpha beta"]
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "item_id bigint, text string, score bigint"), texts


def test_matches_a_direct_computation(spark, scratch, awkward, target):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert run(spark, scratch, awkward, target[0]) == brute(docs, target[1])


def test_draws_with_ties_and_repeated_rows(spark, scratch, target):
    rng = random.Random(5)
    vocabulary = "alpha beta gamma delta été 漢字 x1 Y2 zeta eta theta iota".split()
    rows = [(i // 2, " ".join(rng.choices(vocabulary, k=rng.choice([3, 19, 20, 40, 300])))) for i in range(400)]
    rows += [(9000, rows[0][1])] * 3
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id bigint, text string, score bigint, rank bigint")
    expected = brute(rows, target[1])
    assert run(spark, scratch, docs, target[0]) == expected
    assert sum(r[4] is not None for r in expected) > 5


def test_no_target_and_no_documents(spark, scratch, awkward, nothing, target):
    assert run(spark, scratch, nothing, target[0]) == []
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert run(spark, scratch, awkward, target[0].limit(0)) == brute(docs, [])


def test_blocks_of_a_long_text_give_each_feature_once(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["a", "bb", "été", "x" * 90, "7" * 300, ";"]) for _ in range(500))
    for size in (1, 5, 64, 1 << 20):
        monkeypatch.setattr(T, "GROUP_BYTES", size)
        got, n = Counter(), 0
        for bucket, row, word_row in T.text_features(pa.array([None, text, "", "one two"])):
            got.update(zip(row.tolist(), bucket.tolist(), strict=True))
            n += (word_row == 1).sum()
        assert got == Counter((1, b) for b in features(text)) + Counter((3, b) for b in features("one two"))
        assert n == len(words(text))


def test_crc_shift():
    rng = random.Random(2)
    parts = [(rng.randbytes(rng.randrange(50)), rng.randbytes(n)) for n in [0, 1, 5, 63, 64, 65, 4096, 70_000, 1 << 20]]
    a = np.array([zlib.crc32(x) for x, _ in parts], np.uint32)
    b = np.array([zlib.crc32(y) for _, y in parts], np.uint32)
    joined = T.shift_crc(a, np.array([len(y) for _, y in parts])) ^ b
    assert joined.tolist() == [zlib.crc32(x + y) for x, y in parts]


def test_plane_sums_are_exact():
    rng = np.random.default_rng(3)
    gains = rng.integers(-20_000, 20_000, T.BUCKETS)
    gains[:3] = [-(1 << 15), (1 << 15) - 1, 0]
    counts = rng.integers(0, 4, (5, T.BUCKETS))
    counts[1] = 0
    counts[2, :7] = 10**6
    assert T.plane_weights(counts, T.gain_planes(gains)).tolist() == (counts @ gains).tolist()


def test_oracle(spark):
    import duckdb

    import __spark_entry__ as E

    con, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = con.execute(E.oracle_sql()["op13_target_resampling"])
    names = [c[0] for c in want.description]
    got = E.queries()["op13_target_resampling"](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(want.fetchall())
