"""Operator 12 against a direct comparison of all windows, and its parts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditframe.llm import suffix_dedup as S


def brute(texts, least):
    """Per text (n_bytes, removed, spans, digest of what remains)."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if seen[t[i:i + least]] > 1:
                gone[i:i + least] = b"\x01" * least
        spans, i = [], 0
        while i < len(t):
            if gone[i]:
                j = i
                while j < len(t) and gone[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        rest = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def run(scratch, docs, **options):
    out = S.repeated_spans(scratch, docs, **options).collect()
    return sorted(((r["id"], (r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], r["kept_sha256"])) for r in out), key=str)


def check(spark, scratch, texts, least, **options):
    docs = spark.createDataFrame([(i, t, b"x", 7) for i, t in enumerate(texts)], "doc_id bigint, text string, digest binary, tid bigint")
    assert run(scratch, docs, least=least, **options) == sorted(enumerate(brute(texts, least)), key=str)


def planted(seed, n=60, least=40):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefghij é漢"

    def prose(k):
        return "".join(rng.choice(letters) for _ in range(k))

    passages = [prose(rng.choice([least - 9, least - 1, least, least + 1, 2 * least, 7 * least])) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [prose(rng.randrange(3 * least)) for _ in range(3)]
        for _ in range(rng.randrange(4)):
            parts.insert(rng.randrange(len(parts)), rng.choice(passages))
        texts.append("".join(parts))
    texts += texts[:5] + [texts[0] + "!", "?" + texts[1], None, "", "x" * least, "x" * (3 * least), "xy" * least + texts[2], "x" * (least - 1)]
    near = list(prose(500))
    for _ in range(20):
        near[rng.randrange(500)] = rng.choice(letters)
        texts.append("".join(near))
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_matches_all_windows(spark, scratch, seed):
    check(spark, scratch, planted(seed), 40, gram=12)


def test_keys_with_many_anchors_go_by_fingerprints(spark, scratch, monkeypatch):
    check(spark, scratch, planted(7), 40, gram=12, hot=5)
    check(spark, scratch, planted(8), 40, gram=12, hot=1)


def test_production_parameters(spark, scratch):
    rng = random.Random(9)

    def prose(k):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))

    shared = prose(399), prose(400), prose(1500)
    texts = [prose(300) + rng.choice(shared) + prose(700) for _ in range(40)] + ["-" * 5000, "-" * 399, "-" * 400, "ab" * 1000 + prose(50)]
    check(spark, scratch, texts, 400)


def test_awkward_tables(spark, scratch, awkward, nothing):
    rows = awkward.select("doc_id", "text").collect()
    expected = sorted(((r["doc_id"], b) for r, b in zip(rows, brute([r["text"] for r in rows], 400))), key=str)
    assert run(scratch, awkward) == expected
    assert run(scratch, nothing) == []


def test_long_texts_are_searched_in_slices(spark, scratch, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(600_000))
    passage = text[262_000:263_000]
    texts = [text, "begin " + passage + " end", text[5:400_000].upper()]
    check(spark, scratch, texts, 400)


def test_what_remains(spark, scratch, awkward):
    texts = planted(2)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, kept string")
    out = {r["doc_id"]: r for r in S.remove_repeats(scratch, docs, least=40, gram=12).collect()}
    for i, (t, b) in enumerate(zip(texts, brute(texts, 40), strict=True)):
        assert out[i]["text"] == t and out[i]["kept"] == "x"
        assert (out[i]["kept_"] is None) if t is None else hashlib.sha256(out[i]["kept_"]).hexdigest() == b[3]
    assert S.remove_repeats(scratch, awkward).count() == awkward.count()


def test_merging_shards_equals_sorting_all_rows():
    rng = random.Random(6)
    contexts = ["".join(rng.choice("ab") for _ in range(rng.randrange(3, 30))).encode() for _ in range(300)]
    keys = np.array([rng.choice([3, 3, 9, 2**63 + 5]) for _ in contexts], np.uint64)

    def rows(which):
        columns = {name: np.zeros(len(which), np.int64) for name, _ in S.Rows.FIELDS}
        return S.Rows({**columns, "key": keys[which], "tid": np.array(which), "left": np.array([len(contexts[i]) // 3 for i in which], np.int64)},
                      [contexts[i] for i in which], 32)

    parts = []
    for k in range(5):
        given = rows([i for i in range(300) if i % 5 == k])
        order, lcp = S.refine(given.symbols(), np.arange(given.n), np.zeros(given.n, np.int64), 32)
        parts.append((given.pick(order, lcp).tid.tolist(), lcp))
    merged = rows([i for ids, _ in parts for i in ids])
    order, lcp = S.refine(merged.symbols(), np.repeat(np.arange(5), 60), np.concatenate([p for _, p in parts]), 32)

    def suffix(i):
        return int(keys[i]).to_bytes(8, "big") + contexts[i][len(contexts[i]) // 3:].ljust(32, b"\0")

    got = merged.tid[order].tolist()
    assert [suffix(i) for i in got] == sorted(suffix(i) for i in range(300))
    for a, b, n in zip(got, got[1:], lcp[1:].tolist()):
        x, y = suffix(a), suffix(b)
        same = next((k for k in range(40) if x[k] != y[k]), 40)
        assert n == max(same - 8, 0)


def test_oracle(spark):
    import duckdb

    import __spark_entry__ as E

    con, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for name in ("documents",):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = con.execute(E.oracle_sql()["op12_suffix_dedup"])
    names = [c[0] for c in want.description]
    got = E.queries()["op12_suffix_dedup"](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(want.fetchall())
