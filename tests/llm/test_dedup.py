"""Exact dedup (4) and MinHash near-dedup (10) against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from auditframe.llm import exact_dedup as X
from auditframe.llm import minhash as M
from auditframe.llm.textscan import shingle_set, text_slices, word_hashes

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    k = min(k, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()


def components(rows, k, percent):
    """Brute force over (id, text) rows: per row (number of shingles, component)."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        known = [x for x in least[root(i)] if x is not None]
        out.append((doc, len(sets[i]), min(known) if known and sets[i] else doc))
    return out


def near(scratch, df, **options):
    got = M.near_duplicates(scratch, df, **options).collect()
    for r in got:
        assert r["kept"] == (r["id"] == r["component_id"])
    return Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got)


@pytest.mark.parametrize("k", [2, 5])
def test_near_awkward(scratch, awkward, k):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert near(scratch, awkward, shingle_words=k) == Counter(components(rows, k, 80))


def test_near_empty(scratch, nothing):
    assert M.near_duplicates(scratch, nothing).collect() == []
    assert M.keep_one_per_group(scratch, nothing).collect() == []


def test_near_family_in_rounds(spark, scratch):
    """A family whose members are linked in chains, with far members, and texts
    that share a passage but are not linked."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = list(rng.choice(vocabulary, 120))
    rows = []
    for i in range(160):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 14), replace=False):
            words[at] = str(rng.choice(vocabulary))
        rows.append((i, " ".join(words)))
    for i in range(40):
        rows.append((1000 + i, " ".join(base[:60] + list(rng.choice(vocabulary, 60)))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = components(rows, 2, 80)
    assert len({c for _, _, c in want}) > 45
    assert near(scratch, df, shingle_words=2) == Counter(want)


def test_near_whole_table(spark, scratch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = E.queries()["op10_minhash_near_dedup"](spark, SF).collect()
    want = components([(r["doc_id"], r["text"]) for r in df.collect()], 2, 80)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(want)


def test_keep_one_row_per_group(spark, scratch):
    """Ids that are repeated or null do not keep near copies; blank texts all stay."""
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcdefg"]
    a, b, c, d, e, f, g = texts
    rows = [
        (1, a), (2, b + " x"), (2, a + " y"),  # 2 names the group of b, its other text is a copy of 1
        (None, c), (None, c + " x"), (None, c.upper()),  # a group without ids
        (None, d), (3, d + " x"),  # the null id does not name a group that has an id
        (4, e), (4, e + " x"), (4, e.upper()), (5, f), (5, f),  # 5: one document, listed twice
        (2, ""), (2, " "), (None, None), (None, "\t"), (6, g), (None, g),
    ]
    got = [tuple(r) for r in M.keep_one_per_group(scratch, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    named = [(i, (t or "")[:1]) for i, t in got if (t or "").strip()]
    assert Counter((i, t.lower()) for i, t in named) == Counter([(1, "a"), (2, "b"), (None, "c"), (3, "d"), (4, "e"), (5, "f"), (5, "f"), (6, "g")])
    assert Counter((i, t) for i, t in got if not (t or "").strip()) == Counter([(2, ""), (2, " "), (None, None), (None, "\t")])


def test_keep_one_per_group(scratch, awkward):
    kept = M.keep_one_per_group(scratch, awkward, shingle_words=5)
    assert kept.columns == awkward.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and not ids[2] and not ids[3] and not ids[4] and ids[14] == 2 and ids[16] == 1
    assert all(ids[i] == 1 for i in (5, 6, 7, 8, 10, 12, 13, 15)) and ids[9] == 0


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[:720], rng.integers(0, 2**63, 180).astype(np.uint64)]))
    same = (M.signature(a) == M.signature(b)).mean()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(same - true) < 0.1


def test_word_scan_matches_pattern():
    import pyarrow as pa

    texts = ["A bc\td", None, "", "  x ", "É \xa0y\x0bz", "a" * 300_000 + " b", "end"]
    rows = []
    for _, raw, offs in text_slices(pa.array(texts)):
        h, at = word_hashes(raw, offs)
        rows += [h[at[i]:at[i + 1]] for i in range(len(offs) - 1)]
    seen = {}
    for text, hashes in zip(texts, rows, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(shingle_set(rows[0], 5)) == 1 and len(shingle_set(rows[2], 2)) == 0


def exact_want(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(LOWER)].append(doc)
    out = []
    for doc, text in rows:
        t = (text or "").translate(LOWER)
        known = [x for x in groups[t] if x is not None]
        keep = max(known) if known else None
        out.append((doc, keep, len(groups[t]), doc == keep, hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out)


def test_exact_awkward(scratch, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = X.exact_duplicates(scratch, awkward).collect()
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["kept"], r["digest"]) for r in got) == exact_want(rows)
    assert {r["member"] for r in got} == {True, False}
    assert X.exact_duplicates(scratch, nothing).collect() == []
    assert X.keep_one_per_text(scratch, nothing).collect() == []


def test_exact_oracle(spark):
    got = E.queries()["op4_exact_dedup"](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(E.oracle_sql()["op4_exact_dedup"])
    names = [c[0] for c in want.description]
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(want.fetchall())


def test_exact_with_history(spark, scratch):
    known = spark.createDataFrame([("seen before",), ("never again",)], "t string").select(
        X.text_digest(X.F.col("t")).alias("digest"), X.F.lit(900).cast("bigint").alias("keep_id"), X.F.lit(3).cast("bigint").alias("group_size"))
    docs = spark.createDataFrame([(1, "Seen Before"), (2, "new"), (3, "NEW"), (4, "alone")], "doc_id bigint, text string")
    got = {r["id"]: (r["keep_id"], r["kept"], r["member"]) for r in X.exact_duplicates(scratch, docs, history=known).collect()}
    assert got == {1: (900, False, True), 2: (3, False, False), 3: (3, True, False), 4: (4, True, False)}


def test_keep_one_per_text(scratch, awkward):
    kept = X.keep_one_per_text(scratch, awkward)
    assert kept.columns == awkward.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[3] == 1 and not ids[1] and not ids[2] and ids[6] == 1 and not ids[5] and ids[14] == 1 and ids[None] == 1


def test_minimal_perfect_hash(spark, scratch):
    entries = spark.range(3000).select(X.F.sha2(X.F.col("id").cast("string"), 256).alias("digest"), X.F.col("id").alias("keep_id"), X.F.lit(1).cast("bigint").alias("group_size"))
    index = X.DigestIndex(scratch, entries)
    slots = defaultdict(list)
    for r in index.slots.collect():
        slots[r["bucket"]].append(r["slot"])
    sizes = {r["bucket"]: r["n"] for r in index.functions.collect()}
    assert all(sorted(s) == list(range(sizes[b])) for b, s in slots.items()) and sum(sizes.values()) == 3000
    strangers = spark.range(5000, 6000).select(X.F.sha2(X.F.col("id").cast("string"), 256).alias("digest"))
    assert index.lookup(strangers).where("member").count() == 0
    assert index.lookup(entries.select("digest")).where("member").count() == 3000
