"""Operator 11 against a direct computation on the full grid."""

import re
from collections import Counter

import pytest

from auditframe.llm import divergence

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=3, ranks=200):
    rows = [((lang or ""), (source or ""), _TERM.findall((text or "").translate(_LOWER))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        seen = Counter(t for r in mine for t in set(r[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)

        def shares(terms):
            n = Counter(t for t in terms if seen[t] >= least)
            total = sum(n.values())
            return n, {t: 1 + 10**9 * (n[t] + 1) // (total + len(kept)) for t in kept}

        whole = shares([t for r in mine for t in r[2]])[1]
        groups = {s: shares([t for r in mine if r[1] == s for t in r[2]]) for s in {r[1] for r in mine}}
        for s, (n, p) in groups.items():
            pairs = [(o, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for o, (_, q) in groups.items() if o != s]
            terms = [(t, (p[t] - whole[t]) ** 2 // whole[t]) for t in kept if n[t] and p[t] > whole[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, ranks)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ordered)]
    return sorted(out)


def run(spark, scratch, rows, **options):
    schema = "lang string, source string, text string, term string, n bigint, item string, rank int"
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], schema)
    return sorted(map(tuple, divergence.audit(scratch, docs, **options).collect()))


ROWS = [
    ("en", "a", "The cat, the CAT and the dog"), ("en", "a", "the cat sat"), ("en", "b", "a dog; the dog! cat's dog"), ("en", "b", "the the the"),
    ("en", "c", "1234 !!"), ("en", "d", None), ("en", None, "the cat and dog"), (None, None, "the"), ("", "", "the"), (None, "z", "the end"),
    ("fr", "a", "Été été ÉTÉ là"), ("fr", "b", "été là l'été"), ("fr", "b", "été là l'été"), ("fr", "b", "ETE \U0001f600x là"), ("de", "q", ""),
    ("en", "a", "a" * 3000 + " the"), ("en", "e", "a" * 3000), ("en", "e", "A" * 3000 + "\x00the"),
]


def test_matches_the_full_grid(spark, scratch):
    assert run(spark, scratch, ROWS) == brute(ROWS)


def test_all_terms_and_few_ranks(spark, scratch):
    assert run(spark, scratch, ROWS, least_documents=1, term_ranks=2) == brute(ROWS, 1, 2)


def test_blocks_and_flushes_do_not_change_counts(spark, scratch, monkeypatch):
    text = "Alpha beta-gamma " * 50
    assert divergence.term_counts(text.encode()) == Counter({b"alpha": 50, b"beta": 50, b"gamma": 50})
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 7)
    assert divergence.term_counts(text.encode()) == Counter({b"alpha": 50, b"beta": 50, b"gamma": 50})


def test_empty_table(spark, scratch):
    assert run(spark, scratch, []) == []


@pytest.mark.parametrize("n, total, terms", [(0, 0, 1), (6, 13, 3), (10**13, 3 * 10**13, 10**7)])
def test_share_is_exact(spark, n, total, terms):
    from pyspark.sql import functions as F

    row = spark.range(1).select(divergence._share(*(F.lit(x).cast("bigint") for x in (n, total, terms)))).first()
    assert row[0] == 1 + 10**9 * (n + 1) // (total + terms)
