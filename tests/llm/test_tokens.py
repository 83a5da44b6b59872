"""Chunked BPE (6), addressable codes (8), packing (9) against the libraries and brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as E
from auditframe.llm import bpe, dac, packing
from auditframe.llm.bpe_chunks import encode_decode

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ODD = st.text(alphabet=st.one_of(st.sampled_from(list(" \t\n\r\x0b\x1c\x1d\x85\xa0 　᠎'strevmd.!<|>aAbB12é́漢\U0001f600İΣ")),
                                 st.characters(exclude_categories=["Cs", "Cn"])), max_size=60)


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("path, encoder", [(WORDS, bpe.word_end_encoder), (BYTES, bpe.byte_level_encoder)])
def test_pieces_equal_the_library(path, encoder):
    t, e = library(path), encoder(path)

    @settings(max_examples=400, deadline=None)
    @given(ODD)
    def check(text):
        assert np.frombuffer(next(e.ids([text])), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids

    check()


@pytest.mark.parametrize("path, encoder", [(WORDS, bpe.word_end_encoder), (BYTES, bpe.byte_level_encoder)])
def test_letters_before_marks_equal_the_library(path, encoder):
    """U+0130 in lower case ends in a combining dot, which joins the marks behind it."""
    t, e = library(path), encoder(path)
    letters = [chr(i) for i in range(0x250) if chr(i).isalpha()]
    texts = ["GAZETES\u0130,", "a\u0130.", "\u0130! x\u0130y. \u0130\u0130?!", *(f"a{c}{m} {c}{m}b" for c in letters for m in ".,;:!?")]
    for text, ids in zip(texts, e.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("path, encoder, ids", [(WORDS, bpe.word_end_encoder, [320, 321, 49407, 322]),
                                                (BYTES, bpe.byte_level_encoder, [64, 275, 220, 50256, 269])])
def test_special_tokens_equal_the_unmodified_library(path, encoder, ids):
    t, e = Tokenizer.from_file(path), encoder(path)
    rng = np.random.default_rng(3)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "<|ENDOFTEXT|>", " ", "\n", "\x01", "a", "b.", "\u0130", "\u0301", "<", "|>", "'s"]
    texts = ["a b <|endoftext|> c", "<|endoftext|>", "a<|endoftext|><|endoftext|>\x01 \n", *("".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(2000))]
    got = [np.frombuffer(x, "<u4").tolist() for x in e.ids(texts)]
    assert got[0] == ids
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("path, encoder", [(WORDS, bpe.word_end_encoder), (BYTES, bpe.byte_level_encoder)])
def test_every_character_equals_the_unmodified_library(path, encoder):
    """Plain and other words side by side, one and more white characters, and the
    characters whose lower case depends on what follows or grows."""
    t, e = Tokenizer.from_file(path), encoder(path)
    chars = [chr(i) for i in [*range(0x2500), *range(0x2C00, 0x2E80), *range(0xA640, 0xAB70), *range(0xFB00, 0xFFFE), *range(0x1D400, 0x1D800, 3)] if not 0xD800 <= i < 0xE000]
    texts = [f"a{c} {c}1{c}.{c}{c} B{c}\u0301 x" for c in chars]
    texts += ["\u039f\u03a3 \u039f\u03a3. \u03a3\u0399\u0393\u039c\u0391\u03a3\u03a3", "I\u0130i \u0130.", "a  b\n\nc \n d\t\te", "it's  'S 'll'Ve '", " \n", "\x1c \x1da\x1e", "\u00c5\u212b A\u030a"]
    for text, ids in zip(texts, e.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, ascii(text)


@pytest.mark.parametrize("path, encoder", [(WORDS, bpe.word_end_encoder), (BYTES, bpe.byte_level_encoder)])
def test_random_mixtures_equal_the_unmodified_library(path, encoder):
    rng = np.random.default_rng(8)
    alphabet = list("abcdé \n\x01.漢Σİ'\u0301s") + ["\u0181", "<|endoftext|>", "  ", "ẞ"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 120))) for _ in range(3000)] + [None, ""]
    t, e = Tokenizer.from_file(path), encoder(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in e.ids(texts)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("path, encoder", [(WORDS, bpe.word_end_encoder), (BYTES, bpe.byte_level_encoder)])
def test_long_runs(path, encoder):
    t, e = Tokenizer.from_file(path), encoder(path)
    texts = [c * 300_000 for c in ("a", " ", "\n", "1", "!", "é", "ab ", "\n ")]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.ids(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_ranks_equal_the_library():
    t, e = reference(), bpe.rank_encoder(RANKS, P.PATTERN)

    @settings(max_examples=400, deadline=None)
    @given(ODD)
    def check(text):
        assert np.frombuffer(e(text), "<u4").tolist() == t.encode_ordinary(text)

    check()


def digests(rows):
    e, out = reference(), Counter()
    for i, text in rows:
        ids = np.array(e.encode_ordinary(text or ""), "<u4").tobytes()
        out[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in df.select(df.columns[0], "n_tokens", "ids_sha256", "decoded_sha256").collect())


def test_chunks_awkward(scratch, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for size, overlap in ((32768, 2048), (500, 60)):
        got = encode_decode(scratch, awkward, RANKS, P.PATTERN, chunk_chars=size, overlap_chars=overlap)
        assert found(got) == digests(rows)
    assert encode_decode(scratch, nothing, RANKS, P.PATTERN).collect() == []


def test_chunks_random(spark, scratch):
    rng = np.random.default_rng(1)
    alphabet = list("aB1 \n\t\r'sé漢!\x1c\xa0́ ")
    rows = [(i, "".join(rng.choice(alphabet, rng.integers(0, 600)))) for i in range(150)]
    rows += [(300, "a" * 3000), (301, " " * 3000 + "x"), (302, "don't" * 500), (303, None), (302, "don't" * 500), (304, "\n " * 999 + "!" * 777)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(encode_decode(scratch, df, RANKS, P.PATTERN, chunk_chars=100, overlap_chars=20)) == digests(rows)


def test_chunks_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(E.queries()["op6_chunked_bpe"](spark, SF)) == digests(rows)


@pytest.mark.parametrize("limit", [200, 2**16, 2**32])
def test_dac_round_trip(limit):
    rng = np.random.default_rng(limit % 97)
    docs = [(i, rng.integers(0, limit, n).astype("<u4")) for i, n in enumerate((0, 1, 7, 600, 5000))] + [(None, np.array([0], "<u4"))]
    segment = dac.Segment(dac.pack_segment([(i, a.tobytes()) for i, a in docs]))
    flat = np.concatenate([a for _, a in docs])
    for k, (i, a) in enumerate(docs):
        assert (segment.document(k) == a).all() and bool(segment.known[k]) == (i is not None)
    for i in rng.integers(0, len(flat), 300).tolist():
        assert segment.access(i) == flat[i]
    with pytest.raises(ValueError):
        dac.Segment(b"NOPE" + bytes(20))


def codes(rows):
    t, start, out = library(WORDS), 0, Counter()
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out[i, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    return out


def test_codes_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = E.queries()["op8_addressable_codes"](spark, SF)
    assert Counter(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == codes(rows)


def test_codes_awkward(scratch, awkward, nothing):
    segments = dac.write_segments(scratch, awkward, WORDS, segment_ids=50)
    got = dac.read_segments(segments).collect()
    ends, position = {r["start"] + r["n_tokens"] for r in got}, 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == position
        position += r["n_tokens"]
    assert len(ends) == awkward.count()
    ids = [r["id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    t = library(WORDS)
    want = Counter((r["doc_id"], zlib.crc32(np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in awkward.collect())
    assert Counter((r["id"], r["ids_crc32"]) for r in got) == want
    assert dac.read_segments(dac.write_segments(scratch, nothing, WORDS)).collect() == []


def plain_best_fit(lengths, capacity):
    """One bin per step, tightest first: the remaining capacities of the bins."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(bins) if r >= n]
        if fits:
            r, i = min(fits)
            bins[i] = r - n
        else:
            bins.append(capacity - n)
    return bins


def test_best_fit_equals_the_plain_version():
    rng = np.random.default_rng(9)
    for capacity in (10, 64, 100):
        for _ in range(30):
            lengths = rng.integers(1, capacity + 1, rng.integers(1, 200)).tolist()
            used = Counter()
            for length, first, per, sequence, offset in packing.best_fit_decreasing(Counter(lengths), capacity):
                assert offset + per * length <= capacity
            counts, total = Counter(lengths), Counter()
            records = sorted(packing.best_fit_decreasing(counts, capacity))
            for k, (length, first, per, sequence, offset) in enumerate(records):
                last = records[k + 1][1] if k + 1 < len(records) and records[k + 1][0] == length else counts[length]
                for j in range(last - first):
                    used[sequence + j // per] += length
                total[length] += last - first
            assert total == counts
            assert Counter(capacity - v for v in used.values()) == Counter(plain_best_fit(lengths, capacity))


def check_packing(got, rows, capacity):
    t, pieces = library(BYTES), Counter()
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        sizes = ([len(ids) % capacity] if len(ids) % capacity else []) + [capacity] * (len(ids) // capacity)
        for p, n in enumerate(sizes):
            pieces[i, p, at, n, zlib.crc32(ids[at:at + n].tobytes())] += 1
            at += n
    assert Counter(tuple(r)[:5] for r in got) == pieces
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = [n for (_, _, _, n, _), times in pieces.items() for _ in range(times)]
    assert len(by) == len(plain_best_fit(lengths, capacity))


def test_packing_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = E.queries()["op9_best_fit_packing"](spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    check_packing(got, rows, 2048)


def test_packing_awkward(scratch, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    check_packing(packing.pack(scratch, awkward, BYTES, capacity=256).collect(), rows, 256)
    assert packing.pack(scratch, nothing, BYTES).collect() == []
