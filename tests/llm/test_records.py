"""Chat formatting (1), WARC store (2), sharding (3), vectors (7)."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from auditframe.llm import chat_format as C
from auditframe.llm import slot_sharding as S
from auditframe.llm import vector_dedup as V
from auditframe.llm import warc_store as W

SF = "/root/testdata/sf0.001"
MARKS = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<|nl|>", "<|\\im_end|>", "<|", "|>", "\\", "im_end", "\n", "assistant", "a", " ", "\r", "漢"]), max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(MARKS, MARKS), max_size=4))
def test_round_trip(turns):
    parts = [C.render_turn(*t)[0] for t in turns]
    assert [t[:2] for t in C.parse("".join(parts))] == turns
    for part, (_, text) in zip(parts, turns):
        ((_, _, a, b),) = C.parse(part)
        assert part.count(C.START) == 1 and part.count(C.END) == 1 and C._unescape(part[a:b]) == text


def chats_want(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        talks[conv].append((role or "", text or ""))
    out = {}
    for conv, turns in talks.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


FIELDS = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def test_chats_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    trap = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", trap), (-1, 1, "assistant", trap)]
    got = E.queries()["op1_chat_format"](spark, SF).collect()
    assert {r["conv_id"]: tuple(r[c] for c in FIELDS) for r in got} == chats_want(rows)


def test_chats_awkward(spark, scratch):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", "early"), (2, 0, "role\nwith break", "t"), (None, 0, "assistant", "no id"),
            (3, 0, "assistant", "y" * 300_000), (3, 1, "assistant", ""), (4, 0, "user", "same"), (4, 0, "user", "same")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, rendered string")
    rendered, back = C.format_chats(scratch, df)
    assert {r["conv_id"]: tuple(r[c] for c in FIELDS) for r in back.collect()} == chats_want(rows)
    total = {r["conv_id"]: r["n"] for r in rendered.groupBy("conv_id").agg(F.sum(F.length("rendered")).alias("n")).collect()}
    assert total == {r["conv_id"]: r["formatted_chars"] for r in back.collect()}
    assert C.format_chats(scratch, df.limit(0))[1].collect() == []


def test_warc_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(E.oracle_sql()["op2_warc_archive"])
    names = [c[0] for c in want.description]
    got = E.queries()["op2_warc_archive"](spark, SF).collect()
    assert Counter(tuple(r[c] for c in names) for r in got) == Counter(want.fetchall())


PAGES = "page_id bigint, url string, html string, digest string, packed string, header string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "p", "h") for r in rows], PAGES)


def test_warc_awkward(spark, scratch, tmp_path):
    big, small = "<html>" + "é\r\n\r\nWARC/1.1\r\n" * 50, "tiny"
    rows = [(5, "http://a", big), (3, None, big), (9, "http://a\r\nX: y", big), (1, "u", small), (2, "u", small), (7, "u", None), (8, "u", ""),
            (None, "u", big), (3, "again", big), (10, "u", "z" * 400_000)]
    archive = W.write_archive(scratch, pages(spark, rows))
    assert archive.payloads.count() == 4
    records = W.read_records(archive)
    got = Counter(tuple(r) for r in W.describe_records(records).collect())
    want = Counter()
    for page, _, html in rows:
        body = (html or "").encode()
        revisit = len(body) >= 100 and html == big and page != 3
        want[page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None] += 1
    assert got == want
    raw = [bytes(r["record"]) for r in records.collect()]
    assert all(W.parse_record(r)[0][b"content-length"] for r in raw)
    out = str(tmp_path / "warc")
    W.export_warc(records.coalesce(1), out)
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "warc").glob("part-*")))
    assert len(text) == sum(map(len, raw)) and all(r in text for r in raw)
    assert W.describe_records(W.read_records(W.write_archive(scratch, pages(spark, [])))).collect() == []


def test_warc_finds_damage(spark, scratch):
    archive = W.write_archive(scratch, pages(spark, [(1, "u", "payload")]))
    other = W.write_archive(scratch, pages(spark, [(1, "u", "another")])).payloads.select("packed").first()["packed"]
    broken = W.Archive(archive.headers, archive.payloads.withColumn("packed", F.lit(bytes(other))))
    with pytest.raises(Exception, match="does not match digest"):
        W.read_records(broken).collect()


def test_export_is_read_by_another_parser(spark, scratch, tmp_path):
    """Fields by the standard library's header parser, blocks by its HTTP client."""
    import email.parser
    import http.client
    import io

    rows = [(1, "http://a/x", "payload é\r\n\r\nmore" * 20), (2, None, "payload é\r\n\r\nmore" * 20), (3, "u", None), (4, "u", "short")]
    archive = W.write_archive(scratch, pages(spark, rows), written="2024-05-06T07:08:09Z")
    W.export_warc(W.read_records(archive).orderBy("page_id").coalesce(1), str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("part-*")
    data, seen = io.BytesIO(file.read_bytes()), []
    while (first := data.readline()):
        assert first == b"WARC/1.1\r\n"
        lines = []
        while (line := data.readline()) != b"\r\n":
            lines.append(line)
        fields = email.parser.BytesParser().parsebytes(b"".join(lines))
        assert {"WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type"} <= set(fields.keys())
        assert fields["WARC-Date"] == "2024-05-06T07:08:09Z" and fields["Content-Type"] == "application/http; msgtype=response"
        block = data.read(int(fields["Content-Length"]))
        assert data.read(4) == b"\r\n\r\n"

        class Sock:
            def __init__(self, raw):
                self.raw = raw

            def makefile(self, *args):
                return io.BytesIO(self.raw)

        response = http.client.HTTPResponse(Sock(block))
        response.begin()
        seen.append((fields["WARC-Type"], fields["WARC-Payload-Digest"], response.read()))
    bodies = [(b or "").encode() for _, _, b in rows]
    assert [x[2] for x in seen] == bodies
    assert [x[0] for x in seen] == ["response", "revisit", "response", "response"]
    assert [x[1] for x in seen] == [f"sha256:{hashlib.sha256(b).hexdigest()}" for b in bodies]


def shards_ok(got, rows):
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_shards(spark, scratch, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    shards_ok(S.shard(scratch, awkward, shards=3).collect(), rows)
    assert S.shard(scratch, nothing).collect() == []


def test_bytes_stay_equal_where_ids_repeat(spark, scratch):
    """Null ids with one text, and one id with many texts, hold most rows."""
    rows = [(None, "x" * 100)] * 6000 + [(7, f"text {i} " * 10) for i in range(3000)] + [(i, f"own {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = S.shard(scratch, docs).collect()
    shards_ok(got, rows)
    load, slots = Counter(), Counter()
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["vslot"]] += 1
    mean = sum(load.values()) / S.SHARDS
    assert max(load.values()) <= 1.05 * mean and min(load.values()) >= 0.95 * mean
    assert max(slots.values()) < 60


def test_a_stored_map_is_followed(spark, scratch):
    rows = [(i, "y" * (i % 50)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    placed, versions = S.shard_with_map(scratch, docs, shards=5)
    assert {r["version"] for r in versions.select("version").distinct().collect()} == {0, 1}
    edited = versions.where("version = 1").withColumn("version", F.lit(2)).withColumn("shard", F.when(F.col("shard") == 4, 0).otherwise(F.col("shard")))
    again, stored = S.shard_with_map(scratch, docs, shards=5, slot_map=scratch.write(versions.unionByName(edited)))
    before = {r["id"]: r["shard"] for r in placed.collect()}
    after = again.collect()
    shards_ok(after, rows)
    assert {r["id"]: r["shard"] for r in after} == {i: 0 if s == 4 else s for i, s in before.items()}


def test_shards_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = E.queries()["op3_slot_sharding"](spark, SF).withColumnRenamed("doc_id", "id").collect()
    shards_ok(got, rows)
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    mean = sum(load.values()) / S.SHARDS
    assert max(load.values()) <= max(mean, max(r["size"] for r in got)) * 1.1


def test_rebalancing_is_an_edit(spark, scratch):
    sizes = [(i, 1 + (i * i) % 50 + (4000 if i % 24 == 3 and i < 200 else 0)) for i in range(600)]
    loads = spark.createDataFrame([(i, b, 1) for i, b in sizes], "vslot int, bytes bigint, records bigint")
    zero = S.first_map(loads, 24)
    one = scratch.write(S.rebalanced(zero, 24))
    before = {r["vslot"]: r["shard"] for r in zero.collect()}
    rows = one.collect()
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["bytes"]
    assert {r["version"] for r in rows} == {1} and len(rows) == 600 and len(load) == 24
    assert max(load.values()) - min(load.values()) <= 4050
    moved = sum(before[r["vslot"]] != r["shard"] for r in rows)
    assert 0 < moved < 400
    # greedy by hand
    mean = -(-sum(b for _, b in sizes) // 24)
    kept, movers, hand = Counter(), [], Counter()
    run = Counter()
    for i, b in sorted(sizes, key=lambda x: (-x[1], x[0])):
        s = i % 24
        run[s] += b
        if run[s] <= mean:
            hand[s] += b
        else:
            movers.append((i, b))
    for i, b in movers:
        s = min(range(24), key=lambda s: (hand[s], s))
        hand[s] += b
    assert hand == load


def vectors_want(rows, threshold=0.93):
    ok = []
    for _, v, label in rows:
        a = None if v is None or label is None or any(x is None for x in v) else np.array(v, float)
        ok.append(None if a is None or not len(a) or not np.isfinite(a).all() or not a.any() else a)
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = ok[i], ok[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    out = Counter()
    for i, r in enumerate(rows):
        known = [x for x in least[root(i)] if x is not None]
        out[r[0], links[i], min(known) if known else None] += 1
    return out


def test_vectors(spark, scratch):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        center = rng.normal(size=32)
        for _ in range(15):
            rows.append((len(rows) * 3 % 1009, (center + rng.normal(size=32) * rng.uniform(0, 0.6)).astype(np.float32).tolist(), c % 3))
    rows += [rows[0], (5000, rows[1][1], 0), (5001, rows[1][1], 1), (5002, rows[1][1], None), (5003, None, 0), (5004, [], 0), (5005, [0.0] * 32, 0),
             (5006, [float("nan")] + [1.0] * 31, 0), (5007, [float("inf")] + [1.0] * 31, 0), (5008, [None] + [1.0] * 31, 0), (5009, [1.0, 2.0], 0), (5010, [2.0, 4.0], 0),
             (None, rows[1][1], 0), (5011, [float(x) * 1e30 for x in rows[1][1]], 0)]
    df = spark.createDataFrame([(*r, "n", "k") for r in rows], "vec_id bigint, embedding array<float>, label int, node string, keys string")
    got = V.near_vectors(scratch, df).collect()
    assert Counter((r["id"], r["n_links"], r["component_id"]) for r in got) == vectors_want(rows)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)
    assert V.near_vectors(scratch, df.limit(0)).collect() == []


def test_vector_classes_need_both_hashes(spark, scratch):
    one, other = (np.array(v, float).tobytes() for v in ([1, 0], [0, 1]))
    rows = [(1, 7, 8, 0, one), (2, 7, 9, 0, other), (3, 7, 8, 0, one), (4, 6, 8, 0, other), (5, None, None, None, None)]
    got = scratch.write(V._numbered(spark.createDataFrame(rows, "id long, h1 long, h2 long, scope long, vec binary"))).collect()
    assert sorted((r["h1"], r["h2"], r["first_id"], r["size"], bytes(r["vec"])) for r in got) == [
        (6, 8, 4, 1, other), (7, 8, 1, 2, one), (7, 9, 2, 1, other)]
    assert len({r["node"] for r in got}) == 3


def test_vectors_of_two_scopes_in_one_bucket(spark):
    vec = lambda *v: np.array(v, float).tobytes()
    classes = spark.createDataFrame([(1, 10, vec(1, 2)), (2, 10, vec(2, 4)), (3, 11, vec(1, 2)), (4, 12, vec(1, 2, 3))], "node long, scope long, vec binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    assert [tuple(r) for r in V._verified(pairs, classes, 0.93).collect()] == [(1, 2)]


def test_vectors_are_scaled_without_rounding():
    v = np.random.default_rng(1).normal(size=999)
    for power in (-900, -1, 0, 3, 900):
        scaled = V._scaled(np.ldexp(v, power))
        assert (scaled == V._scaled(v)).all() and 0.5 <= np.abs(scaled).max() < 1


def test_vectors_huge_tiny_and_labels_alike(spark, scratch):
    # labels that hold separators, components beyond the range of a product
    rows = [(1, [3e300, 4e300], "a/2"), (2, [3e-300, 4e-300], "a/2"), (3, [3.0, 4.0], "a"), (4, [3.0, 4.0], "a/2/2"), (5, [4.0, -3.0], "a/2"), (6, [3.0, 4.0], "a/2")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in V.near_vectors(scratch, df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 6: (2, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5)}


def test_vectors_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = E.queries()["op7_embedding_near_dedup"](spark, SF).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == vectors_want(rows)


def test_tables_keep_the_miss_probability():
    for n in (10, 10_000, 10**9):
        bits, tables = V.tables_for(n, 0.93)
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables <= V.MISS * 1.01
