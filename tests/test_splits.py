"""Readers of byte ranges against readers of whole files, with ranges of a few bytes."""

import csv
import glob
import io
import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from auditframe.sources import files as S
from auditframe.sources import splits


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _file(name, text, folder=None):
    path = os.path.join(folder or tempfile.mkdtemp(prefix="af-split-"), name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def _value(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind < 2:
        return "".join(rng.choice(['"', "\\", ",", "[", "]", "{", "}", "\n", "é", "漢", "a", " ", ":", "\\\""]) for _ in range(rng.randrange(40)))
    if kind < 5:
        return [None, True, -12, 3.5, 0][rng.randrange(5)]
    if kind == 5:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(5))]
    return {rng.choice("abcdef,\"") + str(i): _value(rng, depth + 1) for i in range(rng.randrange(5))}


@pytest.mark.parametrize("seed", range(4))
def test_json_array_across_ranges(small_blocks, seed):
    rng = random.Random(seed)
    values = [_value(rng) for _ in range(rng.choice([3, 30]))] + [["x" * 500, {"y": "],[" * 60}]]
    dump = {0: {}, 1: {"indent": 2}, 2: {"separators": (",", ":"), "ensure_ascii": False}, 3: {"ensure_ascii": False}}[seed]
    path = _file("a.json", ("﻿ \n" if seed == 1 else "") + json.dumps(values, **dump) + " \n")
    got = S.read_json_array(small_blocks, path).select("index", F.to_json("record").alias("r")).collect()
    assert [json.loads(r["r"]) for r in sorted(got, key=lambda r: r["index"])] == values
    assert sorted(r["index"] for r in got) == list(range(len(values)))


def test_the_ranges_are_read_by_many_tasks(small_blocks):
    path = _file("a.json", json.dumps(list(range(700))))
    pieces = splits._pieces(small_blocks, path, ",")
    assert pieces.rdd.getNumPartitions() > 10
    starts = splits.block_starts(splits.block_effects(pieces, splits.JsonScan()), splits.JsonScan())
    assert len(starts) > 10 and max(s.number for s in starts.values()) > 600
    assert [r["record"].toPython() for r in S.read_json_array(small_blocks, path).orderBy("index").collect()] == list(range(700))


@pytest.mark.parametrize("text, says", [
    ("[1, 2", "unterminated"), ('["a', "unterminated"), ("{}", "must hold a JSON array"), ("[1] 2", "unexpected content"),
    ("[1, [2]] , " + "3, " * 60 + "4", "unexpected content|unterminated"), ("[1,,2]", "no JSON"), ("[1, oops]", "no JSON"), ("[[1, 2], 3] ]", "unexpected content|unterminated"),
])
def test_what_is_no_json_array(small_blocks, text, says):
    import re

    with pytest.raises(Exception, match=re.compile(says)):
        S.read_json_array(small_blocks, _file("bad.json", text)).collect()


def test_empty_arrays(small_blocks):
    assert S.read_json_array(small_blocks, _file("e.json", " [ \n ] ")).collect() == []
    assert S.read_json_array(small_blocks, _file("e.json", "[[]]")).count() == 1


def _cell(rng):
    return "".join(rng.choice(['"', ",", "\n", "x", "é", " ", "y", "\r\n", '""']) for _ in range(rng.randrange(12)))


@pytest.mark.parametrize("seed", range(4))
def test_csv_with_line_breaks_across_ranges(small_blocks, seed):
    rng = random.Random(seed)
    folder, expected = tempfile.mkdtemp(prefix="af-split-"), []
    for k in range(3):
        out = io.StringIO()
        w = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        w.writerow(["sample_id", "text", "more"])
        rows = [[f"s{k}_{i}", _cell(rng), "z" * rng.randrange(200)] for i in range(rng.choice([0, 1, 12]))]
        w.writerows(rows)
        text = out.getvalue().rstrip("\r\n") if k == 1 else out.getvalue().replace("\ns0_7,", "\n\n\ns0_7,")
        _file(f"f{k}.csv", text, folder)
        expected += rows
    if not expected:
        return
    got = S.read_samples_csv(small_blocks, folder).orderBy("row_number").collect()
    assert [r["row_number"] for r in got] == list(range(1, len(expected) + 1))
    clean = lambda t: (t or "").replace("\r\n", "\n")
    assert [[r["sample_id"], clean(r["text"]), r["more"] or ""] for r in got] == [[a, clean(b), c] for a, b, c in expected]
    lo, hi = len(expected) // 3 + 1, len(expected) // 2 + 1
    assert [r["sample_id"] for r in S.read_samples_csv(small_blocks, folder, lo, hi).orderBy("row_number").collect()] == [r[0] for r in expected[lo - 1:hi]]


def test_quotes_inside_unquoted_fields(small_blocks):
    lines = [f's{i},a 5" pipe,b' if i % 3 else f's{i},"quoted, ""x""\nnext line",c' for i in range(60)]
    got = S.read_result_csv(small_blocks, _file("q.csv", "sample_id,t,u\n" + "\n".join(lines))).collect()
    assert sorted((r["sample_id"], r["t"], r["u"]) for r in got) == sorted(
        (f"s{i}", 'a 5" pipe' if i % 3 else 'quoted, "x"\nnext line', "b" if i % 3 else "c") for i in range(60))


def test_row_numbers_without_a_sort(small_blocks):
    folder = tempfile.mkdtemp(prefix="af-split-")
    for k in range(3):
        _file(f"f{k}.txt", "".join(f"line {k} {i}\n" for i in range(100)), folder)
    numbered = splits.numbered_rows(small_blocks.read.text(folder), "n")
    got = [(r["n"], r["value"]) for r in numbered.orderBy("n").collect()]
    assert got == [(100 * k + i + 1, f"line {k} {i}") for k in range(3) for i in range(100)]
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan


def test_parquet_range_reads_only_its_files(spark):
    folder = os.path.join(tempfile.mkdtemp(prefix="af-split-"), "t")
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(folder)
    files = sorted(glob.glob(folder + "/*.parquet"))
    order = [r["id"] for f in files for r in spark.read.parquet(f).collect()]
    got = S.read_samples_parquet(spark, folder, 12, 19)
    assert [r["id"] for r in got.orderBy("row_number").collect()] == order[11:19]
    assert len(got.inputFiles()) == 1
    assert [r["id"] for r in S.read_samples_parquet(spark, folder, 35).orderBy("row_number").collect()] == order[34:]
    with pytest.raises(ValueError, match="no samples"):
        S.read_samples_parquet(spark, folder, 41)
