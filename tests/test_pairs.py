"""Pair conversion, dedup, adjacent pairing, MegaVul limits (FIXTURES golden values)."""

from pyspark.sql import functions as F

from auditframe.plans import pairs as P

URL = "https://github.com/acme/demo/commit/abcdef1234567890"


def pair_df(spark, rows):
    schema = ("doc_id bigint, dataset_ord int, dataset string, func_before string, func_after string, "
              "commit_url string, commit_msg string, repo_name string, cwe_id string")
    return spark.createDataFrame(rows, schema)


def test_titanvul_conversion(spark):
    rows = [
        (1, 0, "titanvul", "int f(){return 1;}", "int f(){return 2;}", URL, "fix", "", "cwe-0190"),
        (2, 0, "titanvul", "int f(){return 1;}", "int f(){return 2;}", URL, "fix", "", "cwe-0190"),
        (3, 0, "titanvul", "same", "same", URL, "fix", "", ""),
        (4, 0, "titanvul", "  ", "x", URL, "fix", "", ""),
    ]
    conv = P.convert_paired(pair_df(spark, rows))
    c = P.conversion_counts(conv).collect()[0]
    assert (c["read"], c["written"], c["duplicates"], c["unchanged"], c["invalid"]) == (4, 1, 1, 1, 1)
    w = conv.where(F.col("reason").isNull()).collect()[0]
    assert (w["sample_id"], w["commit_id"], w["project"], w["cwe"]) == ("abcdef12_1", "abcdef1234567890", "acme/demo",
                                                                        '["CWE-190"]')
    reasons = sorted(r["reason"] for r in conv.where(F.col("reason").isNotNull()).collect())
    assert reasons == ["duplicate_pair", "missing_function", "unchanged_pair"]


def test_dedup_metadata_merge(spark):
    rows = [
        (1, 0, "titanvul", "a", "b", "", "", "", ""),
        (2, 1, "benchvul", "a", "b", "https://github.com/acme/demo/commit/abcdef123456", "msg", "", "CWE-190"),
        (3, 1, "benchvul", "c", "d", "", "", "", ""),
    ]
    conv = P.convert_paired(pair_df(spark, rows)).where(F.col("reason").isNull())
    dd = P.deduplicate(conv)
    first = dd.where("emit AND dataset = 'titanvul'").collect()[0]
    assert (first["m_commit_id"], first["m_project"], first["m_cwe"]) == ("abcdef123456", "acme/demo", '["CWE-190"]')
    counts = {r["dataset"]: r for r in P.dedup_counts(dd).collect()}
    assert counts["titanvul"]["written"] == 1
    assert counts["benchvul"]["written"] == 1 and counts["benchvul"]["cross_dataset_duplicates"] == 1


def test_adjacent_pairing(spark):
    schema = ("source bigint, line bigint, invalid_line boolean, target int, func string, commit_id string, "
              "cve string, project string, commit_message string, cwe string")
    rows = [
        (0, 1, False, 1, "bad()", "abcdef1234", "CVE-1", "p", "m", "CWE-1"),
        (0, 2, False, 0, "good()", "abcdef1234", "CVE-1", "p", "m", "CWE-1"),
        (0, 3, False, 1, "bad()", "abcdef1234", "CVE-2", "p", "m", "CWE-1"),
        (0, 4, False, 0, "good()", "fedcba9876", "CVE-2", "p", "m", "CWE-1"),
    ]
    out = P.pair_adjacent(spark.createDataFrame(rows, schema)).orderBy("read_pairs").collect()
    assert [r["read_pairs"] for r in out] == [1, 2]
    assert out[0]["reason"] is None and out[0]["sample_id"] == "abcdef12_1"
    assert out[1]["reason"] == "metadata_mismatch"


def test_megavul_limits(spark):
    schema = ("record_index bigint, is_vul boolean, func_before string, func string, diff_func string, "
              "commit_hash string, repo_name string, commit_msg string, cwe_ids array<string>")
    rows = [
        (0, True, "a", "b", "-a\n+b", "abcdef1234567", "r", "m", ["CWE-1"]),
        (1, True, "a", "b", "x" * 20, "abcdef1234567", "r", "m", ["CWE-1"]),
        (2, False, "a", "b", "-a\n+b", "abcdef1234567", "r", "m", ["CWE-1"]),
    ]
    out = P.megavul_filter(spark.createDataFrame(rows, schema), max_diff_chars=10)
    c = P.megavul_counts(out).collect()[0]
    assert (c["read"], c["candidates"], c["written"], c["filtered"]) == (3, 2, 1, 1)
    assert out.where(F.col("reason").isNull()).collect()[0]["sample_id"] == "abcdef12_0"


def test_megavul_each_limit(spark):
    schema = ("record_index bigint, is_vul boolean, func_before string, func string, diff_func string, "
              "commit_hash string, repo_name string, commit_msg string, cwe_ids array<string>")
    rows = [
        (0, True, "a", "b", "-a\n+b-long", "c", "r", "m", []),
        (1, True, "abcdef", "b", "-a", "c", "r", "m", []),
        (2, True, "a", "abcdef", "-a", "c", "r", "m", []),
        (3, True, "a\nb\nc", "b", "-a", "c", "r", "m", []),
    ]
    out = P.megavul_filter(spark.createDataFrame(rows, schema), max_diff_chars=5, max_function_chars=5,
                           max_function_lines=2)
    c = P.megavul_counts(out).collect()[0]
    assert (c["written"], c["filtered"]) == (0, 4)


def test_pair_tables_with_diff(spark):
    rows = pair_df(spark, [
        (1, 0, "titanvul", "int f(){\n return 1;\n}", "int f(){\n return 2;\n}", URL, "fix", "", "CWE-020"),
        (2, 1, "benchvul", " int f(){\n return 1;\n} ", "int f(){\n return 2;\n}", "", "later", "acme/x", "CWE-79"),
        (3, 1, "benchvul", "a", "b", "", "", "", "plain text CWE-7, CWE-007"),
    ])
    table = P.pair_table(rows)
    assert table.columns == ["dataset", *P.PAIR_COLUMNS]
    got = {r["sample_id"]: r for r in table.collect()}
    assert got["abcdef12_1"]["diff"] == (
        "--- before (vulnerable)\n+++ after (fixed)\n@@ -1,3 +1,3 @@\n int f(){\n- return 1;\n+ return 2;\n }")
    assert all(r["diff_length"] == len(r["diff"]) for r in got.values())
    merged = {r["sample_id"]: r for r in P.dedup_table(rows).collect()}
    assert set(merged) == {"abcdef12_1", "benchvul_2"}
    assert merged["abcdef12_1"]["cwe"] == '["CWE-20","CWE-79"]' and merged["abcdef12_1"]["commit_msg"] == "fix"
    assert merged["benchvul_2"]["cwe"] == '["CWE-7"]' and merged["benchvul_2"]["diff_length"] > 0


def test_missing_metadata_is_a_mismatch(spark):
    schema = ("source bigint, line bigint, invalid_line boolean, target int, func string, commit_id string, "
              "cve string, project string, commit_message string, cwe string")
    rows = [(0, 1, False, 1, "bad()", None, "CVE-1", "p", "m", "CWE-1"), (0, 2, False, 0, "good()", "c2", "CVE-1", "p", "m", "CWE-1"),
            (0, 3, False, None, "bad()", "c", "CVE-2", "p", "m", "CWE-1"), (0, 4, False, 0, "good()", "c", "CVE-2", "p", "m", "CWE-1")]
    out = P.pair_adjacent(spark.createDataFrame(rows, schema)).orderBy("read_pairs").collect()
    assert [r["reason"] for r in out] == ["metadata_mismatch", "invalid_target_order"]


def test_lines_to_pairs(spark):
    lines = [(0, 1, '{"target": 1, "func": "a", "commit_id": "abcdef1", "cve": "x", "cwe": ["CWE-1", "CWE-2"]}'),
             (0, 2, '{"target": 0, "func": "b", "commit_id": "abcdef1", "cve": "x"}'), (0, 3, "{oops"), (0, 4, ""), (0, 5, "[]"),
             (0, 6, '{"target": 1, "func": "a"}')]
    records = P.parse_turn_lines(spark.createDataFrame(lines, "source bigint, line bigint, value string"))
    assert sorted((r["line"], r["reason"]) for r in P.line_rejects(records).collect()) == [(3, "invalid_json"), (5, "invalid_record")]
    pairs = P.pair_adjacent(records.drop("line_reason"))
    assert [(r["first_line"], r["reason"], r["cwe"]) for r in pairs.orderBy("first_line").collect()] == [
        (1, None, '["CWE-1","CWE-2"]'), (6, "unpaired_final_record", None)]
    c = P.adjacent_counts(pairs, records).first()
    assert (c["read"], c["written"], c["invalid"], c["skipped_lines"]) == (1, 1, 1, 2)


def test_bodies_stay_out_of_numbering(spark):
    from auditframe.plans.views import pair_rows

    plan = P.convert_paired(pair_rows(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "func_before" not in plan and "func_after" not in plan


def test_bodies_of_null_and_repeated_ids(spark):
    rows = pair_df(spark, [
        (None, 0, "titanvul", "a", "b", "", "null id", "", ""),
        (None, 0, "titanvul", "c", "d", "", "null id too", "", ""),
        (7, 0, "titanvul", "e", "f", "", "e", "", ""),
        (7, 0, "titanvul", " g", "h", "", "g", "", ""),
        (8, 1, "benchvul", "i", "j", "", "i", "", ""),
        (8, 1, "benchvul", "i", "j", "", "i", "", ""),
    ])
    want = [("a", "b", "null id"), ("c", "d", "null id too"), ("e", "f", "e"), ("g", "h", "g"), ("i", "j", "i")]
    for table in (P.pair_table(rows), P.dedup_table(rows)):
        assert sorted((r["func_before"], r["func_after"], r["commit_msg"]) for r in table.collect()) == want


def test_turns_of_null_and_repeated_lines(spark):
    schema = ("source bigint, line bigint, invalid_line boolean, target int, func string, commit_id string, "
              "cve string, project string, commit_message string, cwe string")
    tail = ("c", "CVE-1", "p", "m", "CWE-1")
    rows = [(0, None, False, 1, "a", *tail), (0, 1, False, 0, "b", *tail),
            (1, 1, False, 1, "c", *tail), (1, 1, False, 1, "d", *tail), (2, 5, False, 1, "e", *tail), (2, 6, False, 0, None, *tail)]
    out = P.pair_adjacent(spark.createDataFrame(rows, schema)).collect()
    got = sorted((r["source"], r["first_line"] or 0, *sorted((r["func_before"], r["func_after"])), r["reason"] or "") for r in out)
    assert got == [(0, 0, "a", "b", ""), (1, 1, "c", "d", "invalid_target_order"), (2, 5, "", "e", "missing_function")]
