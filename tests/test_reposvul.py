"""ReposVul conversion: candidate extraction, filters, duplicate fold, oversized rows."""

import json

from pyspark.sql import functions as F

from auditframe.functions import udfs
from auditframe.functions.udfs import candidate_bodies
from auditframe.plans import reposvul as RV

FILE = """#include <stddef.h>

static int unrelated(int value)
{
    return value + 1;
}

size_t parse_size(const char *text)
{
    /* a } in a comment */
    const char *brace = "}";
    if (!text) {
        return 0;
    }
    return 42;
}
"""
FIXED = """size_t parse_size(const char *text)
{
    if (!text || !*text) {
        return 0;
    }
    return 42;
}"""

SCHEMA = ("record_index bigint, function_id string, function string, commit_id string, commit_message string, "
          "project string, file_name string, target int, outdated int, cwe_id array<string>")


def test_candidate_extraction():
    cands = candidate_bodies(FILE, FIXED, "parse_size")
    assert len(cands) == 1
    assert cands[0][1].startswith("size_t parse_size(const char *text)") and cands[0][1].endswith("return 42;\n}")


VULNERABLE = """size_t parse_size(const char *text)
{
    return 42;
}"""


def test_braces_outside_code_do_not_count():
    source = "int f(void)\n{\n  char c = '}'; // }\n  /* } */ puts(\"}\\\"}\");\n  { }\n}\nint g(void) { f(); }\n"
    assert candidate_bodies(source, "int f(void)", "f")[0] == (0, source[:source.index("int g")].strip())
    assert candidate_bodies("int f(void);\n", "int f(void)", "f") == []
    assert candidate_bodies("int f(void) { if (1) {", "int f(void)", "f") == []


def _records(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _files(spark, content):
    """One file at the fixing commit of the records below."""
    return spark.createDataFrame([("acme/demo", "abcdef1234567890", "src/a.c", content)],
                                 "project string, commit_id string, path string, content string")


def _row(i, fid, target=1, outdated=0, cwe=("CWE-20",), project="acme/demo", path="src/a.c", function=VULNERABLE):
    return (i, fid, function, "abcdef1234567890", "fix", project, path, target, outdated, list(cwe))


def test_record_is_before_and_file_is_after(spark):
    rows = [_row(0, "repo_fn_7", project="/acme/demo/", path="src\\a.c ")]
    out = RV.convert_reposvul(_records(spark, rows), _files(spark, FILE)).collect()[0]
    assert out["reason"] is None and out["sample_id"] == "abcdef12_7"
    assert out["func_before"] == VULNERABLE and "a } in a comment" in out["func_after"]
    assert out["diff_length"] == len(out["diff"]) and out["diff"].startswith("--- before (vulnerable)")
    assert set(RV.PAIR_FIELDS) <= set(out.asDict())


def test_filters_and_fold(spark):
    rows = [_row(0, "fn_1", target=0), _row(1, "fn_2", outdated=1), _row(2, "fn_3"), _row(3, "fn_3", cwe=("CWE-20", "CWE-125"))]
    out = RV.convert_reposvul(_records(spark, rows), _files(spark, FILE))
    reasons = sorted((r["record_index"], r["reason"]) for r in out.collect())
    assert reasons == [(0, "not_target"), (1, "outdated"), (2, None), (3, "duplicate_function")]
    written = out.where(F.col("reason").isNull()).collect()[0]
    assert written["cwe"] == '["CWE-20","CWE-125"]'
    c = RV.reposvul_counts(out).collect()[0]
    assert (c["read"], c["candidates"], c["written"], c["duplicates"], c["skipped"]) == (4, 1, 1, 1, 1)


def test_oversized_unchanged_and_missing(spark):
    big = FILE.replace("/* a } in a comment */", "/* " + "x" * 140000 + " */")
    rows = _records(spark, [_row(0, "fn_1")])
    assert RV.convert_reposvul(rows, _files(spark, big)).collect()[0]["reason"] == "oversized_csv_field"
    assert RV.convert_reposvul(rows, _files(spark, big), max_field_chars=140_000).collect()[0]["reason"] == "oversized_csv_field"
    assert RV.convert_reposvul(rows, _files(spark, big), max_field_chars=200_000).collect()[0]["reason"] is None
    same = FILE[:FILE.index("size_t")] + VULNERABLE + "\n"
    assert RV.convert_reposvul(rows, _files(spark, same)).collect()[0]["reason"] == "unchanged"
    assert RV.convert_reposvul(rows, _files(spark, "int other(void) { }")).collect()[0]["reason"] == "no_match"
    assert RV.convert_reposvul(_records(spark, [_row(0, "fn_1", path="src/b.c")]), _files(spark, FILE)).collect()[0]["reason"] == "missing_file"


def test_lines(spark):
    good = {"function_id": "repo_fn_7", "function": VULNERABLE, "target": 1, "commit_id": "abcdef1234567890", "project": "acme/demo",
            "file_name": "src/a.c", "cwe_id": "CWE-20", "commit_message": "m", "outdated": 0}
    lines = spark.createDataFrame(
        [(1, "{broken json"), (2, "[1]"), (3, ""), (4, json.dumps(good)), (5, json.dumps({**good, "target": True, "function_id": "x"}))], "line bigint, value string")
    out = RV.convert_reposvul(RV.records_from_lines(lines), _files(spark, FILE))
    got = {r["record_index"]: (r["reason"], r["cwe"]) for r in out.collect()}
    assert got == {1: ("JSONDecodeError", None), 2: ("invalid_record", None), 4: (None, '["CWE-20"]'), 5: ("not_target", None)}


def test_quotes_in_front_of_a_definition_mean_nothing():
    body = "int f(int x)\n{\n  char c = '}'; /* it's } */ // don't }\n  return \"{\"[0];\n}"
    for front in ("#error you can't build this\n", "int big = 1'000;\n", "/* isn't\" */ char *s = \"\n", "'\"'\"'\n"):
        assert candidate_bodies(front + body + "\nint g(void) { return f(1); }\n", body, "f") == [(len(front), body)], front
    assert candidate_bodies("int f(int x)\n{ '\n}\n", "int f(int x)", "f") == []


def test_a_name_of_its_own_compiles_no_pattern(monkeypatch):
    """every record names another function, so a pattern for each fills no cache."""
    compiled = []
    real = udfs.re.compile
    monkeypatch.setattr(udfs.re, "compile", lambda *a: compiled.append(a) or real(*a))
    for name in ("f", "_f1", "$f", "\u00e9t\u00e9"):
        body = f"int x{name}x(void) {{}}\nint {name} \t(int x)\n{{\n  return 1;\n}}"
        after = " ".join(("int", name, "(int y) { return 2; }"))
        source = f"int {name}(int x);\nint not{name}(int x) {{ }}\n/* {name}\n(int) {{ }} */\n  {after}\nint g(void) {{ return {name}; }}\n"
        want = ["int not$f(int x) { }"] if name == "$f" else [after]
        assert [text for _, text in candidate_bodies(source, body, name)] == want
    assert not compiled


def test_fold_unites_only_ids_with_copies(spark):
    rows = [
        _row(5, "fn_1", cwe=(" CWE-2 ", "", "CWE-1", "CWE-2", None)), _row(6, "fn_2", cwe=()), _row(9, "fn_3", cwe=("CWE-9", "CWE-3")),
        _row(7, "fn_3", cwe=("CWE-3", " CWE-7")), _row(8, "fn_3", cwe=("CWE-7", "CWE-1")), _row(10, "fn_4", cwe=("",)), _row(11, "fn_4", cwe=())]
    out = RV._folded(_records(spark, rows))
    got = {r["function_id"]: (r["record_index"], r["copies"], r["cwes"]) for r in out.collect()}
    assert got == {"fn_1": (5, 1, ["CWE-2", "CWE-1"]), "fn_2": (6, 1, []), "fn_3": (7, 3, ["CWE-3", "CWE-7", "CWE-1", "CWE-9"]), "fn_4": (10, 2, [])}
    # the lists of ids without copies are neither taken apart nor grouped
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    generate = plan[plan.index("Generate posexplode"):]
    assert "Join Inner" in generate and "copies" in generate
