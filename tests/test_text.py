"""Text projections: URL parts, CWE lists, pair key, redaction, fences."""

import hashlib

from pyspark.sql import functions as F

from auditframe.functions import text as T
from auditframe.functions.udfs import unified_diff, unified_diff_text


def one(spark, col):
    return spark.range(1).select(col.alias("x")).collect()[0]["x"]


def test_commit_project_cwe_sample_id(spark):
    url = F.lit("https://code.example/tools/parser/commit/0f3c9d21e7b84a65#diff")
    assert one(spark, T.commit_id_from_url(url)) == "0f3c9d21e7b84a65"
    assert one(spark, T.project_from_url(url)) == "tools/parser"
    assert one(spark, T.project_from_url(F.lit("https://forge.example/libs/codec/-/commit/77aa01"))) == "libs/codec"
    assert one(spark, T.cwe_values(F.lit("cwe-0416"))) == ["CWE-416"]
    assert one(spark, T.cwe_values(F.lit("NVD-CWE-noinfo, nvd-cwe-other, CWE-79, cwe-079"))) == [
        "NVD-CWE-noinfo", "NVD-CWE-Other", "CWE-79"]
    assert one(spark, T.sample_id(F.lit("0f3c9d21e7b84a65"), "titanvul", F.lit(7))) == "0f3c9d21_7"


def test_pair_key_and_clean(spark):
    got = one(spark, T.pair_key(F.lit("  a\u0000 "), F.lit("b\n")))
    assert got == hashlib.sha256(b"a\x00b").hexdigest()
    assert one(spark, T.clean(F.lit("  x \x1c"))) == "x"


def test_fence_and_redaction(spark):
    for payload in ('```json [1, 2]```', '\ufeff```JSON\t[1, 2] \r\n```\n', '```\r\n\n[1, 2]\n\n```', ' [1, 2] '):
        assert one(spark, T.unwrap_code_fence(F.lit(payload))) == '[1, 2]'
    red = one(spark, T.safe_diagnostic_text(F.lit("Bearer abc123 sk-XYZ api_key=secret1  x"), 2000))
    assert "abc123" not in red and "sk-XYZ" not in red and "secret1" not in red
    assert one(spark, T.safe_base_url(F.lit("http://me:pw@models.test:8443/api/?k=v#top"))) == "http://models.test:8443/api/"


def test_safe_filename(spark):
    a = one(spark, T.safe_filename(F.lit("a/b")))
    b = one(spark, T.safe_filename(F.lit("a_b")))
    assert a != b and b == "a_b" and a.startswith("a_b__")


def test_line_counts(spark):
    assert one(spark, T.line_count_splitlines(F.lit("a\nb\n"))) == 2
    assert one(spark, T.line_count_splitlines(F.lit(""))) == 0
    assert one(spark, T.line_count_newlines(F.lit("a\nb\n"))) == 3


def test_unified_diff_udf(spark):
    df = spark.createDataFrame([("int a;\nint b;\n", "int a;\nint c;\n")], "b string, a string")
    got = df.select(unified_diff("b", "a").alias("d")).collect()[0]["d"]
    assert got == unified_diff_text("int a;\nint b;\n", "int a;\nint c;\n")
    assert got.startswith("--- before (vulnerable)\n+++ after (fixed)\n")
