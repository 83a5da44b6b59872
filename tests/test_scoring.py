"""Golden values of the scorers (similarity, CDS, bands, bins, summary)."""

from decimal import ROUND_HALF_UP, Decimal
import random

from pyspark.sql import functions as F

from auditframe.functions import score as S
from auditframe.plans import reports as R

COLS = ["model", "file_ord", "row_key", "sample_id", *S.SCORE_COLUMNS, "phase_c_overall_consistency",
        "phase_c_comment", *S.RAW_COLUMNS]
OK = '{"ok":true}'


def rows_df(spark, rows):
    data = []
    for i, r in enumerate(rows):
        e, l, f = r[0], r[1], r[2]
        raws = r[3] if len(r) > 3 else (OK, OK, OK)
        data.append(("m", 0, (i,), f"s_{i + 1}", e, l, f, "consistent", "ok", *raws))
    schema = ("model string, file_ord int, row_key struct<i:int>, sample_id string, "
              + ", ".join(f"{c} string" for c in COLS[4:]))
    return spark.createDataFrame(data, schema)


def test_similarity_golden(spark):
    df = rows_df(spark, [("0.3", "0.4", "0.5"), ("0.2", "0.4", "0.6"), ("0.9", "0.8", "0.7"), ("0.5", "0.75", "0.75")])
    got = [r["similarity"] for r in R.similarity_rows(df).orderBy("sample_id").collect()]
    assert got == ["0.35", "0.3", "0.75", "0.583333"]


def test_cds_band_bin(spark):
    df = rows_df(spark, [("0.2", "0.2", "0.2")])
    r = R.similarity_rows(df).collect()[0]
    assert (r["similarity"], r["cds_score"], r["cds_band"], r["cds_bin"]) == ("0.2", "0.8", "high", 7)


def test_summary_and_histogram(spark):
    df = rows_df(spark, [("0.3", "0.4", "0.5"), ("0.2", "0.4", "0.6"), ("0.9", "0.8", "0.7")])
    s = R.score_summary(df, which="similarity").collect()[0]
    assert (s["mean"], s["median"], s["minimum"], s["maximum"]) == ("0.466667", "0.35", "0.3", "0.75")
    h = R.score_histogram(df, which="similarity", models=["m"]).orderBy("bin_index").collect()
    assert len(h) == 10 and h[0]["similarity_range"] == "[0.0, 0.1]" and h[-1]["similarity_range"] == "(0.9, 1.0]"
    hit = {r["similarity_range"]: r["percentage"] for r in h if r["count"]}
    assert hit == {"(0.2, 0.3]": "33.333333", "(0.3, 0.4]": "33.333333", "(0.7, 0.8]": "33.333333"}


def test_placeholder_rules(spark):
    kept = ('{"pipeline_placeholder":false}',) * 3
    bad = (OK, '{"pipeline_placeholder":true,"pipeline_error":"failed"}', OK)
    df = rows_df(spark, [("0", "0", "0", kept), ("0.5", "0.5", "0.5", bad), ("not-a-number", "0.5", "0.5"),
                         ("0.5", "0.5", "0.5", (OK, OK, "{garbage}"))])
    s = R.score_summary(df).collect()[0]
    assert (s["row_count"], s["skipped_row_count"]) == (2, 2)


def test_similarity_matches_python_decimal(spark):
    rnd = random.Random(7)
    rows = [tuple(str(Decimal(rnd.randint(0, 10**9)) / Decimal(10**9)) for _ in range(3)) for _ in range(300)]
    df = rows_df(spark, rows)
    got = {r["sample_id"]: r["similarity"] for r in R.similarity_rows(df).collect()}
    for i, (e, l, f) in enumerate(rows):
        vals = [Decimal(e), Decimal(l), Decimal(f)]
        want = ((sum(vals) / 3 + min(vals)) / 2).quantize(Decimal("0.000001"), rounding=ROUND_HALF_UP)
        text = format(want, "f").rstrip("0").rstrip(".") or "0"
        assert got[f"s_{i + 1}"] == text


def test_percentage_and_text(spark):
    df = spark.range(1).select(
        S.percentage(F.lit(1), F.lit(3)).alias("a"), S.percentage(F.lit(0), F.lit(0)).alias("b"),
        S.micro_text(F.lit(-500000)).alias("c"), S.bin_label(F.lit(0)).alias("d"), S.bin_label(F.lit(9)).alias("e"),
    ).collect()[0]
    assert tuple(df) == ("33.333333", "0", "-0.5", "[0.0, 0.1]", "(0.9, 1.0]")


def test_sample_sort_key(spark):
    df = spark.createDataFrame([("abc_12",), ("abc",), ("a_b",)], "s string")
    got = [r[0] for r in df.select(S.sample_sort_key(F.col("s"))).collect()]
    assert got == [12, S.SORT_LAST, S.SORT_LAST]


def test_enriched_column_placement(spark):
    df = rows_df(spark, [("0.12", "0.34", "0.56")]).withColumn("similarity", F.lit("9"))
    cds = R.enriched(df, "cds")
    assert cds.columns[-3:] == ["similarity", "cds_score", "cds_band"]
    sim = R.enriched(df, "similarity")
    assert sim.columns == df.columns and sim.collect()[0]["similarity"] == "0.23"


def test_single_model_report_errors_and_writes(spark):
    import os
    import tempfile

    import pytest

    bad = rows_df(spark, [("not-a-number", "0.5", "0.5")])
    with pytest.raises(ValueError, match="no valid data rows; skipped 1"):
        R.single_model_report(bad, tempfile.mkdtemp(prefix="af-d6-"))
    out = tempfile.mkdtemp(prefix="af-d6-")
    summary = R.single_model_report(rows_df(spark, [("0.2", "0.2", "0.2")]), out)
    assert summary["m"]["mean"] == "0.8"
    assert {"enriched", "distribution", "summary"} <= set(os.listdir(out))


def test_run_summary_document(spark):
    rows = []
    for model in ("chatgpt", "claude", "deepseek"):
        for i in (1, 2):
            rows.append((model, 0, (i,), f"s_{i}", "0.2", "0.2", "0.2", "consistent", "ok", OK, OK, OK))
    schema = ("model string, file_ord int, row_key struct<i:int>, sample_id string, "
              + ", ".join(f"{c} string" for c in COLS[4:]))
    df = spark.createDataFrame(rows, schema).withColumn("source_file", F.lit("results.csv"))
    doc = R.run_summary_document(df).collect()[0]
    assert doc["three_model_common_valid_sample_count"] == 2 and doc["common_all_models_row_count"] == 6
    assert doc["models"]["claude"]["valid_row_count"] == 2
    assert {a["comparison"] for a in doc["agreement"]} >= {"chatgpt_vs_claude", "all_three"}
    assert doc["bands"]["low"] == "(-inf, 0.25]"
