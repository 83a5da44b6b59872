"""Model rows carry no more than the reports read; short fields are stripped only where they need it."""

from pyspark.sql import functions as F

from auditframe.functions.text import PY_WHITESPACE, py_strip, strip_field
from auditframe.plans.reports import model_rows


def _scored(spark):
    rows = [("a", 0, i, f" s_{i % 2}\t", "0.5", " 0.25 ", "1", "{}", "{}", "{}", "f") for i in range(3)]
    return spark.createDataFrame(rows, "model string, file_ord int, row_key int, sample_id string, phase_c_variable_match_score string, "
        "phase_c_step_position_score string, phase_c_dataflow_path_score string, phase_a_raw string, phase_b_raw string, phase_c_raw string, source_file string")


def test_model_rows_leave_the_row_place_behind(spark):
    out = model_rows(_scored(spark))
    assert not {"_pos", "_reasons0"} & set(out.columns)
    assert sorted((r["sample_id"], r["_reasons"]) for r in out.collect()) == [("s_0", ""), ("s_0", "duplicate_sample_id"), ("s_1", "")]


def test_strip_field_is_strip(spark):
    ends = [*PY_WHITESPACE, "", "\x00", "\x01", "!", "~", "\x7f", "\x80", "ä", "x", "\U0001f600"]
    texts = [None, *(a + m + b for a in ends for b in ends for m in ("", "m", "m n"))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(~strip_field("t").eqNullSafe(py_strip("t"))).count() == 0
    assert df.select(strip_field("t").alias("s")).where(F.col("s").isNull()).count() == 1
