"""Plan checks: SQL-checkable queries stay JVM-side; views prune and push down."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "PythonUDF")


@pytest.mark.parametrize("name", [
    "p11_composite_similarity", "a4_bin_distribution", "a5_model_agreement", "d1_paired_conversion",
    "d5_deduplicated", "w1_primevul_pairs", "s10_csv_cells", "a12_function_fold",
])
def test_no_python_in_sql_checked_plans(spark, name):
    assert name in E.oracle_sql()
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in PYTHON_NODES), name


def test_scan_pruning(spark):
    from auditframe.plans.views import scored_results

    plan = scored_results(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_returnflag" not in plan


def test_every_line_is_a_result_row(spark):
    from auditframe.plans.reports import run_summary
    from auditframe.plans.views import attempt_rows, scored_results
    from auditframe.sources.tables import table

    lines = table(spark, SF, "lineitem").count()
    assert sum(r["source_row_count"] for r in run_summary(scored_results(spark, SF)).collect()) == lines
    made = E.queries()["x4_attempt_resolution"](spark, SF)
    assert attempt_rows(spark, SF).count() == table(spark, SF, "events").count()
    assert made.count() >= table(spark, SF, "events").count() / 3


def test_models_subset_ignores_other_models(spark):
    from auditframe.plans.reports import common_rows, valid_results
    from auditframe.plans.views import scored_results

    df = scored_results(spark, SF)
    got = {(r["base_sample_id"], r["model"]) for r in common_rows(df, ("chatgpt", "claude")).collect()}
    valid = {}
    for r in valid_results(df).where("model in ('chatgpt', 'claude')").collect():
        valid.setdefault(r["sample_id"], set()).add(r["model"])
    assert got == {(i, m) for i, ms in valid.items() if len(ms) == 2 for m in ms}


def test_damaged_report_is_found(spark):
    from pyspark.sql import functions as F

    from auditframe.plans import reports as R
    from auditframe.plans.views import scored_results

    rows = R.model_rows(scored_results(spark, SF))
    t = R.report_tables(rows)
    worse = F.when(F.col("sample_id").endswith("1"), "0.5").otherwise(F.col("similarity"))
    assert sum(r["similarity_mismatches"] for r in R.recompute_check({**t, "results": t["results"].withColumn("similarity", worse)}, rows).collect()) > 0
    assert not all(r["rows_balance"] for r in R.row_accounting({**t, "excluded_errors": t["excluded_errors"].limit(3)}).collect())
    fewer = {**t, "common_all_models": t["common_all_models"].where("model <> 'claude' or base_sample_id not like '%1'")}
    r = R.common_completeness(fewer).first()
    assert r["incomplete_samples"] > 0
    wrong = {**t, "model_agreement": t["model_agreement"].withColumn("agree_count", F.col("agree_count") + (F.col("comparison") == "all_three").cast("int"))}
    assert R.recount_check(wrong).first()["mismatches"] == 1
