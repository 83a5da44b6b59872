"""Responses are judged once a row, whatever the size of the expressions."""

from pyspark.sql import functions as F

from auditframe.functions import text as T
from auditframe.functions import variant as V
from auditframe.functions.jsonfix import model_json_text, redacted, with_model_json_text, with_redacted_text
from auditframe.operators.contracts import contract_errors
from auditframe.plans.phases import _checked, judged_attempts, normalize, phase_reports
from auditframe.plans.run import ATTEMPT_SCHEMA

TEXTS = ['{"a": 1}', ' ```json\n{"a": 2}\n``` ', '{"a": 3, }', '{"a": [4', '{"a": 1} {"b": 5}', "not json {", "[6, 7]", '{"a": NaN}', "", None, '﻿{"a": "Ä"}']


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_response_is_unwrapped_and_parsed_once(spark):
    plan = _optimized(judged_attempts(spark.createDataFrame([("s", "A", 1, None, None, None, None, "stop", "{}")], ATTEMPT_SCHEMA)))
    assert plan.count("(?is)^```") <= 2
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") <= 2


def test_steps_give_what_the_expression_gives(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    raw = F.coalesce("t", F.lit(""))
    got = with_model_json_text(df, "got", raw, F.col("i") != 0).withColumn("want", F.when(F.col("i") != 0, model_json_text(T.unwrap_code_fence(raw))))
    rows = got.collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert rows[0]["got"] is None and rows[1]["got"] == '{"a": 2}'


REPORTS = ['{"a": "x", "b": [1, 2], "c": null}', '{"a": "q\\"\\n\\u00e4", "b": ["y", null], "c": {"k": "v"}, "b2": "z", "B": 1.50}', '{"a": 5, "b": [], "c": true, "odd key": 1}']


def test_report_texts_are_those_of_the_values(spark):
    v = F.parse_json("t")
    df = spark.createDataFrame([(t,) for t in REPORTS], "t string").select(v.alias("v"))
    texts = {}
    for name in "abc":
        value = V.field(F.col("v"), name)
        texts[name] = V.json_text(value, V.vtype(value), V.string_value(value))
    rows = df.select(F.to_json("v").alias("want"), V.object_text(F.try_variant_get("v", "$", "map<string,variant>"), texts).alias("got")).collect()
    assert [r["got"] for r in rows[:2]] == [r["want"] for r in rows[:2]]
    assert rows[2]["got"] is None  # a name that may sort otherwise: the caller takes to_json


def test_only_what_may_hide_something_is_taken_apart(spark):
    texts = ['{"a": "plain", "n": 1.50}', '{"a": "Bearer x"}', '{"api_key": {"v": 1}}', '{"a": "' + "x" * 5000 + '"}', '{"a": [[[[["sk-q"]]]]]}', '{"a": {"b": {"c": {"d": {"e": 1}}}}}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", F.parse_json("t"))
    rows = with_redacted_text(df, "got", F.col("v")).withColumn("want", F.to_json(redacted(F.col("v")))).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert rows[0]["got"] == '{"a":"plain","n":1.5}' and "[REDACTED]" in rows[1]["got"]


def test_calls_are_dealt_by_sample_for_the_join(spark):
    """One dealing in front of the judging, one behind it that grouping and join share."""
    attempts = spark.createDataFrame([("s", "A", 1, None, None, None, None, "stop", "{}")], ATTEMPT_SCHEMA)
    samples = spark.createDataFrame([("s", "CWE-1")], "sample_id string, cwe string")
    plan = phase_reports(samples, attempts, "A")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(sample_id") == 3
    assert "WriteFiles" not in plan and "Scan parquet" not in plan


def test_checked_steps_give_what_the_expressions_give(spark):
    bodies = {
        "A": ['{"non_standard_external_calls": ["f"], "data_flow_path": "p", "vulnerability_node": {"variable_name": " ", "step_location": null, "issue_description": "d", "extra": [1]}}',
              '{"confidence": 5.0, "data_flow_path": "\\u3000", "vulnerability_node": "x", "additional_context_needed": 4, "non_standard_external_calls": ["f", null]}',
              '{"confidence": 101, "z": 1}', "{", "{}"],
        "B": ['{"cwe_type": ["CWE-1", " CWE-2 "], "caller_constraint": "c", "data_flow_path": "p", "vulnerability_node": {"step_location": "s"}}', '{"cwe_type": []}', '{"cwe_type": ["a", 5], "depends_on_caller": "yes"}', "{}"],
        "C": ['{"comment": {"n": "x"}, "variable_match_score": 1e999, "step_position_score": 0.5, "dataflow_path_score": "1", "overall_consistency": "ok"}', '{"comment": " "}', "{}"],
    }
    for phase, texts in bodies.items():
        df = spark.createDataFrame([(t, " CWE-9 ") for t in texts], "body string, cwe string")
        report = normalize(phase, F.try_parse_json("body"), F.col("cwe"))
        rows = _checked(df, phase).withColumn("want", contract_errors(phase, report, F.col("body"))).select(
            "violations", "want", F.to_json("report").alias("report"), F.to_json(report).alias("whole")).collect()
        assert [r["violations"] for r in rows] == [r["want"] for r in rows]
        assert [r["report"] for r in rows] == [r["whole"] for r in rows]
