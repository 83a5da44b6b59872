"""Model-response decoding, contracts, normalisation and the three-phase run."""

import json

from pyspark.sql import functions as F

from auditframe.functions.jsonfix import repair_json_text
from auditframe.operators.contracts import contract_errors
from auditframe.plans import inference as X
from auditframe.plans.run import normalize, run_three_phases
import stub_model as stub_module
from pyspark import cloudpickle
from stub_model import stub_model

cloudpickle.register_pickle_by_value(stub_module)  # the workers do not have the tests' folder


def test_repair_rules():
    assert json.loads(repair_json_text('{"a": 1, "b": ", }",}')) == {"a": 1, "b": ", }"}
    assert json.loads(repair_json_text('{"a": [1, 2]')) == {"a": [1, 2]}
    assert json.loads(repair_json_text('{"a": 1} {"a": 2} {"a": 3}')) == {"a": 3}
    assert repair_json_text('{"a": NaN}') is None


def test_decode_in_spark(spark):
    from auditframe.functions.jsonfix import decode_model_json
    df = spark.createDataFrame([('{"a":1}{"a":2}',), ('{"a":1,}',), ('{"ok": true}',)], "t string")
    got = [r[0] for r in df.select(F.to_json(decode_model_json(F.col("t")))).collect()]
    assert got == ['{"a":2}', '{"a":1}', '{"ok":true}']


def test_contract_errors(spark):
    a_missing = {"non_standard_external_calls": [], "data_flow_path": "p", "confidence": 5,
                 "additional_context_needed": None,
                 "vulnerability_node": {"step_location": "s", "issue_description": "d"}}
    c_missing = {"variable_match_score": 1, "step_position_score": 1, "dataflow_path_score": 1, "comment": "x"}
    df = spark.createDataFrame([(json.dumps(a_missing), json.dumps(c_missing))], "a string, c string")
    r = df.select(contract_errors("A", F.parse_json("a")).alias("ea"), contract_errors("C", F.parse_json("c")).alias("ec")).collect()[0]
    assert any("variable_name" in e for e in r["ea"])
    assert any("overall_consistency" in e for e in r["ec"])


def test_normalize_defaults(spark):
    a = {"non_standard_external_calls": [], "data_flow_path": "p",
         "vulnerability_node": {"variable_name": "v", "step_location": "s", "issue_description": "d"}}
    b = {"data_flow_path": "p", "vulnerability_node": {"variable_name": None, "step_location": " ", "issue_description": "d"},
         "cwe_type": ["CWE-190", "CWE-125"]}
    df = spark.createDataFrame([(json.dumps(a), json.dumps(b), "CWE-125")], "a string, b string, cwe string")
    r = df.select(F.to_json(normalize("A", F.parse_json("a"))).alias("a"),
                  F.to_json(normalize("B", F.parse_json("b"), F.col("cwe"))).alias("b")).collect()[0]
    na, nb = json.loads(r["a"]), json.loads(r["b"])
    assert na["confidence"] == 0 and na["additional_context_needed"] == "模型未提供该字段"
    assert nb["cwe_type"] == "CWE-190, CWE-125" and nb["depends_on_caller"] is False
    assert nb["vulnerability_node"]["variable_name"] == "无法确定" and nb["vulnerability_node"]["step_location"] == "无法确定"


def test_three_phase_run(spark):
    rows = [(f"s_{i}", f"int f_{i}(int x) {{ return x; }}", f"int f_{i}(int x) {{ return x + 1; }}", "fix", "NA",
             "abc", "p", "CWE-79") for i in range(1, 16)]
    samples = spark.createDataFrame(rows, "sample_id string, func_before string, func_after string, commit_msg string, "
                                          "bug_description string, commit_id string, project string, cwe string")
    res, iss = run_three_phases(samples, stub_model)
    out = {r["sample_id"]: r for r in res.collect()}
    assert len(out) == 15
    assert out["s_7"]["phase_a_data_flow_path"] == "[PHASE_A_ERROR]"
    assert out["s_1"]["phase_a_data_flow_path"] == "x -> f_1 -> return"
    assert out["s_5"]["phase_c_step_position_score"] == 0.0 and out["s_5"]["phase_c_comment"] == '{"note":"stub"}'
    issues = iss.collect()
    assert sorted(r["sample_id"] for r in issues) == ["s_14", "s_7"] and {r["phase"] for r in issues} == {"A"}


def test_upsert_and_rerun(spark):
    existing = spark.createDataFrame([("one", "a", 1), ("two", "b", 2)], "sample_id string, comment string, position bigint")
    updates = spark.createDataFrame([("one", "c", 1), ("three", "d", 2)], "sample_id string, comment string, version bigint")
    got = sorted((r["position"], r["sample_id"], r["comment"]) for r in X.upsert(existing, updates).collect())
    assert got == [(1, "one", "c"), (2, "two", "b"), (3, "three", "d")]
    issues = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("[RUN]", 4)], "sample_id string, seen bigint")
    assert [r["sample_id"] for r in X.rerun_ids(issues).orderBy("rerun_order").collect()] == ["b", "a"]
    s = X.rerun_summary(issues).collect()[0]
    assert (s["issues"], s["failed_samples"]) == (4, 2)


def test_calls_and_repair(spark):
    import datetime as dt

    outputs = ['{"a": 1,}', '```json\n{"b": [2\n```', "oops", '{"c": 3} {"d": 4}', None]
    rows = [("s1", "A", dt.datetime(2024, 1, 1, 0, 0, i), i, None if o else "E", "m", 200, "length" if i == 1 else "stop", o)
            for i, o in enumerate(outputs)]
    schema = ("sample_id string, phase string, event_ts timestamp, event_id bigint, error_type string, "
              "message string, status_code int, finish_reason string, model_output string")
    got = X.resolve_attempts(X.number_attempts(spark.createDataFrame(rows, schema), 2)).orderBy("call_no").collect()
    assert [(r["call_no"], r["winning_attempt"], r["payload"]) for r in got] == [(1, 1, '{"a":1}'), (2, 2, '{"d":4}'), (3, None, None)]


def test_blank_and_redaction(spark):
    from auditframe.functions.jsonfix import redact_text

    df = spark.createDataFrame([('{"overall_consistency": "\\t\\n"}',)], "c string")
    errors = df.select(contract_errors("C", F.parse_json("c")).alias("e")).first()["e"]
    assert any("overall_consistency must be a non-empty string" in e for e in errors)
    shown = redact_text('{"api_key": {"x": 1}, "l": ["Bearer abc", {"t": "sk-abcdef"}], "n": 1.5}')
    assert json.loads(shown) == {"api_key": "[REDACTED]", "l": ["Bearer [REDACTED]", {"t": "sk-[REDACTED]"}], "n": 1.5}
    assert redact_text("no json Bearer abc") == '"no json Bearer [REDACTED]"'


def test_attempts_with_secret(spark):
    import datetime as dt
    rows = [("s1", "A", dt.datetime(2024, 1, 1, 0, 0, i), i, "APIError",
             "HTTP 502 body Bearer abc.def sk-SECRET123 api_key=hunter2", 502, "stop", None) for i in (1, 2)]
    schema = ("sample_id string, phase string, event_ts timestamp, event_id bigint, error_type string, "
              "message string, status_code int, finish_reason string, model_output string")
    res = X.resolve_attempts(X.number_attempts(spark.createDataFrame(rows, schema))).collect()[0]
    assert not res["resolved"] and res["attempts_used"] == 2
    assert "SECRET123" not in res["issue_message"] and "hunter2" not in res["issue_message"]
    assert "abc.def" not in res["issue_message"] and "HTTP 502" in res["issue_message"]


def test_rerun_job(spark):
    from auditframe.plans.run import rerun

    rows = [(f"s_{i}", f"int f_{i}(int x) {{ return x; }}", f"int f_{i}(int x) {{ return x + 1; }}", "fix", "NA",
             "abc", "p", "CWE-79") for i in range(1, 9)]
    samples = spark.createDataFrame(rows, "sample_id string, func_before string, func_after string, commit_msg string, "
                                          "bug_description string, commit_id string, project string, cwe string")
    first, _ = run_three_phases(samples, stub_model)
    existing = first.withColumn("position", F.regexp_extract("sample_id", r"(\d+)$", 1).cast("bigint"))
    log = spark.createDataFrame([(1, "s_7", None), (2, "[RUN]", None), (3, "s_3", None)],
                                "line bigint, sample_id string, reason string")
    results, issues = rerun(samples, log, stub_model, existing)
    got = {r["sample_id"]: r["position"] for r in results.collect()}
    assert len(got) == 8 and got["s_7"] == 7 and got["s_3"] == 3
    assert [r["sample_id"] for r in issues.collect()] == ["s_7"]


def test_a_run_goes_on_behind_what_is_done(spark, tmp_path):
    """The first run fails in the middle; the second calls the model only for the rest."""
    from auditframe.plans.run import current_run, run_resumable

    flag, calls, root = str(tmp_path / "works"), str(tmp_path / "calls"), str(tmp_path / "run")
    stub = stub_model

    def factory():
        import os

        model = stub()

        def call(batch):
            if not os.path.exists(flag) and "s_3" in set(batch["sample_id"]):
                raise RuntimeError("the model is away")
            with open(calls, "a") as f:
                f.writelines(f"{s} {p}\n" for s, p in zip(batch["sample_id"], batch["phase"]))
            return model(batch)

        return call

    rows = [(f"s_{i}", f"int f_{i}(int x) {{ return x; }}", f"int f_{i}(int x) {{ return x + 1; }}", "fix", "NA", "abc", "p", "CWE-79") for i in range(1, 11)]
    samples = spark.createDataFrame(rows, "sample_id string, func_before string, func_after string, commit_msg string, "
                                          "bug_description string, commit_id string, project string, cwe string")
    try:
        run_resumable(samples, factory, root, slices=4)
        raise AssertionError("the first run must fail")
    except AssertionError:
        raise
    except Exception as e:
        assert "the model is away" in str(e)
    assert current_run(spark, root) is None
    open(flag, "w").close()
    run_resumable(samples, factory, root, slices=4)
    results, documents = current_run(spark, root)
    assert results.count() == 10 and documents.where("phase = 'combined'").count() == 10
    made = open(calls).read().split("\n")[:-1]
    assert len(made) == len(set(made)) == 30
    run_resumable(samples, factory, root, slices=4)
    assert open(calls).read().split("\n")[:-1] == made
    assert current_run(spark, root)[0].count() == 10
