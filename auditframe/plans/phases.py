"""Phase reports from recorded model responses (X2, X4, X5, P29..P31, F9..F11, J3).

``attempts`` has a row per (sample, phase, attempt); the responses may come from
the model hook (``plans/run.py``) or from any table of that schema. Every attempt
is judged by itself: a failed call, a truncated answer, a text that does not
decode and a value that is no object are errors; the first other attempt gives the
report. A report is normalised (P29) and checked against its contract. A phase
without a valid report gets a placeholder (P30) and an issue (X5); the row of the
sample (P31) is built from whatever the three phases hold.

Nothing but a text no JSON reader takes goes through Python. Reports keep keys that
no rule names; as VARIANTs they list keys in alphabetical order.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import let
from auditframe.functions import text as T
from auditframe.functions import variant as V
from auditframe.functions.jsonfix import with_model_json_text, with_redacted_text
from auditframe.operators.contracts import NODE_FIELDS, REQUIRED, SCORES, asked_paths, broken_rules, errors_of

PHASES = ("A", "B", "C")
MAX_ATTEMPTS = 3
# Default text of a missing phase A context field, the
# undetermined marker, the placeholder descriptions and the error texts.
MISSING_CONTEXT = "模型未提供该字段"
UNDETERMINED = "无法确定"
PLACEHOLDER_DESCRIPTION = {
    "A": "阶段 A 执行失败，已使用占位结果。",
    "B": "阶段 B 执行失败，已使用占位结果。",
    "C": "阶段 C 执行失败，已使用占位结果。",
}
TRUNCATED = "model output was truncated"
NOT_JSON = "model output is not JSON"
NOT_OBJECT = "model output must be a JSON object"

MESSAGE_CHARS = 2000
OUTPUT_CHARS = 4000


def _json(value: Column) -> Column:
    """Any scalar, array or struct as a VARIANT."""
    return V.field(F.to_variant_object(F.struct(value.alias("v"))), "v")


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _with(members: Column, values: dict[str, Column]) -> Column:
    """An object's members with ``values`` put in; a NULL value leaves its key alone."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()]), lambda e: e["value"].isNotNull())
    return let(F.map_from_entries(entries), lambda new: F.map_concat(F.map_filter(members, lambda k, _: ~F.map_contains_key(new, k)), new))


def _node(node: Column, kind: Column) -> Column:
    """Node fields that are blank or no text become the undetermined marker; NULL
    for a node that has no such field."""
    members = _members(node)
    open_fields = [F.coalesce(~V.nonblank(V.field(node, f)) & V.has_field(node, f), F.lit(False)) for f in NODE_FIELDS]
    fixed = F.transform_values(members, lambda k, v: F.when(k.isin(*NODE_FIELDS) & ~V.nonblank(v), _json(F.lit(UNDETERMINED))).otherwise(v))
    return F.when(V.is_object(node, kind) & functools.reduce(Column.__or__, open_fields), F.to_variant_object(fixed))


#: The fields that ``_defaults`` looks at, by phase.
NORMALISED = {
    "A": ("confidence", "additional_context_needed", "vulnerability_node"),
    "B": ("cwe_type", "caller_constraint", "depends_on_caller", "vulnerability_node"),
    "C": ("comment",),
}


def _defaults(phase: str, at: Callable[[str], tuple[Column, Column]], cwe_default: Column | None) -> dict[str, Column]:
    """What the fields of an object become, NULL where one stays as it is; ``at``
    gives value and type name of a field."""

    def absent(name: str, value: Column) -> Column:
        return F.when(at(name)[0].isNull(), value)

    if phase == "A":
        return {
            "confidence": absent("confidence", _json(F.lit(0))),
            "additional_context_needed": absent("additional_context_needed", _json(F.lit(MISSING_CONTEXT))),
            "vulnerability_node": _node(*at("vulnerability_node")),
        }
    if phase == "B":
        cwe, kind = at("cwe_type")
        items = F.try_variant_get(cwe, "$", "array<variant>")
        listed = V.is_array(cwe, kind) & (F.size(items) > 0) & F.forall(items, lambda x: V.nonblank(x))
        joined = F.array_join(F.transform(items, lambda x: T.py_strip(V.string_value(x))), ", ")
        given = T.py_strip(F.coalesce(cwe_default if cwe_default is not None else F.lit(""), F.lit("")))
        return {
            "cwe_type": F.when(cwe.isNull(), _json(F.when(given != "", given).otherwise(UNDETERMINED))).when(listed, _json(joined)),
            "caller_constraint": absent("caller_constraint", F.parse_json(F.lit("null"))),
            "depends_on_caller": absent("depends_on_caller", _json(V.nonblank(*at("caller_constraint")))),
            "vulnerability_node": _node(*at("vulnerability_node")),
        }
    comment, kind = at("comment")
    return {"comment": F.when(V.is_object(comment, kind), _json(F.to_json(comment)))}


def normalize(phase: str, report: Column, cwe_default: Column | None = None) -> Column:
    """Omitted optional fields get their defaults; a list of CWE names becomes
    text. Other keys stay. A report that is no object stays as it is."""
    def at(name: str) -> tuple[Column, Column]:
        value = V.field(report, name)
        return value, V.vtype(value)

    return F.when(V.is_object(report), F.to_variant_object(_with(_members(report), _defaults(phase, at, cwe_default)))).otherwise(report)


def placeholder(phase: str, error_type: Column, message: Column, cwe: Column) -> Column:
    """Schema-compatible placeholder report as JSON text, keys in alphabetical order."""
    marker = F.lit(f"[PHASE_{phase}_ERROR]")
    meta = {"pipeline_placeholder": F.lit(True), "pipeline_error_type": error_type, "pipeline_error": message}
    node = F.struct(F.lit(PLACEHOLDER_DESCRIPTION[phase]).alias("issue_description"), marker.alias("step_location"), marker.alias("variable_name"))
    if phase == "A":
        fields = {"non_standard_external_calls": F.array().cast("array<string>"), "data_flow_path": marker, "vulnerability_node": node,
                  "confidence": F.lit(0), "additional_context_needed": message}
    elif phase == "B":
        fields = {"data_flow_path": marker, "vulnerability_node": node, "cwe_type": F.coalesce(F.nullif(cwe, F.lit("")), marker),
                  "depends_on_caller": F.lit(False), "caller_constraint": message}
    else:
        fields = {**dict.fromkeys(SCORES, F.lit(0).cast("double")), "overall_consistency": marker, "comment": F.lit(PLACEHOLDER_DESCRIPTION[phase])}
    values = sorted((fields | meta).items())
    return F.to_json(F.struct(*[v.alias(k) for k, v in values]), {"ignoreNullFields": "false"})


def judged_attempts(attempts: DataFrame) -> DataFrame:
    """X4 per attempt: ``body`` (JSON text of the decoded object) or the attempt's
    ``error_type``, redacted ``message`` and, where it gave any, ``model_output``."""
    truncated = F.col("finish_reason") == "length"
    called = F.col("error_type").isNull() & ~F.coalesce(truncated, F.lit(False))
    decoded = with_model_json_text(attempts, "_text", F.coalesce("model_output", F.lit("")), called)
    is_object = F.coalesce(F.col("_text").startswith("{"), F.lit(False))
    kind = (
        F.when(F.col("error_type").isNotNull(), F.col("error_type")).when(truncated, "ValueError")
        .when(F.col("_text").isNull(), "JSONDecodeError").when(~is_object, "ValueError"))
    said = (
        F.when(F.col("error_type").isNotNull(), T.safe_diagnostic_text(F.col("message"), MESSAGE_CHARS))
        .when(truncated, TRUNCATED).when(F.col("_text").isNull(), NOT_JSON).when(~is_object, NOT_OBJECT))
    shown = F.when(called & ~is_object & F.col("model_output").isNotNull(), T.safe_diagnostic_text(F.col("model_output"), OUTPUT_CHARS))
    return decoded.select(
        "sample_id", "phase", "attempt", F.when(is_object, F.col("_text")).alias("body"), kind.alias("error_type"), said.alias("message"),
        "status_code", F.when(F.col("request_id") != "", T.safe_diagnostic_text(F.col("request_id"), 500)).alias("request_id"),
        "finish_reason", shown.alias("model_output"))


_ATTEMPT = ("attempt", "error_type", "message", "status_code", "request_id", "finish_reason", "model_output")


def resolved_calls(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """X4 per (sample, phase): ``body`` of the first usable attempt, ``attempts_used``,
    and the errors of the attempts before it in order. An attempt number above
    ``max_attempts`` is an error: a call has no more, so its list is bounded."""
    judged = judged_attempts(attempts)
    number = F.when(F.col("attempt").between(1, max_attempts), F.col("attempt")).otherwise(
        F.raise_error(F.format_string("attempt %d of sample %s is not in 1..%d", "attempt", "sample_id", F.lit(max_attempts))).cast("bigint"))
    usable = F.col("body").isNotNull()
    # the Python function hides how its input was dealt: by sample, as joins want it
    tasks = int(attempts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    calls = judged.withColumn("attempt", number).repartition(tasks, "sample_id").groupBy("sample_id", "phase").agg(
        F.min(F.when(usable, F.col("attempt"))).alias("winner"),
        F.min_by("body", F.when(usable, F.col("attempt"))).alias("body"),
        F.sort_array(F.collect_list(F.when(~usable, F.struct(*_ATTEMPT)))).alias("failed"))
    before = F.filter("failed", lambda a: F.col("winner").isNull() | (a["attempt"] < F.col("winner")))
    return calls.select("sample_id", "phase", "body", before.alias("attempts"), F.coalesce("winner", F.size("failed").cast("bigint")).alias("attempts_used"))


def _call_message(phase: Column, attempts: Column) -> Column:
    last = F.get(attempts, F.size(attempts) - 1)
    context = F.array_join(F.array_compact(F.array(
        F.when(last["status_code"].isNotNull(), F.concat(F.lit("HTTP "), last["status_code"].cast("string"))),
        F.when(last["request_id"].isNotNull(), F.concat(F.lit("request_id="), last["request_id"])))), ", ")
    return F.concat(
        F.lit("phase "), phase, F.lit(" failed after "), F.size(attempts).cast("string"), F.lit(" attempts; last error: "), last["error_type"],
        F.lit(": "), last["message"], F.when(context != "", F.concat(F.lit(" ("), context, F.lit(")"))).otherwise(""))


def _checked(calls: DataFrame, phase: str) -> DataFrame:
    """P29 and F9..F11 of the calls of a phase: ``report``, the VARIANT of a normalised
    report, and ``violations``.

    Each step is a column of its own, so that it is worked out once a row and its code
    stays small enough to be compiled. Fields are taken out of the decoded report once;
    the report is put together anew only where normalisation changes one."""
    paths = asked_paths(phase)
    top = [p[0] for p in paths if len(p) == 1]
    # a body begins with a brace: what decodes is an object
    out = calls.withColumn("given", F.try_parse_json("body"))
    out = out.withColumns({f"_v_{f}": V.field(F.col("given"), f) for f in top})
    out = out.withColumns({f"_t_{f}": V.vtype(F.col(f"_v_{f}")) for f in NORMALISED[phase]})
    new = _defaults(phase, lambda f: (F.col(f"_v_{f}"), F.col(f"_t_{f}")), F.col("cwe"))
    out = out.withColumns({f"_new_{f}": F.when(F.col("given").isNotNull(), v) for f, v in new.items()})
    at = {p: f"_at_{'_'.join(p)}" for p in paths}
    out = out.withColumns({at[(f,)]: F.coalesce(f"_new_{f}", f"_v_{f}") if f in new else F.col(f"_v_{f}") for f in top})
    out = out.withColumns({at[p]: V.field(F.col(at[p[:-1]]), p[-1]) for p in paths if len(p) > 1})
    out = out.withColumns({f"{name}_kind": V.vtype(F.col(name)) for name in at.values()})
    out = out.withColumns({f"{name}_string": V.string_value(F.col(name), F.col(f"{name}_kind")) for name in at.values()})
    whole = F.col("given"), F.when(F.col("given").isNotNull(), F.lit("OBJECT")), F.lit(None).cast("string")
    broken = broken_rules(phase, lambda p: tuple(F.col(at[p] + x) for x in ("", "_kind", "_string")) if p else whole, F.col("body"))
    changed = functools.reduce(Column.__or__, [F.col(f"_new_{f}").isNotNull() for f in new])
    rebuilt = F.to_variant_object(_with(_members(F.col("given")), {f: F.col(f"_new_{f}") for f in new}))
    out = out.withColumn("_broken", F.when(F.col("body").isNotNull(), broken).otherwise("")).withColumn("violations", errors_of(F.col("_broken")))
    return out.withColumn("report", F.when(changed, rebuilt).otherwise(F.col("given")))


def _report_text(phase: str) -> Column:
    """``to_json`` of a valid report of ``_checked``, from its fields."""
    def text(*path: str) -> Column:
        name = f"_at_{'_'.join(path)}"
        return V.json_text(F.col(name), F.col(f"{name}_kind"), F.col(f"{name}_string"))

    texts = {f: text(f) for f in REQUIRED[phase]}
    if "vulnerability_node" in texts:
        only = F.col("_at_vulnerability_node_kind") == f"OBJECT<{', '.join(f'{f}: STRING' for f in NODE_FIELDS)}>"
        parts = [F.concat(F.lit(f'"{f}":'), text("vulnerability_node", f)) for f in NODE_FIELDS]
        texts["vulnerability_node"] = F.when(only, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))).otherwise(texts["vulnerability_node"])
    return V.object_text(_members(F.col("report")), texts)


def phase_reports(samples: DataFrame, attempts: DataFrame, phase: str) -> DataFrame:
    """One row per sample of ``samples`` (sample_id, cwe) that called ``phase``.

    ``state`` is ok, call_failed or invalid; ``report`` the JSON text of the valid
    report or of the placeholder; ``violations`` all broken rules; ``issue`` the X5
    record (NULL when ok). Judging and checking cost far more than the bytes they
    read, so the calls are dealt by sample over the session's shuffle partitions,
    whatever the files' cuts and however small the rows; the join keeps that dealing
    (a broadcast of small calls would leave the work to the samples' one scan).

    The columns are steps that name each other: write them (``recorded_reports``)
    before a filter names one, which would be worked out anew below the join."""
    tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = attempts.where(F.col("phase") == phase).repartition(tasks, "sample_id")
    return _reported(resolved_calls(dealt).join(samples.select("sample_id", "cwe").hint("merge"), "sample_id"), phase)


def _reported(calls: DataFrame, phase: str) -> DataFrame:
    """The columns of ``phase_reports`` for resolved calls with their sample's ``cwe``."""
    called = F.col("body").isNotNull()
    state = F.when(~called, "call_failed").when(F.size("violations") > 0, "invalid").otherwise("ok")
    error_type = F.when(F.col("state") == "call_failed", "ModelCallError").when(F.col("state") == "invalid", "PhaseOutputValidationError")
    said = F.when(F.col("state") == "call_failed", _call_message(F.lit(phase), F.col("attempts"))).when(
        F.col("state") == "invalid", F.concat(F.lit(f"phase {phase} output validation failed: ValueError: "), F.get("violations", F.lit(0))))
    out = _checked(calls, phase).withColumn("state", state).withColumn("error_type", error_type).withColumn("_said", said)
    out = out.withColumn("message", F.when(F.col("state") != "ok", T.safe_error_message(F.col("_said")))).withColumn(
        "_text", F.when(F.col("state") == "ok", _report_text(phase)))
    last = F.get("attempts", F.size("attempts") - 1)
    cause = F.when(F.col("state") == "call_failed", F.struct(last["error_type"].alias("error_type"), T.safe_error_message(last["message"]).alias("message"))).otherwise(
        F.struct(F.lit("ValueError").alias("error_type"), T.safe_error_message(F.get("violations", F.lit(0))).alias("message")))
    # the arguments of a Python function are evaluated for every row: only what is
    # shown goes in
    out = with_redacted_text(out, "_rejected", F.when(F.col("state") == "invalid", F.col("given")))
    issue = F.struct(
        "sample_id", F.lit(phase).alias("phase"), "error_type", "message",
        F.struct(
            F.when(F.col("state") == "call_failed", F.col("attempts")).alias("attempts"),
            F.when(F.col("state") == "invalid", F.col("_rejected")).alias("model_output"),
            F.array(cause).alias("cause_chain")).alias("details"))
    failed = F.col("state") != "ok"
    shown = F.when(failed, placeholder(phase, F.col("error_type"), F.col("message"), F.col("cwe"))).otherwise(
        F.coalesce(F.col("_text"), F.to_json("report")))
    return out.select(
        "sample_id", F.lit(phase).alias("phase"), "state", "attempts_used", shown.alias("report"), "violations", F.when(failed, issue).alias("issue"))


def all_phase_reports(samples: DataFrame, attempts: DataFrame) -> DataFrame:
    """X2 for the three phases of recorded responses."""
    out = [phase_reports(samples, attempts, p) for p in PHASES]
    return out[0].unionByName(out[1]).unionByName(out[2])


def issues_of(reports: DataFrame) -> DataFrame:
    """The issue records of the phases that failed."""
    return reports.where(F.col("issue").isNotNull()).select("issue.*")


def violations_of(reports: DataFrame) -> DataFrame:
    """F9..F11: every broken rule of a decoded report, in the contract's order."""
    return reports.select("sample_id", "phase", F.posexplode("violations").alias("position", "violation"))


def wide_reports(samples: DataFrame, reports: DataFrame) -> DataFrame:
    """Samples with their reports as columns ``report_A`` .. (JSON texts). The
    long table is folded by one aggregate per sample, so one shuffle joins all; texts are
    dealt first, since folding them before would sort them for nothing."""
    phases = [F.max(F.when(F.col("phase") == p, F.col("report"))).alias(f"report_{p}") for p in PHASES]
    return samples.join(reports.repartition("sample_id").groupBy("sample_id").agg(*phases), "sample_id")


def _s(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def flatten(full: DataFrame) -> DataFrame:
    """Sample + A + B + C (JSON texts) as the 26-column result row."""
    parsed = full.withColumns({f"_{p}": F.parse_json(f"report_{p}") for p in PHASES})
    a, b, c = F.col("_A"), F.col("_B"), F.col("_C")
    return parsed.select(
        "sample_id", "commit_id", "project", "cwe",
        F.to_json(V.field(a, "non_standard_external_calls")).alias("phase_a_non_standard_external_calls"),
        _s(a, "$.data_flow_path").alias("phase_a_data_flow_path"),
        _s(a, "$.vulnerability_node.variable_name").alias("phase_a_vulnerability_variable"),
        _s(a, "$.vulnerability_node.step_location").alias("phase_a_vulnerability_step_location"),
        _s(a, "$.vulnerability_node.issue_description").alias("phase_a_vulnerability_issue_description"),
        F.try_variant_get(a, "$.confidence", "bigint").alias("phase_a_confidence"),
        _s(a, "$.additional_context_needed").alias("phase_a_additional_context_needed"),
        F.col("report_A").alias("phase_a_raw"),
        _s(b, "$.data_flow_path").alias("phase_b_data_flow_path"),
        _s(b, "$.vulnerability_node.variable_name").alias("phase_b_vulnerability_variable"),
        _s(b, "$.vulnerability_node.step_location").alias("phase_b_vulnerability_step_location"),
        _s(b, "$.vulnerability_node.issue_description").alias("phase_b_vulnerability_issue_description"),
        _s(b, "$.cwe_type").alias("phase_b_cwe_type"),
        F.try_variant_get(b, "$.depends_on_caller", "boolean").alias("phase_b_depends_on_caller"),
        _s(b, "$.caller_constraint").alias("phase_b_caller_constraint"),
        F.col("report_B").alias("phase_b_raw"),
        F.try_variant_get(c, "$.variable_match_score", "double").alias("phase_c_variable_match_score"),
        F.try_variant_get(c, "$.step_position_score", "double").alias("phase_c_step_position_score"),
        F.try_variant_get(c, "$.dataflow_path_score", "double").alias("phase_c_dataflow_path_score"),
        _s(c, "$.overall_consistency").alias("phase_c_overall_consistency"),
        _s(c, "$.comment").alias("phase_c_comment"),
        F.col("report_C").alias("phase_c_raw"),
    )
