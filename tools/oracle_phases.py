"""DuckDB oracle SQL for the phase reports over recorded responses.

The responses are declared again, each attempt's text is judged with DuckDB's JSON
functions, and reports are put together key by key (in alphabetical order)."""

from __future__ import annotations

PHASES = ("A", "B", "C")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _node(r: str, text: int, lacks: int, blank: int) -> str:
    return f"""CASE {r} WHEN {text} THEN '"x"' WHEN {lacks} THEN '{{"step_location": "line 1", "issue_description": "d"}}'
      WHEN {blank} THEN '{{"variable_name": " ", "step_location": null, "issue_description": "d", "extra": [1, 2]}}'
      ELSE '{{"variable_name": "x", "step_location": "line 1", "issue_description": "' || pri || '"}}' END"""


def _when(r: str, cases: dict[int, str], other: str) -> str:
    return f"CASE {r} " + " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in cases.items()) + f" ELSE {other} END"


_A = f"""CASE k % 23 WHEN 17 THEN '{{"confidence": 3}}' ELSE '{{"non_standard_external_calls": '
  || {_when("k % 23", {8: '["log", 7]'}, "'[\"f_' || k || '\", \"log\"]'")}
  || ', "data_flow_path": ' || {_when("k % 23", {4: '"  "', 20: '5'}, "'\"x -> f_' || k || ' -> return\"'")}
  || ', "vulnerability_node": ' || {_node("k % 23", 5, 6, 7)}
  || {_when("k % 23", {1: '', 2: ', "confidence": 101', 3: ', "confidence": true', 19: ', "confidence": 5.0'}, "', \"confidence\": ' || k % 101")}
  || {_when("k % 23", {9: '', 21: ', "additional_context_needed": 4'}, "', \"additional_context_needed\": null'")}
  || ', "reviewer": "team ' || k % 7 || '"}}' END"""
_B = f"""'{{"data_flow_path": ' || {_when("k % 19", {11: 'null'}, _q('"a -> b"'))}
  || ', "vulnerability_node": ' || {_node("k % 19", 9, 10, 13)}
  || {_when("k % 19", {1: '', 2: ', "cwe_type": ["CWE-1", " CWE-2 "]', 3: ', "cwe_type": []', 4: ', "cwe_type": ["CWE-1", 5]'}, "', \"cwe_type\": \"CWE-' || k % 200 || '\"'")}
  || {_when("k % 19", {5: '', 6: '', 7: ', "depends_on_caller": "yes"'}, "', \"depends_on_caller\": ' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END")}
  || {_when("k % 19", {6: '', 8: ', "caller_constraint": 3', 5: ', "caller_constraint": "caller checks"'}, _q(', "caller_constraint": null'))}
  || CASE k % 19 WHEN 7 THEN ', "api_key": {{"v": "k' || k || '"}}, "notes": ["Bearer abc' || k || '", {{"n": "sk-zz' || k || ' end"}}]' ELSE '' END || '}}'"""
_C = f"""'{{"variable_match_score": ' || ['0', '0.25', '0.5', '0.75', '1'][k % 5 + 1] || ', "step_position_score": 0.5, "dataflow_path_score": '
  || {_when("k % 17", {1: '"0.5"', 2: 'true'}, "'1'")} || ', "overall_consistency": ' || {_when("k % 17", {3: '" "'}, _q('"consistent"'))}
  || CASE k % 17 WHEN 4 THEN ', "comment": {{"note": "n' || k || '", "tags": [1, 2]}}' WHEN 5 THEN '' ELSE ', "comment": "ok"' END || '}}'"""

#: Responses, and the JSON text of each usable one.
RESPONSES = f"""
o AS (
  SELECT o_orderkey AS k, o_orderpriority AS pri, c_name AS project, 'CWE-' || (c_nationkey + 100) AS cwe, md5(CAST(o_orderkey AS VARCHAR)) AS commit_id
  FROM orders JOIN customer ON o_custkey = c_custkey
), b AS (
  SELECT *, 'A' AS phase, k % 23 AS r, {_A} AS body FROM o
  UNION ALL SELECT *, 'B', k % 19 + 100, {_B} FROM o
  UNION ALL SELECT *, 'C', k % 17 + 200, {_C} FROM o
), t AS (
  SELECT *, unnest(range(1, CASE WHEN r = 12 THEN 3 WHEN r IN (13, 14, 15, 16, 112, 207) THEN 4 ELSE 2 END)) AS attempt FROM b
), a AS (
  SELECT *, (r = 12 AND attempt = 1) OR r = 13 AS lost, r IN (14, 207) AS cut,
    CASE r WHEN 10 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 11 THEN left(body, length(body) - 1) || ' ,}}' WHEN 15 THEN 'not json {{'
      WHEN 16 THEN '[1, 2]' WHEN 18 THEN '{{"draft": 1}} ' || body WHEN 22 THEN left(body, length(body) - 1)
      WHEN 206 THEN ' ```JSON' || chr(10) || body || '```' || chr(10) ELSE body END AS answer FROM t
), j AS (
  SELECT *, coalesce(nullif(regexp_extract(trim(answer, ' ' || chr(10)), '(?is)^```(?:json)?[ \\t\\r\\n]+(.*?)\\s*```$', 1), ''), answer) AS bare,
    regexp_replace(bare, ',\\s*}}$', '}}') AS tidy, regexp_replace(bare, '^\\{{"draft": 1\\}} ', '') AS latest,
    CASE WHEN lost OR cut OR r = 112 THEN NULL WHEN json_valid(bare) THEN bare WHEN json_valid(tidy) THEN tidy
      WHEN json_valid(bare || '}}') THEN bare || '}}' WHEN json_valid(latest) THEN latest END AS value,
    CASE WHEN json_type(value) = 'OBJECT' THEN value END AS object
  FROM a
), e AS (
  SELECT *,
    CASE WHEN lost THEN 'APITimeoutError' WHEN r = 112 THEN 'APIConnectionError' WHEN cut THEN 'ValueError' WHEN value IS NULL THEN 'JSONDecodeError' ELSE 'ValueError' END AS kind,
    CASE WHEN lost THEN 'timeout after 120 s, Bearer [REDACTED]' WHEN r = 112 THEN 'connection reset' WHEN cut THEN 'model output was truncated'
      WHEN value IS NULL THEN 'model output is not JSON' ELSE 'model output must be a JSON object' END AS said,
    CASE WHEN lost THEN ' (HTTP 504, request_id=req-' || k || ')' ELSE '' END AS context,
    concat_ws('|', attempt, kind, said, CASE WHEN lost THEN '504|req-' || k END, CASE WHEN NOT (lost OR r = 112) THEN CASE WHEN cut THEN 'length' ELSE 'stop' END END,
      CASE WHEN NOT (lost OR cut OR r = 112) THEN answer END) AS line
  FROM j
), c AS (
  SELECT k, phase, any_value(pri) AS pri, any_value(cwe) AS cwe, any_value(r) AS r, min(attempt) FILTER (WHERE object IS NOT NULL) AS win,
    arg_min(object, attempt) FILTER (WHERE object IS NOT NULL) AS v, count(*) AS made,
    string_agg(line, ' / ' ORDER BY attempt) AS lines, arg_max(kind, attempt) AS kind, arg_max(said, attempt) AS said, arg_max(context, attempt) AS context
  FROM e GROUP BY k, phase
)"""


def _text(path: str, name: str, phase: str) -> str:
    """Violation of a non-empty string, where the field is."""
    return (f"CASE WHEN json_type(n, '{path}') IS NOT NULL AND NOT coalesce(json_type(n, '{path}') = 'VARCHAR' AND trim(n->>'{path}') <> '', false) "
            f"THEN 'phase {phase} {name} must be a non-empty string' END")


def _kind(path: str, kinds: tuple[str, ...], says: str, phase: str) -> str:
    listed = ", ".join(f"'{k}'" for k in kinds)
    return f"CASE WHEN json_type(n, '{path}') NOT IN ({listed}) THEN 'phase {phase} {says}' END"


def _missing(path: str, names: tuple[str, ...], says: str, phase: str) -> str:
    absent = "list_filter([" + ", ".join(f"CASE WHEN json_type(n, '{path}.{f}') IS NULL THEN '{f}' END" for f in names) + "], lambda x: x IS NOT NULL)"
    return (f"CASE WHEN json_type(n, '{path}') = 'OBJECT' AND len({absent}) > 0 THEN 'phase {phase} {says}[''' "
            f"|| array_to_string({absent}, ''', ''') || ''']' END")


_NODE_NAMES = ("issue_description", "step_location", "variable_name")


def _node_rules(phase: str) -> list[str]:
    return [
        f"CASE WHEN json_type(n, '$.vulnerability_node') <> 'OBJECT' THEN 'phase {phase} vulnerability_node must be a JSON object' END",
        _missing("$.vulnerability_node", _NODE_NAMES, "vulnerability_node is missing fields: ", phase),
        *[_text(f"$.vulnerability_node.{f}", f, phase) for f in _NODE_NAMES],
    ]


_RULES = {
    "A": [
        _missing("$", ("additional_context_needed", "confidence", "data_flow_path", "non_standard_external_calls", "vulnerability_node"), "output is missing fields: ", "A"),
        "CASE WHEN json_type(n, '$.non_standard_external_calls') IS NOT NULL AND json_type(n, '$.non_standard_external_calls[1]') <> 'VARCHAR' "
        "THEN 'phase A non_standard_external_calls must be a string array' END",
        _text("$.data_flow_path", "data_flow_path", "A"), *_node_rules("A"),
        _kind("$.additional_context_needed", ("VARCHAR", "NULL"), "additional_context_needed must be a string or null", "A"),
        _kind("$.confidence", ("UBIGINT", "BIGINT"), "confidence must be an integer", "A"),
        "CASE WHEN json_type(n, '$.confidence') IN ('UBIGINT', 'BIGINT') AND CAST(n->>'$.confidence' AS BIGINT) NOT BETWEEN 0 AND 100 THEN 'phase A confidence must be in [0, 100]' END",
    ],
    "B": [
        _missing("$", ("caller_constraint", "cwe_type", "data_flow_path", "depends_on_caller", "vulnerability_node"), "output is missing fields: ", "B"),
        _text("$.data_flow_path", "data_flow_path", "B"), _text("$.cwe_type", "cwe_type", "B"), *_node_rules("B"),
        _kind("$.depends_on_caller", ("BOOLEAN",), "depends_on_caller must be boolean", "B"),
        _kind("$.caller_constraint", ("VARCHAR", "NULL"), "caller_constraint must be a string or null", "B"),
    ],
    "C": [
        _missing("$", ("comment", "dataflow_path_score", "overall_consistency", "step_position_score", "variable_match_score"), "output is missing fields: ", "C"),
        *[_kind(f"$.{f}", ("UBIGINT", "BIGINT", "DOUBLE"), f"{f} must be numeric", "C") for f in ("variable_match_score", "step_position_score", "dataflow_path_score")],
        _text("$.overall_consistency", "overall_consistency", "C"),
        "CASE WHEN json_type(n, '$.comment') IS NOT NULL AND json_type(n, '$.comment') <> 'OBJECT' AND trim(n->>'$.comment') = '' THEN 'phase C comment must be a non-empty string' END",
    ],
}


def _normal_node() -> str:
    """The node with the undetermined marker, keys in order; not an object: as it is."""
    fields = []
    for f in ("extra", *_NODE_NAMES):
        value = f"CAST(json_extract(v, '$.vulnerability_node.{f}') AS VARCHAR)"
        if f != "extra":
            value = (f"CASE WHEN coalesce(json_type(v, '$.vulnerability_node.{f}') = 'VARCHAR' AND trim(v->>'$.vulnerability_node.{f}') <> '', false) "
                     f"THEN {value} ELSE '\"无法确定\"' END")
        fields.append(f"CASE WHEN json_type(v, '$.vulnerability_node.{f}') IS NOT NULL THEN '\"{f}\":' || {value} END")
    listed = ", ".join(fields)
    return (f"CASE WHEN json_type(v, '$.vulnerability_node') = 'OBJECT' THEN '{{' || concat_ws(',', {listed}) || '}}' "
            f"ELSE CAST(json_extract(v, '$.vulnerability_node') AS VARCHAR) END")


def _keys(values: dict[str, str]) -> str:
    """An object of the present values (JSON texts), keys in order."""
    return "'{' || concat_ws(',', " + ", ".join(f"'\"{k}\":' || {v}" for k, v in sorted(values.items())) + ") || '}'"


def _get(name: str) -> str:
    return f"CAST(json_extract(v, '$.{name}') AS VARCHAR)"


_NORMAL = {
    "A": _keys({
        "additional_context_needed": f"coalesce({_get('additional_context_needed')}, '\"模型未提供该字段\"')", "confidence": f"coalesce({_get('confidence')}, '0')",
        "data_flow_path": _get("data_flow_path"), "non_standard_external_calls": _get("non_standard_external_calls"), "reviewer": _get("reviewer"),
        "vulnerability_node": _normal_node()}),
    "B": _keys({
        "api_key": _get("api_key"), "caller_constraint": f"coalesce({_get('caller_constraint')}, 'null')",
        "cwe_type": f"CASE WHEN r = 102 THEN '\"CWE-1, CWE-2\"' ELSE coalesce({_get('cwe_type')}, '\"' || cwe || '\"') END", "data_flow_path": _get("data_flow_path"),
        "depends_on_caller": f"coalesce({_get('depends_on_caller')}, CASE WHEN coalesce(trim(v->>'$.caller_constraint'), '') <> '' THEN 'true' ELSE 'false' END)",
        "notes": _get("notes"), "vulnerability_node": _normal_node()}),
    "C": _keys({
        "comment": "CASE WHEN json_type(v, '$.comment') = 'OBJECT' THEN CAST(to_json(CAST(json_extract(v, '$.comment') AS VARCHAR)) AS VARCHAR) ELSE " + _get("comment") + " END",
        "dataflow_path_score": _get("dataflow_path_score"), "overall_consistency": _get("overall_consistency"),
        "step_position_score": _get("step_position_score"), "variable_match_score": _get("variable_match_score")}),
}
_DESCRIBED = {p: f"阶段 {p} 执行失败，已使用占位结果。" for p in PHASES}


def _placeholder(p: str) -> str:
    marker = f'"[PHASE_{p}_ERROR]"'
    said = "CAST(to_json(message) AS VARCHAR)"
    node = _q(f'{{"issue_description":"{_DESCRIBED[p]}","step_location":{marker},"variable_name":{marker}}}')
    values = {"pipeline_error": said, "pipeline_error_type": "'\"' || error_type || '\"'", "pipeline_placeholder": "'true'"}
    if p == "A":
        values |= {"non_standard_external_calls": "'[]'", "data_flow_path": _q(marker), "vulnerability_node": node, "confidence": "'0'", "additional_context_needed": said}
    elif p == "B":
        values |= {"data_flow_path": _q(marker), "vulnerability_node": node, "cwe_type": "'\"' || cwe || '\"'", "depends_on_caller": "'false'", "caller_constraint": said}
    else:
        values |= {f: "'0.0'" for f in ("variable_match_score", "step_position_score", "dataflow_path_score")}
        values |= {"overall_consistency": _q(marker), "comment": _q(f'"{_DESCRIBED[p]}"')}
    return _keys(values)


def _by_phase(parts: dict[str, str]) -> str:
    return "CASE phase " + " ".join(f"WHEN '{p}' THEN {x}" for p, x in parts.items()) + " END"


REPORTS = f"""{RESPONSES},
n AS (SELECT *, CASE WHEN v IS NOT NULL THEN {_by_phase(_NORMAL)} END AS n FROM c),
rules AS (
  SELECT *, CASE WHEN n IS NULL THEN [] ELSE list_filter({_by_phase({p: "[" + ", ".join(x) + "]" for p, x in _RULES.items()})}, lambda x: x IS NOT NULL) END AS broken FROM n
), s AS (
  SELECT *, CASE WHEN n IS NULL THEN 'call_failed' WHEN len(broken) > 0 THEN 'invalid' ELSE 'ok' END AS state,
    CASE WHEN n IS NULL THEN 'ModelCallError' WHEN len(broken) > 0 THEN 'PhaseOutputValidationError' END AS error_type,
    CASE WHEN n IS NULL THEN 'phase ' || phase || ' failed after ' || made || ' attempts; last error: ' || kind || ': ' || said || context
      WHEN len(broken) > 0 THEN 'phase ' || phase || ' output validation failed: ValueError: ' || broken[1] END AS message
  FROM rules
), rep AS (
  SELECT *, 'o_' || k AS sample_id, CASE WHEN state = 'ok' THEN n ELSE {_by_phase({p: _placeholder(p) for p in PHASES})} END AS report FROM s
)"""

#: What an issue shows of a rejected report: keys in order, secrets hidden.
_SHOWN_KEYS = {
    "A": ("additional_context_needed", "confidence", "data_flow_path", "non_standard_external_calls", "reviewer"),
    "B": ("caller_constraint", "cwe_type", "data_flow_path", "depends_on_caller"),
    "C": ("comment", "dataflow_path_score", "overall_consistency", "step_position_score", "variable_match_score"),
}
_SHOWN_NODE = (
    "CASE WHEN json_type(v, '$.vulnerability_node') = 'OBJECT' THEN '{' || concat_ws(',', " + ", ".join(
        f"'\"{f}\":' || CAST(json_extract(v, '$.vulnerability_node.{f}') AS VARCHAR)" for f in ("extra", *_NODE_NAMES))
    + ") || '}' ELSE CAST(json_extract(v, '$.vulnerability_node') AS VARCHAR) END")
_SHOWN = _by_phase({
    p: _keys({k: "CASE WHEN r = 19 THEN '5' ELSE " + _get(k) + " END" if k == "confidence" else _get(k) for k in names}
             | ({"vulnerability_node": _SHOWN_NODE} if p != "C" else {})
             | ({"api_key": "CASE WHEN r = 107 THEN '\"[REDACTED]\"' END",
                 "notes": "CASE WHEN r = 107 THEN '[\"Bearer [REDACTED]\",{\"n\":\"sk-[REDACTED] end\"}]' END"} if p == "B" else {}))
    for p, names in _SHOWN_KEYS.items()})


def phase_oracles() -> dict[str, str]:
    columns = [
        ("a", "non_standard_external_calls", "json_extract({0}, '$.non_standard_external_calls')"), ("a", "data_flow_path", "{0}->>'$.data_flow_path'"),
        ("a", "vulnerability_variable", "{0}->>'$.vulnerability_node.variable_name'"), ("a", "vulnerability_step_location", "{0}->>'$.vulnerability_node.step_location'"),
        ("a", "vulnerability_issue_description", "{0}->>'$.vulnerability_node.issue_description'"), ("a", "confidence", "CAST({0}->>'$.confidence' AS BIGINT)"),
        ("a", "additional_context_needed", "{0}->>'$.additional_context_needed'"), ("a", "raw", "{0}"),
        ("b", "data_flow_path", "{0}->>'$.data_flow_path'"), ("b", "vulnerability_variable", "{0}->>'$.vulnerability_node.variable_name'"),
        ("b", "vulnerability_step_location", "{0}->>'$.vulnerability_node.step_location'"),
        ("b", "vulnerability_issue_description", "{0}->>'$.vulnerability_node.issue_description'"), ("b", "cwe_type", "{0}->>'$.cwe_type'"),
        ("b", "depends_on_caller", "CAST({0}->>'$.depends_on_caller' AS BOOLEAN)"), ("b", "caller_constraint", "{0}->>'$.caller_constraint'"), ("b", "raw", "{0}"),
        ("c", "variable_match_score", "CAST({0}->>'$.variable_match_score' AS DOUBLE)"), ("c", "step_position_score", "CAST({0}->>'$.step_position_score' AS DOUBLE)"),
        ("c", "dataflow_path_score", "CAST({0}->>'$.dataflow_path_score' AS DOUBLE)"), ("c", "overall_consistency", "{0}->>'$.overall_consistency'"),
        ("c", "comment", "{0}->>'$.comment'"), ("c", "raw", "{0}"),
    ]
    flat = ",\n  ".join(f"{x.format('w.' + p.upper())} AS phase_{p}_{name}" for p, name, x in columns)
    wide = f"""{REPORTS},
w AS (SELECT k, max(report) FILTER (WHERE phase = 'A') AS A, max(report) FILTER (WHERE phase = 'B') AS B, max(report) FILTER (WHERE phase = 'C') AS C FROM rep GROUP BY k)"""
    return {
        "x2_phase_reports": f"""WITH {REPORTS.strip()}
SELECT sample_id, phase, state, CAST(coalesce(win, made) AS BIGINT) AS attempts_used, report, CAST(len(broken) AS BIGINT) AS violations FROM rep""",
        "f9_f11_violations": f"""WITH {REPORTS.strip()}
SELECT sample_id, phase, CAST(i - 1 AS INTEGER) AS position, broken[i] AS violation FROM (SELECT *, unnest(range(1, len(broken) + 1)) AS i FROM rep) x""",
        "x5_issues": f"""WITH {REPORTS.strip()}
SELECT sample_id, phase, error_type, message, CASE WHEN state = 'call_failed' THEN lines ELSE '' END AS attempts,
  CASE WHEN state = 'invalid' THEN {_SHOWN} END AS model_output, CASE WHEN state = 'invalid' THEN 'ValueError' ELSE kind END AS cause_type,
  CASE WHEN state = 'invalid' THEN broken[1] ELSE said END AS cause_message FROM rep WHERE state <> 'ok'""",
        "j3_phase_c_prompts": f"""WITH {wide.strip()}
SELECT 'o_' || k AS sample_id, 'Blind report:' || chr(10) || A || chr(10) || chr(10) || 'Patch-informed report:' || chr(10) || B || chr(10) AS user_prompt FROM w""",
        "p31_result_rows": f"""WITH {wide.strip()}
SELECT 'o_' || k AS sample_id, commit_id, project, cwe,
  {flat}
FROM w JOIN o USING (k)""",
        "p22_redacted_details": """SELECT event_id, '{"auth":{"Api-Key":"[REDACTED]","user":"u' || user_id || '"},"deep":'
  || CASE WHEN event_id % 31 = 0 THEN '{"a":{"b":{"c":{"d":["Bearer [REDACTED], x"]}}}}' ELSE 'null' END
  || ',"kind":"' || event_type || '","log":["bearer  [REDACTED]; next",{"client_secret":"[REDACTED]","msg":"key sk-[REDACTED]."},[true,null,1.5]],"props":'
  || CAST(json(props) AS VARCHAR) || '}' AS details FROM events""",
    }
