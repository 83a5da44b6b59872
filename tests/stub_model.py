"""Deterministic stand-in for a chat model (tests and the registered run).

A batch callable for ``run_three_phases``: it reads the function name out of
the prompt and answers each phase with a report; every 7th sample's phase A
answer misses a required field and every 5th sample's phase C call fails once
with a truncated answer before succeeding, so placeholders, issues and
attempt resolution are exercised. Pure function of the prompt text.
"""

from __future__ import annotations

import json
import re

import pandas as pd

_NAME = re.compile(r"([A-Za-z_]\w*)\s*\(")


def _report(phase: str, sample_id: str, user: str) -> list[dict]:
    names = _NAME.findall(user)
    name = names[0] if names else "unknown"
    n = int(re.sub(r"\D", "", sample_id) or 0)
    base = {"sample_id": sample_id, "phase": phase, "error_type": None, "message": None, "status_code": None,
            "request_id": None, "finish_reason": "stop"}
    if phase == "A":
        body = {"non_standard_external_calls": [], "data_flow_path": f"x -> {name} -> return",
                "vulnerability_node": {"variable_name": "x", "step_location": f"{name}:1",
                                       "issue_description": "unchecked input"},
                "confidence": n % 101}
        if n % 7 == 0:
            body["vulnerability_node"].pop("variable_name")
        return [{**base, "attempt": 1, "model_output": "```json\n" + json.dumps(body) + "\n```"}]
    if phase == "B":
        body = {"data_flow_path": f"x -> {name} -> guard", "vulnerability_node": {
            "variable_name": "x", "step_location": f"{name}:1", "issue_description": "missing bound check"},
            "depends_on_caller": n % 2 == 0, "caller_constraint": None}
        return [{**base, "attempt": 1, "model_output": json.dumps(body) + ","}]
    same = '"variable_name": "x"' in user.split("Patch-informed report")[0]
    body = {"variable_match_score": 1 if same else 0.25, "step_position_score": (n % 5) / 4,
            "dataflow_path_score": 0.5, "overall_consistency": "partial", "comment": {"note": "stub"}}
    rows = []
    if n % 5 == 0:
        rows.append({**base, "attempt": 1, "finish_reason": "length", "model_output": json.dumps(body)[:20]})
    rows.append({**base, "attempt": len(rows) + 1, "model_output": json.dumps(body)})
    return rows


def stub_model():
    def answer(batch: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        for sid, phase, user in zip(batch["sample_id"], batch["phase"], batch["user_prompt"]):
            rows.extend(_report(phase, sid, user))
        cols = ["sample_id", "phase", "attempt", "error_type", "message", "status_code", "request_id",
                "finish_reason", "model_output"]
        out = pd.DataFrame(rows, columns=cols)
        out["attempt"] = out["attempt"].astype("int64")
        out["status_code"] = out["status_code"].astype("Int32")
        return out

    return answer
