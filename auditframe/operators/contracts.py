"""Phase report contracts (F9..F11): ordered rules over the paths of a VARIANT.

A contract is data: a tuple of rules, each naming a path, a test and what the
violation says. ``contract_errors(phase, report)`` evaluates the rules in order
and returns the list of violations (empty = valid); the first one is the issue
message. A rule is asked only where the object around its path is one and has the
field; what an object lacks is listed by the ``Fields`` rule in front.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditframe.functions import let
from auditframe.functions import variant as V

# Required fields per phase and node fields; the message texts below
# are fixed values too (result tables store them).
REQUIRED = {
    "A": ("additional_context_needed", "confidence", "data_flow_path", "non_standard_external_calls",
          "vulnerability_node"),
    "B": ("caller_constraint", "cwe_type", "data_flow_path", "depends_on_caller", "vulnerability_node"),
    "C": ("comment", "dataflow_path_score", "overall_consistency", "step_position_score", "variable_match_score"),
}
NODE_FIELDS = ("issue_description", "step_location", "variable_name")
SCORES = ("variable_match_score", "step_position_score", "dataflow_path_score")


@dataclass(frozen=True)
class Rule:
    """The value at ``path`` (keys from the report on) must pass ``test``."""

    path: tuple[str, ...]
    test: str
    says: str


@dataclass(frozen=True)
class Fields:
    """The object at ``path`` must have the fields ``names``, given in order."""

    path: tuple[str, ...]
    names: tuple[str, ...]
    says: str


def _strings(v: Column, kind: Column, text: Column) -> Column:
    items = F.try_variant_get(v, "$", "array<variant>")
    return V.is_array(v, kind) & F.forall(F.coalesce(items, F.array()), lambda x: V.is_string(x))


def _finite(v: Column, kind: Column, text: Column) -> Column:
    number = F.try_variant_get(v, "$", "double")
    return V.is_number(v, kind) & ~F.isnan(number) & (F.abs(number) != float("inf"))


#: Tests by name: VARIANT, its type name and its string -> boolean; NULL counts as failed.
TESTS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "object": lambda v, kind, text: V.is_object(v, kind),
    "strings": _strings,
    "text": V.nonblank,
    "text_or_object": lambda v, kind, text: V.is_object(v, kind) | V.nonblank(v, kind, text),
    "text_or_null": lambda v, kind, text: V.is_string(v, kind) | (kind == "VOID"),
    "boolean": lambda v, kind, text: V.is_bool(v, kind),
    "integer": lambda v, kind, text: V.is_integer(v, kind),
    "percent": lambda v, kind, text: ~V.is_integer(v, kind) | F.try_variant_get(v, "$", "bigint").between(0, 100),
    "number": _finite,
}


def _phase(phase: str, *rules: tuple) -> tuple[Rule | Fields, ...]:
    """The contract of a phase: an object with its fields, then ``rules`` (path, test, text)."""
    name = f"phase {phase}"
    return (
        Rule((), "object", f"{name} output must be a JSON object"),
        Fields((), REQUIRED[phase], f"{name} output is missing fields: "),
        *(Fields(path, test, f"{name} {says}") if isinstance(test, tuple) else Rule(path, test, f"{name} {says}") for path, test, says in rules),
    )


_TEXT = "must be a non-empty string"
_NODE = (
    (("vulnerability_node",), "object", "vulnerability_node must be a JSON object"),
    (("vulnerability_node",), NODE_FIELDS, "vulnerability_node is missing fields: "),
    *((("vulnerability_node", f), "text", f"{f} {_TEXT}") for f in NODE_FIELDS),
)
CONTRACTS: dict[str, tuple[Rule | Fields, ...]] = {
    "A": _phase(
        "A",
        (("non_standard_external_calls",), "strings", "non_standard_external_calls must be a string array"),
        (("data_flow_path",), "text", f"data_flow_path {_TEXT}"),
        *_NODE,
        (("additional_context_needed",), "text_or_null", "additional_context_needed must be a string or null"),
        (("confidence",), "integer", "confidence must be an integer"),
        (("confidence",), "percent", "confidence must be in [0, 100]"),
    ),
    "B": _phase(
        "B",
        (("data_flow_path",), "text", f"data_flow_path {_TEXT}"),
        (("cwe_type",), "text", f"cwe_type {_TEXT}"),
        *_NODE,
        (("depends_on_caller",), "boolean", "depends_on_caller must be boolean"),
        (("caller_constraint",), "text_or_null", "caller_constraint must be a string or null"),
    ),
    "C": _phase(
        "C",
        *(((f,), "number", f"{f} must be numeric") for f in SCORES),
        (("overall_consistency",), "text", f"overall_consistency {_TEXT}"),
        (("comment",), "text_or_object", f"comment {_TEXT}"),
    ),
}


def _at(report: Column, path: tuple[str, ...]) -> Column:
    for name in path:
        report = V.field(report, name)
    return report


def _listed(names: Column) -> Column:
    """A list of names as the messages show it: ['a', 'b']."""
    return F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))


#: Value, type name and string of what stands at a path of the report.
Lookup = Callable[[tuple[str, ...]], tuple[Column, Column, Column]]


def asked_paths(phase: str) -> tuple[tuple[str, ...], ...]:
    """The paths below the report that the rules of a phase look at, parents first."""
    rules = CONTRACTS[phase]
    found = [r.path for r in rules] + [(*r.path, n) for r in rules if isinstance(r, Fields) for n in r.names]
    return tuple(sorted(dict.fromkeys(p for p in found if p), key=len))


def violation(rule: Rule | Fields, at: Lookup, text: Column | None = None) -> Column:
    """What ``rule`` finds wrong with the values that ``at`` gives, or NULL."""
    value, kind, string = at(rule.path)
    if isinstance(rule, Fields):
        absent = {f: at((*rule.path, f))[0].isNull() for f in rule.names}
        missing = F.array_compact(F.array(*[F.when(no, F.lit(f)) for f, no in absent.items()]))
        return F.when(V.is_object(value, kind) & functools.reduce(Column.__or__, absent.values()), F.concat(F.lit(rule.says), _listed(missing)))
    passed = TESTS[rule.test](value, kind, string)
    if rule.test == "integer" and len(rule.path) == 1 and text is not None:
        # only a text that has such a number as some member is read again
        written = text.rlike(r":\s*-?[0-9]+[.eE]") & F.get_json_object(text, f"$.{rule.path[0]}").rlike("^-?[0-9]+[.eE]")
        passed = passed & ~F.coalesce(written, F.lit(False))
    failed = ~F.coalesce(passed, F.lit(False))
    return F.when(value.isNotNull() & failed if rule.path else failed, F.lit(rule.says))


def contract_errors(phase: str, report: Column, text: Column | None = None) -> Column:
    """F9 / F10 / F11 on a VARIANT report, in the contract's order.

    A VARIANT holds 5.0 as 5; with the JSON ``text`` of the report a number that
    is written with a fraction or an exponent is no integer."""
    def at(path: tuple[str, ...]) -> tuple[Column, Column, Column]:
        value = _at(report, path)
        return value, V.vtype(value), V.string_value(value)

    return let(broken_rules(phase, at, text), errors_of)


_BETWEEN = "\u0000"


def broken_rules(phase: str, at: Lookup, text: Column | None = None) -> Column:
    """What the rules of a phase find wrong with values that are columns already, as one
    text ("" if nothing): a list of its own function would keep every rule from being
    compiled. ``errors_of`` makes the list."""
    return F.concat_ws(_BETWEEN, *[violation(rule, at, text) for rule in CONTRACTS[phase]])


def errors_of(broken: Column) -> Column:
    return F.when(broken == "", F.array().cast("array<string>")).otherwise(F.split(broken, _BETWEEN))
