"""Row validity of result tables.

Checks are added as *staged* columns (``add_row_checks``) so every costly
sub-expression -- strip, JSON parse, score parse -- is evaluated once per row
and referenced by name afterwards; the final predicates (F1, F12) only combine
small state columns. JSON is parsed only on rows whose raw text contains a
marker word, the same cheap guard the reference uses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import let
from auditframe.functions import score as S
from auditframe.functions import variant as V
from auditframe.functions.text import py_strip, strip_field

# Marker keys of a placeholder report.
MARKERS = ("pipeline_placeholder", "pipeline_error")
CHECK_PREFIX = "_chk_"


def require_columns(df: DataFrame, required: Sequence[str], what: str = "input") -> None:
    """required-column and duplicate-header checks before a plan is built."""
    cols = df.columns
    if len(cols) != len(set(cols)):
        raise ValueError(f"{what} contains duplicate column names")
    missing = [c for c in required if c not in cols]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")


def raw_state(raw: Column) -> Column:
    """State of one raw phase report: NULL (fine), ``empty``, ``invalid_json``,
    ``non_object`` or ``pipeline_error``.

    JSON is parsed only when a marker word occurs (so ``{garbage}`` without
    markers is fine); that rare branch binds the parsed value once with
    ``let`` so its several type tests share one parse."""
    s = py_strip(raw)
    marked = raw.contains(MARKERS[0]) | raw.contains(MARKERS[1])

    def parsed_state(j: Column) -> Column:
        flagged = V.truthy(V.field(j, MARKERS[0])) | V.truthy(V.field(j, MARKERS[1]))
        return (
            F.when(j.isNull(), F.lit("invalid_json"))
            .when(~V.is_object(j), F.lit("non_object"))
            .when(flagged, F.lit("pipeline_error"))
        )

    # the common case needs neither the strip nor a parse
    plain = raw.startswith("{") & raw.endswith("}") & ~marked
    return (
        F.when(plain, F.lit(None).cast("string"))
        .when(raw.isNull() | (s == ""), F.lit("empty"))
        .when(~(s.startswith("{") & s.endswith("}")), F.lit("invalid_json"))
        .when(marked, let(F.try_parse_json(raw), parsed_state))
    )


def add_row_checks(df: DataFrame, text_columns: Sequence[str]) -> DataFrame:
    """Add parsed scores ``_e, _l, _f`` and per-row check states.

    ``_chk_<raw>``: see ``raw_state``; ``_chk_marker``: phase error marker
    present.
    """
    cols: dict[str, Column] = {}
    for name, short in zip(S.SCORE_COLUMNS, ("_e", "_l", "_f")):
        if name in df.columns:
            cols[short] = S.parse_score(F.col(name))
    for c in S.RAW_COLUMNS:
        if c in df.columns:
            cols[f"{CHECK_PREFIX}{c}"] = raw_state(F.col(c))
    marker = F.lit(False)
    for t in [F.col(c) for c in text_columns if c in df.columns]:
        marker = marker | F.coalesce(t.startswith("[PHASE_") & t.contains("_ERROR]"), F.lit(False))
    cols[f"{CHECK_PREFIX}marker"] = marker
    return df.withColumns(cols)


def has_pipeline_error(df: DataFrame) -> Column:
    """F1: the scorer's error-row test (missing raw columns are ignored).
    Needs the columns of ``add_row_checks``."""
    out = F.col(f"{CHECK_PREFIX}marker")
    for c in S.RAW_COLUMNS:
        if f"{CHECK_PREFIX}{c}" in df.columns:
            out = out | F.col(f"{CHECK_PREFIX}{c}").isNotNull()
    return out


def error_reasons(df: DataFrame) -> Column:
    """ordered exclusion reasons of a result row, ``;``-joined ("" when
    valid). Each item names a different check, so they are distinct by
    construction; ``concat_ws`` skips the checks that passed. Needs the
    columns of ``add_row_checks``; the duplicate-id reason is added by the
    dedup step (U4)."""
    sid = F.coalesce(strip_field("sample_id"), F.lit(""))
    items: list[Column] = [F.when(S.sample_suffix(sid).isNull(), F.lit("invalid_sample_id_suffix"))]
    for c in S.RAW_COLUMNS:
        st = f"{CHECK_PREFIX}{c}"
        if st not in df.columns:
            items.append(F.lit(f"missing_column:{c}"))
        else:
            items.append(F.concat(F.col(st), F.lit(f":{c}")))
    items.append(F.when(F.col(f"{CHECK_PREFIX}marker"), F.lit("phase_error_marker")))
    for name, short in zip(S.SCORE_COLUMNS, ("_e", "_l", "_f")):
        if name not in df.columns:
            items.append(F.lit(f"missing_column:{name}"))
            continue
        # the number-word regex runs only where the decimal parse failed
        # (NaN / Infinity never parse), not on every score
        failed = F.col(short).isNull()
        items.append(
            F.when(failed & F.coalesce(S.is_non_finite_text(F.col(name)), F.lit(False)),
                   F.lit(f"non_finite_score:{name}"))
            .when(failed, F.lit(f"invalid_score:{name}"))
        )
    return F.concat_ws(";", *items)


def drop_checks(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(CHECK_PREFIX)])
