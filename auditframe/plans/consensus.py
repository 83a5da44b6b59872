"""Consensus sample selection (D10): U5, J6, W5, W6, W3, P33.

Two reference models must agree strictly above the high cut (all such
samples are kept) or strictly below the low cut (top ``low_limit`` kept);
the third model's agreement is reported as a flag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditframe.functions import score as S
from auditframe.operators.ordinals import with_ordinal
from auditframe.session import cut_lineage

HIGH = "0.75"
LOW = "0.25"


def last_wins(rows: DataFrame, key: Sequence[str], position: str) -> DataFrame:
    """Per key keep the row with the greatest position (later file, later
    row). An aggregate with ``max_by`` -- partial per partition, so a hot key
    never gathers its rows in one task."""
    cols = [c for c in rows.columns if c not in key]
    agg = rows.groupBy(*key).agg(F.max_by(F.struct(*cols), F.col(position)).alias("_w"))
    return agg.select(*key, "_w.*")


def model_scores(scored: DataFrame, models: Sequence[str]) -> DataFrame:
    """All models' rows in one pass: the last row per (model, sample) wins,
    with the exact unrounded similarity.

    Rows whose scores do not parse are left out (the reference cannot score
    them either) and so are ids without a numeric suffix.
    """
    m = scored.where(F.col("model").isin(*models)).select(
        "model", "sample_id", "source_file", F.struct("file_ord", "row_key").alias("_pos"), *S.SCORE_COLUMNS,
        "phase_c_overall_consistency", "phase_c_comment",
    )
    m = last_wins(m, ["model", "sample_id"], "_pos")
    e, l, f = (S.parse_score(F.col(c)) for c in S.SCORE_COLUMNS)
    m = m.withColumn("_sim", S.similarity_unrounded(e, l, f))
    return m.where(F.col("_sim").isNotNull() & S.sample_suffix(F.col("sample_id")).isNotNull())


def consensus(
    scored: DataFrame,
    samples: DataFrame,
    models: Sequence[str],
    low_limit: int = 50,
    expected_high: int | None = None,
    expected_total: int | None = None,
) -> DataFrame:
    """D10. ``models`` = (first, second, third): the first two decide, the
    third is the agreement check. Expected sizes are optional assertions."""
    a, b, c = models
    hi = F.lit(HIGH).cast("decimal(3,2)")
    lo = F.lit(LOW).cast("decimal(3,2)")
    rows = cut_lineage(model_scores(scored, models))
    fields = [
        F.col("source_file").alias("source_file"),
        S.decimal_text(F.round(F.col("_sim"), 6)).alias("similarity"),
        *[F.col(col).alias(col.removeprefix("phase_c_")) for col in S.SCORE_COLUMNS],
        F.col("phase_c_overall_consistency").alias("overall_consistency"),
        F.col("phase_c_comment").alias("comment"),
    ]
    # J6 as one pivot of the scores alone: one row per sample, the intersection is
    # "all models present" -- no chain of joins. Written once, read by both groups;
    # the texts are joined for the selected samples only.
    scores = rows.groupBy("sample_id").agg(*[F.max(F.when(F.col("model") == m, F.col("_sim"))).alias(f"_s_{m}") for m in models])
    for m in models:
        scores = scores.where(F.col(f"_s_{m}").isNotNull())
    wide = cut_lineage(samples.select("sample_id").join(scores, "sample_id"))
    sa, sb, sc = (F.col(f"_s_{m}") for m in models)
    idx = S.sample_suffix(F.col("sample_id"))

    high = wide.where((sa > hi) & (sb > hi))
    high_keys = [(sc <= hi).asc(), sc.desc(), F.least(sa, sb).desc(), F.abs(sa - sb).asc(), idx.asc()]
    high = with_ordinal(high, high_keys, "selection_rank").withColumn("selection_group", F.lit("high")).withColumn(
        f"{c}_same_direction", F.when(sc > hi, "true").otherwise("false")
    )

    low_keys = [(sc >= lo).asc(), sc.asc(), F.greatest(sa, sb).asc(), F.abs(sa - sb).asc(), idx.asc()]
    low_top = wide.where((sa < lo) & (sb < lo)).orderBy(*low_keys).limit(low_limit)
    # the ranked set is bounded by low_limit, so one window over it is fine
    low = low_top.withColumn("selection_rank", F.row_number().over(Window.orderBy(*low_keys)).cast("bigint"))
    low = low.withColumn("selection_group", F.lit("low")).withColumn(
        f"{c}_same_direction", F.when(sc < lo, "true").otherwise("false")
    )
    out = high.unionByName(low)  # U10: high group then low group
    if expected_high is not None or expected_total is not None:
        n_high = high.count()
        n_total = n_high + low.count()
        if (expected_high is not None and n_high != expected_high) or (
            expected_total is not None and n_total != expected_total
        ):
            raise RuntimeError(f"unexpected candidate counts: high={n_high}, selected={n_total}")
    chosen = cut_lineage(out)
    texts = rows.join(chosen.select("sample_id"), "sample_id", "left_semi").groupBy("sample_id").agg(
        *[F.max(F.when(F.col("model") == m, F.struct(*fields))).alias(f"_m_{m}") for m in models])
    named = ("source_file", "similarity", "variable_match_score", "step_position_score", "dataflow_path_score", "overall_consistency", "comment")
    shown = [F.col(f"_m_{m}")[name].alias(f"{m}_{name}") for m in models for name in named]
    full = chosen.join(samples.select("sample_id", "commit_id", "project", "cwe"), "sample_id").join(texts, "sample_id")
    return full.select(
        "selection_group", "selection_rank", f"{c}_same_direction", idx.alias("sample_numeric_index"),
        "sample_id", "commit_id", "project", "cwe", *shown,
    ).orderBy(F.when(F.col("selection_group") == "high", 0).otherwise(1), "selection_rank")
