"""Score reports: single-model (D6), multi-model similarity (D7),
score difference (D8), multi-model CDS (D9) and reconciliation (D13).

All jobs are DataFrame plans over a result table with columns
``model, file_ord, row_key, sample_id`` + score texts + raw reports.
Models are a parameter (any number, in report order).
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.functions import score as S
from auditframe.functions.text import strip_field
from auditframe.operators import stats
from auditframe.operators.validity import add_row_checks, drop_checks, error_reasons, has_pipeline_error, require_columns
from auditframe.plans.views import MODELS, SCORED_TEXT_COLUMNS
from auditframe.session import cut_lineage, lineage_scope

SCOPES = ("full", "three_model_common")


def _checked(df: DataFrame, text_columns: Sequence[str] = SCORED_TEXT_COLUMNS) -> DataFrame:
    return add_row_checks(df, text_columns)


# ---------------------------------------------------------------- D6 single model
def scored_rows(df: DataFrame, text_columns: Sequence[str] = SCORED_TEXT_COLUMNS, digits: int = 6) -> DataFrame:
    """D6 row stage: F1 + F2 decide ``skipped``; valid rows get similarity,
    CDS and CDS band (P10..P13)."""
    checked = _checked(df, text_columns)
    out = drop_checks(checked.withColumn("_error", has_pipeline_error(checked)))
    bad = F.col("_error") | F.col("_e").isNull() | F.col("_l").isNull() | F.col("_f").isNull()
    sim = S.similarity(F.col("_e"), F.col("_l"), F.col("_f"), digits)
    # validity is decided by filters downstream; the derived values do not
    # refer to it, so Catalyst never copies the check expressions into them
    out = out.withColumn("skipped", bad).withColumn("_sim", sim)
    out = out.withColumn("_cds", S.cds(F.col("_sim"), digits))
    return out.withColumn("_cds_band", S.band(F.col("_cds")))


def enriched(df: DataFrame, which: str = "cds", digits: int = 6) -> DataFrame:
    """D6 enriched table with the reference's column placement.

    which="cds": the three derived columns are dropped and re-appended at the
    end; which="similarity": an existing similarity column keeps its place,
    otherwise it is appended. Skipped rows are left out."""
    require_columns(df, S.SCORE_COLUMNS, "input table")
    s = scored_rows(df, digits=digits).where(~F.col("skipped"))
    sim = S.decimal_text(F.col("_sim")).alias("similarity")
    base = [c for c in df.columns]
    if which == "cds":
        keep = [c for c in base if c not in ("similarity", "cds_score", "cds_band")]
        return s.select(*keep, sim, S.decimal_text(F.col("_cds")).alias("cds_score"), F.col("_cds_band").alias("cds_band"))
    cols = [sim if c == "similarity" else F.col(c) for c in base]
    if "similarity" not in base:
        cols.append(sim)
    return s.select(*cols)


def similarity_rows(df: DataFrame) -> DataFrame:
    """P11..P15 on every valid row: text similarity, CDS, band, bin."""
    s = scored_rows(df).where(~F.col("skipped"))
    return s.select(
        "model",
        "sample_id",
        S.decimal_text(F.col("_sim")).alias("similarity"),
        S.decimal_text(F.col("_cds")).alias("cds_score"),
        F.col("_cds_band").alias("cds_band"),
        S.bin_index(F.col("_cds")).alias("cds_bin"),
    )


def score_summary(df: DataFrame, which: str = "cds", digits: int = 6) -> DataFrame:
    """A1 per model: valid rows, skipped rows, distinct values, mean, median,
    min, max of the CDS (or the similarity). One pass over the rows: a
    (model, skipped, value) count table feeds both the counters and the
    statistics."""
    s = scored_rows(df, digits=digits)
    value = F.col("_cds") if which == "cds" else F.col("_sim")
    vc = stats.value_counts(s, ["model", "skipped"], value)
    st = stats.summary_from_counts(vc, ["model"], skip_col="skipped")
    return st.select(
        "model", "row_count", "skipped_row_count",
        F.col("distinct_count").alias(f"distinct_{which}_count"),
        "mean", "median", "minimum", "maximum",
    )


def score_histogram(df: DataFrame, which: str = "cds", models: Sequence[str] = MODELS, digits: int = 6) -> DataFrame:
    """A2 per model: 0.1 bins of the valid values, out-of-range bins when present."""
    s = scored_rows(df, digits=digits).where(~F.col("skipped"))
    value = F.col("_cds") if which == "cds" else F.col("_sim")
    label = "cds_range" if which == "cds" else "similarity_range"
    return stats.bin_histogram(s, ["model"], {"model": list(models)}, value, label, total_name="total")


# ---------------------------------------------------------------- D7 similarity reports
def model_rows(df: DataFrame, text_columns: Sequence[str] = SCORED_TEXT_COLUMNS) -> DataFrame:
    """U4 + F12: every source row with its ordered reasons; the first valid row
    per (model, sample_id) in (file, row) order wins, later rows of that id get
    ``duplicate_sample_id`` (invalid ones too), earlier invalid rows do not.

    The checked rows are narrowed and checkpointed once (reliable, shared
    folder): the winner aggregate and the join back both read them, so the
    row checks run once per row. The winner is found by an aggregate
    (partial, skew-safe) joined back on the key, not by a window over
    possibly hot ids.

    Already computed model rows (from an earlier call) are returned as they
    are, so a job can materialise them once and feed every report.
    """
    if {"valid", "_reasons", "_sim", "score_band"} <= set(df.columns):
        return df
    checked = _checked(df, text_columns)
    base = drop_checks(checked.withColumn("_reasons0", error_reasons(checked)))
    base = base.withColumn("sample_id", F.coalesce(strip_field("sample_id"), F.lit("")))
    base = base.withColumn("_pos", F.struct("file_ord", "row_key"))
    keep = ["model", "sample_id", "source_file", "_pos", "_reasons0", "_e", "_l", "_f"]
    base = cut_lineage(base.select(*keep))
    firsts = (
        base.where(F.col("_reasons0") == "")
        .groupBy("model", "sample_id")
        .agg(F.min("_pos").alias("_first"))
    )
    out = base.join(firsts, ["model", "sample_id"], "left")
    dup = F.col("_first").isNotNull() & (F.col("_pos") > F.col("_first"))
    r0 = F.col("_reasons0")
    reasons = F.when(dup, F.when(r0 == "", F.lit("duplicate_sample_id")).otherwise(
        F.concat(r0, F.lit(";duplicate_sample_id")))).otherwise(r0)
    out = out.withColumn("_reasons", reasons).withColumn("valid", F.col("_reasons") == "")
    # derived values do not refer to ``valid``; consumers filter on it
    out = out.withColumn("_sim", S.similarity(F.col("_e"), F.col("_l"), F.col("_f"))).withColumn(
        "score_band", S.band_from_numerator("_e", "_l", "_f")
    )
    # the place of a row has done its work; it is the widest part of it
    return out.drop("_first", "_pos", "_reasons0")


def valid_with_common(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Valid rows of ``models`` (one per model and id after U4) with ``common`` =
    the id is valid for every one of them (J2/U3); rows of other models take no
    part. The window is partitioned by sample id but holds at most one row per
    model and id, so no id can be hot here."""
    valid = model_rows(df).where(F.col("valid") & F.col("model").isin(*models))
    n = F.count("*").over(Window.partitionBy("sample_id"))
    return valid.withColumn("common", n == len(models))


def valid_results(df: DataFrame) -> DataFrame:
    """result-<model> tables: valid rows with similarity text and score band,
    natural order by numeric suffix then id (W4)."""
    m = model_rows(df).where("valid")
    return m.select(
        "model", "sample_id",
        S.decimal_text(F.col("_sim")).alias("similarity"),
        "score_band",
        S.sample_sort_key(F.col("sample_id")).alias("sample_index"),
    ).orderBy("model", "sample_index", "sample_id")


def excluded_rows(df: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """F12 + W9: excluded rows with the ';'-joined reasons, ordered by model
    order, id suffix, file."""
    m = model_rows(df).where(~F.col("valid"))
    order = F.array_position(F.array(*[F.lit(x) for x in models]), F.col("model"))
    return m.select(
        "model",
        "sample_id",
        S.sample_sort_key(F.col("sample_id")).alias("sample_index"),
        "source_file",
        F.col("_reasons").alias("reason"),
        order.alias("_mo"),
    ).orderBy("_mo", "sample_index", "source_file").drop("_mo")


def common_ids(valid: DataFrame, models: Sequence[str]) -> DataFrame:
    """Ids valid for every one of ``models``, by count instead of joins."""
    named = valid.where(F.col("model").isin(*models))
    return named.groupBy("sample_id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(models)).select("sample_id")


def common_rows(df: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """J2 + W7: long common table, one row per (sample, model), id suffixed
    with the model, interleaved order (suffix, id, model order)."""
    common = valid_with_common(df, models).where("common")
    order = F.array_position(F.array(*[F.lit(x) for x in models]), F.col("model"))
    return common.select(
        F.col("sample_id").alias("base_sample_id"),
        "model",
        F.concat("sample_id", F.lit("_"), "model").alias("sample_id"),
        S.decimal_text(F.col("_sim")).alias("similarity"),
        "score_band",
        S.sample_sort_key(F.col("sample_id")).alias("_idx"),
        order.alias("_mo"),
    ).orderBy("_idx", "base_sample_id", "_mo").drop("_idx", "_mo")


def _scoped_valid(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Valid rows tagged with their scopes: every row is in ``full``, common
    ones also in ``three_model_common`` (one pass, ``explode``, no union)."""
    v = valid_with_common(df, models)
    scopes = F.when(F.col("common"), F.array(F.lit(SCOPES[0]), F.lit(SCOPES[1]))).otherwise(F.array(F.lit(SCOPES[0])))
    return v.withColumn("scope", F.explode(scopes))


def similarity_band_distribution(df: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """A3: band of the *unrounded* similarity per scope and model."""
    sv = _scoped_valid(df, models)
    return stats.band_distribution(sv, ["scope", "model"], {"scope": list(SCOPES), "model": list(models)}, "score_band")


def similarity_bin_distribution(df: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """A4: 0.1 bins of the rounded similarity per scope and model."""
    sv = _scoped_valid(df, models)
    return stats.bin_histogram(
        sv, ["scope", "model"], {"scope": list(SCOPES), "model": list(models)}, F.col("_sim"), "similarity_range"
    )


def _wide(df: DataFrame, models: Sequence[str], value_col: str, band_col: str) -> DataFrame:
    """One row per common sample with one value and one band column per model."""
    common = valid_with_common(df, models).where("common")
    if value_col == "_cds":
        common = common.withColumn("_cds", S.cds(F.col("_sim"))).withColumn("_cds_band", S.band(F.col("_cds")))
    aggs = []
    for m in models:
        aggs.append(F.max(F.when(F.col("model") == m, F.col(value_col))).alias(f"v_{m}"))
        aggs.append(F.max(F.when(F.col("model") == m, F.col(band_col))).alias(f"b_{m}"))
    return common.groupBy("sample_id").agg(*aggs)


def agreement(df: DataFrame, models: Sequence[str] = MODELS, basis: str = "similarity") -> DataFrame:
    """A5: equal-band counts per model pair and for all models."""
    band_col = "score_band" if basis == "similarity" else "_cds_band"
    value_col = "_sim" if basis == "similarity" else "_cds"
    wide = _wide(df, models, value_col, band_col)
    pairs = list(itertools.combinations(models, 2))
    aggs = [F.count("*").alias("common_valid")]
    for a, b in pairs:
        aggs.append(F.count_if(F.col(f"b_{a}") == F.col(f"b_{b}")).alias(f"{a}_vs_{b}"))
    all_same = F.lit(True)
    for m in models[1:]:
        all_same = all_same & (F.col(f"b_{m}") == F.col(f"b_{models[0]}"))
    aggs.append(F.count_if(all_same).alias("all_three" if len(models) == 3 else "all_models"))
    one = wide.agg(*aggs)
    names = [f"{a}_vs_{b}" for a, b in pairs] + ["all_three" if len(models) == 3 else "all_models"]
    stacked = one.select(
        "common_valid",
        F.inline(F.array(*[F.struct(F.lit(n).alias("comparison"), F.col(n).alias("agree_count")) for n in names])),
    )
    return stacked.select(
        "comparison",
        F.col("common_valid").cast("bigint").alias("common_valid"),
        F.col("agree_count").cast("bigint").alias("agree_count"),
        (F.col("common_valid") - F.col("agree_count")).cast("bigint").alias("disagree_count"),
        S.percentage(F.col("agree_count"), F.col("common_valid")).alias("agreement_percentage"),
    )


def band_combinations(df: DataFrame, models: Sequence[str] = MODELS, basis: str = "similarity") -> DataFrame:
    """Counts of every band combination across the models (3^n rows)."""
    band_col = "score_band" if basis == "similarity" else "_cds_band"
    value_col = "_sim" if basis == "similarity" else "_cds"
    wide = _wide(df, models, value_col, band_col)
    suffix = "_band" if basis == "similarity" else "_cds_band"
    keys = [f"{m}{suffix}" for m in models]
    counts = wide.groupBy(*[F.col(f"b_{m}").alias(k) for m, k in zip(models, keys)]).agg(F.count("*").alias("count"))
    total = wide.agg(F.count("*").alias("common_valid"))
    base = stats.grid(df.sparkSession, {k: list(S.BAND_ORDER) for k in keys})
    filled = stats.zero_fill(counts, base.withColumn("_one", F.lit(1)), keys).join(
        F.broadcast(total.withColumn("_one", F.lit(1))), "_one"
    ).drop("_one")
    same = F.lit(True)
    for k in keys[1:]:
        same = same & (F.col(k) == F.col(keys[0]))
    return filled.select(
        *keys,
        F.when(same, F.lit("true")).otherwise(F.lit("false")).alias("all_same"),
        "count",
        S.percentage(F.col("count"), F.col("common_valid")).alias("percentage"),
        F.col("common_valid").cast("bigint").alias("common_valid"),
    )


def _difference_long(df: DataFrame, models: Sequence[str], basis: str) -> DataFrame:
    value_col = "_sim" if basis == "similarity" else "_cds"
    band_col = "score_band" if basis == "similarity" else "_cds_band"
    wide = _wide(df, models, value_col, band_col)
    pairs = list(itertools.combinations(models, 2))
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"{a}_vs_{b}").alias("comparison"),
                        F.abs(F.col(f"v_{a}") - F.col(f"v_{b}")).alias("diff"),
                    )
                    for a, b in pairs
                ]
            )
        )
    )


def difference_distribution(
    df: DataFrame, models: Sequence[str] = MODELS, basis: str = "similarity", keep_out_of_range: bool = True
) -> DataFrame:
    """A7 + W2: histogram of |a - b| per model pair with running totals.

    basis="similarity" is the score-difference table (out-of-range bins kept
    when present); basis="cds" keeps bins 0..9 only."""
    long = _difference_long(df, models, basis)
    comps = [f"{a}_vs_{b}" for a, b in itertools.combinations(models, 2)]
    label = "difference_range" if basis == "similarity" else "absolute_cds_difference_range"
    return stats.bin_histogram(
        long, ["comparison"], {"comparison": comps}, F.col("diff"), label,
        keep_out_of_range=keep_out_of_range, cumulative=True, total_name="total_common",
    )


def difference_summary(df: DataFrame, models: Sequence[str] = MODELS, basis: str = "similarity") -> DataFrame:
    """Count, mean (HALF_UP), exact median, min, max of |a - b| per pair."""
    long = _difference_long(df, models, basis)
    st = stats.summary_stats(long, ["comparison"], F.col("diff"))
    return st.select(
        "comparison",
        F.col("row_count").alias("sample_count"),
        F.col("mean").alias("mean_absolute_difference"),
        F.col("median").alias("median_absolute_difference"),
        F.col("minimum").alias("minimum_absolute_difference"),
        F.col("maximum").alias("maximum_absolute_difference"),
    )


# ---------------------------------------------------------------- D9 CDS reports
def cds_band_distribution(df: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """A3: CDS bands per scope and model."""
    sv = _scoped_valid(df, models).withColumn("_cds", S.cds(F.col("_sim")))
    sv = sv.withColumn("cds_band", S.band(F.col("_cds")))
    return stats.band_distribution(sv, ["scope", "model"], {"scope": list(SCOPES), "model": list(models)}, "cds_band")


def cds_bin_distribution(df: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """A4: 0.1 bins of the CDS per scope and model."""
    sv = _scoped_valid(df, models).withColumn("_cds", S.cds(F.col("_sim")))
    return stats.bin_histogram(
        sv, ["scope", "model"], {"scope": list(SCOPES), "model": list(models)}, F.col("_cds"), "cds_range"
    )


def run_summary(df: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """Per-model source / excluded / valid counts plus the common count."""
    m = model_rows(df)
    per = m.groupBy("model").agg(
        F.count("*").alias("source_row_count"),
        F.count_if(~F.col("valid")).alias("excluded_row_count"),
        F.count_if("valid").alias("valid_row_count"),
    )
    n_common = common_ids(m.where("valid"), models).agg(F.count("*").alias("three_model_common_valid_sample_count"))
    out = per.withColumn("_one", F.lit(1)).join(F.broadcast(n_common.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return out.withColumn(
        "common_all_models_row_count", F.col("three_model_common_valid_sample_count") * len(models)
    )


# Formulas stated in the run summary.
SIMILARITY_FORMULA = "0.5 * (((E + L + F) / 3) + min(E, L, F))"
CDS_FORMULA = "1 - similarity"


def run_summary_document(df: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """The run summary as one row with nested fields (formulas,
    score columns, band definitions, per-model counts, common counts,
    agreement rows). Built from tables bounded by the number of models."""
    per = run_summary(df, models)
    agree = agreement(df, models, "similarity")
    model_map = per.agg(
        F.map_from_entries(F.collect_list(F.struct(
            "model", F.struct("source_row_count", "excluded_row_count", "valid_row_count")))).alias("models"),
        F.first("three_model_common_valid_sample_count").alias("three_model_common_valid_sample_count"),
        F.first("common_all_models_row_count").alias("common_all_models_row_count"),
    )
    agree_rows = agree.agg(F.array_sort(F.collect_list(F.struct(*agree.columns))).alias("agreement"))
    bands = F.create_map(*[x for b in S.BAND_ORDER for x in (F.lit(b), F.lit(S.BAND_DEFINITIONS[b]))])
    one = F.lit(1)
    return (
        model_map.withColumn("_k", one).join(agree_rows.withColumn("_k", one), "_k").drop("_k")
        .select(
            F.lit(SIMILARITY_FORMULA).alias("similarity_formula"),
            F.lit(CDS_FORMULA).alias("cds_formula"),
            F.array(*[F.lit(c) for c in S.SCORE_COLUMNS]).alias("score_columns"),
            bands.alias("bands"),
            "models", "three_model_common_valid_sample_count", "common_all_models_row_count", "agreement",
        )
    )


# ---------------------------------------------------------------- D13 checks
# The checks read the tables of a written report (``report_tables`` by name, as
# ``multi_model_report`` stores them) and recompute what they should hold.
Tables = Mapping[str, DataFrame]


def _one_row(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = frames[0].withColumn("_k", F.lit(1))
    for f in frames[1:]:
        out = out.join(f.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def _differ(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def recompute_check(tables: Tables, df: DataFrame) -> DataFrame:
    """The stored similarity and band of every result row against a
    recomputation from the source scores; per model, also rows on one side only."""
    source = model_rows(df).where("valid").select(
        "model", "sample_id", S.decimal_text(S.similarity(F.col("_e"), F.col("_l"), F.col("_f"))).alias("_similarity"),
        S.band_from_numerator("_e", "_l", "_f").alias("_band"))
    stored = tables["results"].select("model", "sample_id", "similarity", "score_band")
    both = stored.join(source, ["model", "sample_id"], "full_outer")
    return both.groupBy("model").agg(
        F.count("score_band").alias("checked_rows"),
        F.count_if(F.col("score_band").isNull() | F.col("_band").isNull()).alias("unmatched_rows"),
        F.count_if(_differ("similarity", "_similarity")).alias("similarity_mismatches"),
        F.count_if(_differ("score_band", "_band")).alias("band_mismatches"),
    )


def row_accounting(tables: Tables) -> DataFrame:
    """source = valid + excluded per model, as counted in the stored rows;
    stored band and bin counts sum to the valid total; percentages sum to 100
    within 0.0001."""
    valid = tables["results"].groupBy("model").agg(F.count("*").alias("_valid"))
    excluded = tables["excluded_errors"].groupBy("model").agg(F.count("*").alias("_excluded"))

    def total(name: str, to: str) -> DataFrame:
        pct = S.to_micro(S.parse_score(F.col("percentage")))
        full = tables[name].where(F.col("scope") == SCOPES[0])
        return full.groupBy("model").agg(F.sum("count").alias(to), F.sum(pct).alias(f"{to}_pct"))

    out = tables["summary"].select("model", "source_row_count", "valid_row_count", "excluded_row_count")
    for t in (valid, excluded, total("distribution_3_bands", "_bands"), total("distribution_0.1_bins", "_bins")):
        out = out.join(t, "model", "left")
    out = out.na.fill(0, ["_valid", "_excluded", "_bands", "_bins"])
    whole = [F.coalesce(F.abs(F.col(c) - 100_000_000) <= 100, F.lit(False)) for c in ("_bands_pct", "_bins_pct")]
    v = F.col("valid_row_count")
    return out.select(
        "model", "source_row_count", "valid_row_count", "excluded_row_count",
        ((F.col("source_row_count") == v + F.col("excluded_row_count")) & (v == F.col("_valid"))
         & (F.col("excluded_row_count") == F.col("_excluded"))).alias("rows_balance"),
        (F.col("_bands") == v).alias("bands_balance"), (F.col("_bins") == v).alias("bins_balance"),
        (whole[0] & whole[1]).alias("percentages_balance"),
    )


def common_completeness(tables: Tables, models: Sequence[str] = MODELS) -> DataFrame:
    """Every sample of the stored common table has every model exactly once
    and the ids equal the intersection of the stored results."""
    per = tables["common_all_models"].groupBy("base_sample_id").agg(
        F.count("*").alias("_n"), F.count_distinct("model").alias("_m"))
    ids = common_ids(tables["results"], models)
    both = per.select(F.col("base_sample_id").alias("sample_id"), "_n", "_m").join(ids.withColumn("_in", F.lit(True)), "sample_id", "full_outer")
    broken = (F.col("_n") != len(models)) | (F.col("_m") != len(models))
    return both.agg(
        F.count("_n").alias("common_samples"), F.count_if(broken).alias("incomplete_samples"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("common_rows"),
        F.count_if(F.col("_n").isNull()).alias("missing_ids"), F.count_if(F.col("_in").isNull()).alias("unexpected_ids"))


def recount_check(tables: Tables, models: Sequence[str] = MODELS) -> DataFrame:
    """T4: the stored agreement (pairs and all models), combination and
    difference tables against a recount from the stored common table."""
    pairs = list(itertools.combinations(models, 2))
    band = {m: F.max(F.when(F.col("model") == m, F.col("score_band"))).alias(f"{m}_band") for m in models}
    value = {m: F.max(F.when(F.col("model") == m, S.parse_score(F.col("similarity")))).alias(f"v_{m}") for m in models}
    wide = tables["common_all_models"].groupBy("base_sample_id").agg(*band.values(), *value.values())
    keys = [f"{m}_band" for m in models]

    same = F.lit(True)
    for k in keys[1:]:
        same = same & (F.col(k) == F.col(keys[0]))
    tests = {f"{a}_vs_{b}": F.col(f"{a}_band") == F.col(f"{b}_band") for a, b in pairs}
    tests["all_three" if len(models) == 3 else "all_models"] = same
    one = wide.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])
    recount = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("comparison"), F.col(n).alias("_recount")) for n in tests])))
    agree = tables["model_agreement"].join(recount, "comparison", "full_outer").agg(
        F.count("*").alias("comparisons"), F.count_if(_differ("agree_count", "_recount")).alias("mismatches"))

    combos = wide.groupBy(*keys).agg(F.count("*").alias("_recount"))
    cmp = tables["model_agreement_combinations"].select(*keys, "count").join(combos, keys, "full_outer").agg(
        F.count_if(F.coalesce("count", F.lit(0)) != F.coalesce("_recount", F.lit(0))).alias("combination_mismatches"))

    apart = wide.select(F.inline(F.array(*[F.struct(
        F.lit(f"{a}_vs_{b}").alias("comparison"), F.abs(F.col(f"v_{a}") - F.col(f"v_{b}")).alias("d")) for a, b in pairs])))
    bins = apart.groupBy("comparison", S.bin_index(F.col("d")).alias("bin_index")).agg(F.count("*").alias("_recount"))
    diff = tables["score_difference_distribution"].select("comparison", "bin_index", "count").join(bins, ["comparison", "bin_index"], "full_outer").agg(
        F.count_if(F.coalesce("count", F.lit(0)) != F.coalesce("_recount", F.lit(0))).alias("difference_mismatches"))
    return _one_row(agree, cmp, diff)


def checked_report(df: DataFrame, check: str, models: Sequence[str] = MODELS) -> DataFrame:
    """Write the report tables that a check needs, read them back, check."""
    rows = cut_lineage(model_rows(df))
    needs = {
        "recompute_check": ("results",),
        "row_accounting": ("results", "excluded_errors", "distribution_3_bands", "distribution_0.1_bins", "summary"),
        "common_completeness": ("results", "common_all_models"),
        "recount_check": ("common_all_models", "model_agreement", "model_agreement_combinations", "score_difference_distribution"),
    }[check]
    report = report_tables(rows, models)
    tables = {name: cut_lineage(report[name]) for name in needs}
    if check == "recompute_check":
        return recompute_check(tables, rows)
    if check == "row_accounting":
        return row_accounting(tables)
    return (common_completeness if check == "common_completeness" else recount_check)(tables, models)


# ---------------------------------------------------------------- job-level writers
def single_model_report(df: DataFrame, out_dir: str, which: str = "cds", digits: int = 6) -> dict:
    """D6 as a job: enriched rows (S13), 0.1-bin distribution (A2) and the
    summary (A1) under ``out_dir``; no valid row is an error. The summary is
    one small row per model returned to the caller."""
    from auditframe.sources.files import write_table

    with lineage_scope(df.sparkSession):
        summary = score_summary(df, which, digits)
        rows = summary.collect()
        bad = [r for r in rows if not r["row_count"]]
        if bad:
            raise ValueError(f"input CSV contains no valid data rows; skipped {bad[0]['skipped_row_count']}")
        write_table(enriched(df, which, digits), f"{out_dir}/enriched")
        write_table(score_histogram(df, which, sorted({r['model'] for r in rows}), digits), f"{out_dir}/distribution")
        write_table(summary, f"{out_dir}/summary")
    return {r["model"]: r.asDict() for r in rows}


def report_tables(df: DataFrame, models: Sequence[str] = MODELS) -> dict[str, DataFrame]:
    """D7 + D8 + D9: every table of the multi-model reports, by name. ``df`` are
    result rows or the model rows of ``model_rows``."""
    return {
        "results": valid_results(df),
        "excluded_errors": excluded_rows(df, models),
        "common_all_models": common_rows(df, models),
        "distribution_3_bands": similarity_band_distribution(df, models),
        "distribution_0.1_bins": similarity_bin_distribution(df, models),
        "model_agreement": agreement(df, models, "similarity"),
        "model_agreement_combinations": band_combinations(df, models, "similarity"),
        "score_difference_distribution": difference_distribution(df, models, "similarity", True),
        "score_difference_summary": difference_summary(df, models, "similarity"),
        "cds_distribution_3_bands": cds_band_distribution(df, models),
        "cds_distribution_0.1_bins": cds_bin_distribution(df, models),
        "model_cds_agreement": agreement(df, models, "cds"),
        "model_cds_agreement_combinations": band_combinations(df, models, "cds"),
        "cds_difference_distribution": difference_distribution(df, models, "cds", False),
        "summary": run_summary(df, models),
    }


def multi_model_report(df: DataFrame, out_dir: str, models: Sequence[str] = MODELS) -> None:
    """D7 + D8 + D9 as a job: every table written as a whole (S15) under
    ``out_dir``, with the scores of the valid rows (for the T checks)."""
    from auditframe.sources.files import write_table

    with lineage_scope(df.sparkSession):
        rows = cut_lineage(model_rows(df))  # row checks and U4 once for all tables
        for name, t in report_tables(rows, models).items():
            write_table(t, f"{out_dir.rstrip('/')}/{name}")
        run_summary_document(rows, models).coalesce(1).write.mode("overwrite").json(f"{out_dir.rstrip('/')}/summary.json")
