"""Registry of the queries exposed to the driver: name -> (spark, sf_dir) -> DataFrame.

driver tables (through the views in ``auditframe.plans.views``) in full.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from auditframe.plans import reports as R
from pyspark.sql import functions as F

from auditframe.plans import consensus as C
from auditframe.session import checkpoint_dir, cut_lineage, ship_package, track
from auditframe.plans import inference as X
from auditframe.plans import pairs as P
from auditframe.plans.views import MODELS, attempt_rows, megavul_records, pair_rows, sample_rows, scored_results, turn_records

Query = Callable[[SparkSession, str], DataFrame]


def _on_scored(fn, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(scored_results(spark, sf_dir), **kw)

    run.__doc__ = fn.__doc__
    return run


def score_queries() -> dict[str, Query]:
    return {
        "p11_composite_similarity": _on_scored(R.similarity_rows),
        "a1_cds_summary": _on_scored(R.score_summary, which="cds"),
        "a1_similarity_summary": _on_scored(R.score_summary, which="similarity"),
        "a2_cds_histogram": _on_scored(R.score_histogram, which="cds"),
        "a2_similarity_histogram": _on_scored(R.score_histogram, which="similarity"),
        "u4_model_results": _on_scored(R.valid_results),
        "f12_excluded_rows": _on_scored(R.excluded_rows),
        "j2_common_all_models": _on_scored(R.common_rows),
        "a3_band_distribution": _on_scored(R.similarity_band_distribution),
        "a4_bin_distribution": _on_scored(R.similarity_bin_distribution),
        "a5_model_agreement": _on_scored(R.agreement, basis="similarity"),
        "a6_band_combinations": _on_scored(R.band_combinations, basis="similarity"),
        "d9_cds_band_distribution": _on_scored(R.cds_band_distribution),
        "d9_cds_bin_distribution": _on_scored(R.cds_bin_distribution),
        "d9_cds_agreement": _on_scored(R.agreement, basis="cds"),
        "d9_cds_combinations": _on_scored(R.band_combinations, basis="cds"),
        "a7_cds_difference": _on_scored(R.difference_distribution, basis="cds", keep_out_of_range=False),
        "d8_score_difference": _on_scored(R.difference_distribution, basis="similarity", keep_out_of_range=True),
        "a8_difference_summary": _on_scored(R.difference_summary, basis="similarity"),
        "s13_enriched": lambda s, d: R.enriched(scored_results(s, d).drop("row_key"), "cds"),
        "a14_run_summary": _on_scored(R.run_summary),
        "t1_recompute_check": _on_scored(R.checked_report, check="recompute_check"),
        "t2_row_accounting": _on_scored(R.checked_report, check="row_accounting"),
        "t3_common_completeness": _on_scored(R.checked_report, check="common_completeness"),
        "t4_recount_check": _on_scored(R.checked_report, check="recount_check"),
    }


def consensus_queries() -> dict[str, Query]:
    def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.consensus(scored_results(spark, sf_dir), sample_rows(spark, sf_dir), MODELS, low_limit=50)

    d10.__doc__ = C.consensus.__doc__
    return {"d10_consensus_selection": d10}


def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.convert_paired(pair_rows(spark, sf_dir))


def _deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = _converted(spark, sf_dir).where(F.col("reason").isNull())
    return P.deduplicate(written)


def _megavul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.megavul_filter(megavul_records(spark, sf_dir))


def _megavul_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = P.megavul_filter(megavul_records(spark, sf_dir), with_texts=True).where(F.col("reason").isNull())
    return kept.select("func_before", "func_after", "diff")


def pair_queries() -> dict[str, Query]:
    return {
        # the diff texts of D1 and D5 are difflib's (unit tests); the rest is compared by SQL
        "d1_paired_conversion": lambda s, d: P.attach_bodies(
            _converted(s, d).where(F.col("reason").isNull()), pair_rows(s, d)).select(
            "dataset", "row", "sample_id", "commit_id", "commit_short", "project", "func_before", "func_after",
            "commit_msg", "cwe", "commit_msg_anonymized", "pair_key"
        ),
        "s14_paired_rejects": lambda s, d: _converted(s, d).where(F.col("reason").isNotNull()).select(
            "dataset", "row", "reason"
        ),
        "a10_conversion_counts": lambda s, d: P.conversion_counts(_converted(s, d)),
        "d5_deduplicated": lambda s, d: P.attach_bodies(_deduped(s, d).where("emit"), pair_rows(s, d)).select(
            "dataset", "sample_id", "pair_key", "func_before", "func_after",
            F.col("m_commit_id").alias("commit_id"), F.col("m_commit_short").alias("commit_short"),
            F.col("m_project").alias("project"), F.col("m_commit_msg").alias("commit_msg"),
            F.col("m_cwe").alias("cwe"),
        ),
        "a13_dedup_counts": lambda s, d: P.dedup_counts(_deduped(s, d)),
        "a10_primevul_counts": lambda s, d: P.adjacent_counts(P.pair_adjacent(turn_records(s, d)), turn_records(s, d)),
        "w1_primevul_pairs": lambda s, d: P.pair_adjacent(turn_records(s, d)),
        "d3_megavul_conversion": _megavul,
        "a10_megavul_counts": lambda s, d: P.megavul_counts(_megavul(s, d)),
        "d11_oversized_rows": lambda s, d: P.oversized_fields(
            pair_rows(s, d), ["func_before", "func_after", "commit_msg", "cwe_id"], max_field_length=16384
        ).where("excluded").select(
            "doc_id", "dataset", F.array_join(F.array_sort(F.map_keys("oversized")), ",").alias("oversized_fields"),
            F.array_max(F.map_values("oversized")).alias("max_length"),
        ),
        "d12_length_profile": lambda s, d: P.length_profile(_megavul_written(s, d)),
        "a9_length_bins": lambda s, d: P.length_bins(_megavul_written(s, d)),
    }


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.resolve_attempts(X.number_attempts(attempt_rows(spark, sf_dir)))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error-log entries: unresolved calls; ``seen`` = first event of the call."""
    a = X.number_attempts(attempt_rows(spark, sf_dir))
    first = a.groupBy(*X.CALL).agg(F.min("event_id").alias("seen"))
    bad = X.resolve_attempts(a).where(~F.col("resolved")).select(*X.CALL)
    return bad.join(first, list(X.CALL))


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditframe.plans.reports import valid_results

    # written once: the upsert reads its tables several times
    v = cut_lineage(valid_results(scored_results(spark, sf_dir)).select("sample_id", "similarity", "model", "sample_index"))
    base = v.where(F.col("model") == MODELS[0]).select("sample_id", "similarity", F.col("sample_index").alias("position"))
    upd = v.where(F.col("model") != MODELS[0]).select(
        "sample_id", "similarity", F.when(F.col("model") == MODELS[1], 1).otherwise(2).alias("version")
    )
    return X.upsert(base, upd)


def _delta_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 on the delta store: one model's results, then the other models' as a delta."""
    from auditframe.plans.reports import valid_results
    from auditframe.streaming.delta import DeltaStore

    v = cut_lineage(valid_results(scored_results(spark, sf_dir)).select("sample_id", "similarity", "model", "sample_index"))
    root = f"{checkpoint_dir(spark).rstrip('/')}/auditframe-delta-{uuid.uuid4().hex}"
    track(root)
    store = DeltaStore(spark, root, "sample_id string, similarity string")
    store.upsert(v.where(F.col("model") == MODELS[0]).select("sample_id", "similarity", F.col("sample_index").alias("version")))
    store.upsert(v.where(F.col("model") != MODELS[0]).select(
        "sample_id", "similarity", F.when(F.col("model") == MODELS[1], 1).otherwise(2).alias("version")))
    return store.read()


def inference_queries() -> dict[str, Query]:
    return {
        "x4_attempt_resolution": lambda s, d: _resolved(s, d).select(
            "sample_id", "phase", "call_no", "attempts_used", "resolved", "winning_attempt", "payload", "issue_message"
        ),
        "j7_rerun_selection": lambda s, d: X.rerun_selection(sample_rows(s, d), _issues(s, d)).select(
            "sample_id", "rerun_order", "commit_id", "project"
        ),
        "a15_rerun_summary": lambda s, d: X.rerun_summary(_issues(s, d)),
        "s8_result_upsert": _upsert,
        "s8_delta_upsert": _delta_upsert,
    }


def phase_queries() -> dict[str, Query]:
    from auditframe.functions.jsonfix import redacted
    from auditframe.plans import phases as H
    from auditframe.plans.run import DEFAULT_TEMPLATES, normalized_samples, phase_c_prompts, recorded_reports
    from auditframe.plans.views import nested_details, response_rows

    def reports(spark: SparkSession, sf_dir: str, *columns: str, names=H.PHASES) -> DataFrame:
        return recorded_reports(normalized_samples(sample_rows(spark, sf_dir)), response_rows(spark, sf_dir), names, columns)

    def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The issue records; the attempts of a failed call as one text each."""
        d = F.col("details")
        tried = F.transform(F.coalesce(d["attempts"], F.array()), lambda a: F.concat_ws(
            "|", a["attempt"].cast("string"), a["error_type"], a["message"], a["status_code"].cast("string"), a["request_id"], a["finish_reason"], a["model_output"]))
        return H.issues_of(reports(spark, sf_dir, "issue")).select(
            "sample_id", "phase", "error_type", "message", F.array_join(tried, " / ").alias("attempts"), d["model_output"].alias("model_output"),
            d["cause_chain"][0]["error_type"].alias("cause_type"), d["cause_chain"][0]["message"].alias("cause_message"))

    def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
        """J3 + P28: the phase C prompts over the reports of A and B."""
        samples = normalized_samples(sample_rows(spark, sf_dir))
        return phase_c_prompts(samples, reports(spark, sf_dir, "sample_id", "phase", "report", names=("A", "B")), DEFAULT_TEMPLATES).select("sample_id", "user_prompt")

    return {
        "x2_phase_reports": lambda s, d: reports(s, d, "sample_id", "phase", "state", "attempts_used", "report", "violations").select(
            "sample_id", "phase", "state", "attempts_used", "report", F.size("violations").cast("bigint").alias("violations")),
        "f9_f11_violations": lambda s, d: H.violations_of(reports(s, d, "sample_id", "phase", "violations")),
        "x5_issues": issues,
        "j3_phase_c_prompts": prompts,
        "p31_result_rows": lambda s, d: H.flatten(H.wide_reports(normalized_samples(sample_rows(s, d)), reports(s, d, "sample_id", "phase", "report"))),
        "p22_redacted_details": lambda s, d: nested_details(s, d).select("event_id", F.to_json(redacted(F.col("details"))).alias("details")),
    }


def reposvul_queries() -> dict[str, Query]:
    from auditframe.plans import reposvul as RV
    from auditframe.plans.views import reposvul_files, reposvul_records

    def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the diff text is difflib's; everything else is compared by SQL
        return RV.convert_reposvul(reposvul_records(spark, sf_dir), reposvul_files(spark, sf_dir)).drop("diff", "diff_length")

    def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        return RV.reposvul_counts(RV.convert_reposvul(reposvul_records(spark, sf_dir), reposvul_files(spark, sf_dir)))

    def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = RV._filtered(reposvul_records(spark, sf_dir), False).where(F.col("reason").isNull()).drop("reason")
        return RV._folded(f).select(
            "function_id", "record_index", F.to_json("cwes").alias("cwe"), F.col("copies").cast("bigint").alias("copies")
        )

    return {"d4_reposvul_conversion": d4, "a10_reposvul_counts": counts, "a12_function_fold": a12}


def key_queries() -> dict[str, Query]:
    from auditframe.operators import keys as K
    from auditframe.plans.run import normalized_samples
    from auditframe.sources.tables import table

    def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Every order's sample, asked for newest key first."""
        asked = table(spark, sf_dir, "orders").select(
            F.concat(F.lit("o_"), F.col("o_orderkey").cast("string")).alias("sample_id"), (-F.col("o_orderkey")).alias("request_order"))
        return K.lookup_in_order(sample_rows(spark, sf_dir), asked, in_plan=True).select("sample_id", "request_order", "commit_id", "project")

    def absent(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Samples named by model calls that are not in the input."""
        return K.missing_ids(attempt_rows(spark, sf_dir), sample_rows(spark, sf_dir))

    def united(spark: SparkSession, sf_dir: str) -> DataFrame:
        """U8: tables with different columns under one header."""
        frames = [table(spark, sf_dir, t).select(*c) for t, c in (
            ("customer", ("c_custkey", "c_name")), ("supplier", ("s_suppkey", "s_name")), ("nation", ("n_nationkey", "n_name")))]
        return K.union_all_columns(frames, ("note",))

    return {
        "j1_lookup_in_order": lookup, "j9_missing_ids": absent, "u8_union_columns": united,
        "u7_repeated_ids": lambda s, d: K.repeated_ids(attempt_rows(s, d)),
        "p28_sample_defaults": lambda s, d: normalized_samples(sample_rows(s, d)),
    }


def source_queries() -> dict[str, Query]:
    from auditframe.sources.files import csv_cells
    from auditframe.sources.tables import table

    def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
        k = F.col("doc_id")
        typed = d.select(
            k.alias("doc_id"),
            F.when(F.pmod(k, F.lit(5)) == 0, F.lit("=1+1")).when(F.pmod(k, F.lit(5)) == 1, F.concat(F.lit("-"), "lang"))
            .when(F.pmod(k, F.lit(5)) == 2, F.lit(None).cast("string")).otherwise(F.col("lang")).alias("label"),
            (F.col("n_chars") > 1000).alias("long_text"),
            F.array("lang", "source").alias("tags"),
            F.concat("source", F.lit("\u0000"), "lang").alias("raw"),
        )
        return csv_cells(typed)

    def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
        from auditframe.functions import text as T

        p = table(spark, sf_dir, "pages").select("page_id", "url")
        r = F.pmod(F.col("page_id"), F.lit(4))
        url = (F.when(r == 1, F.replace("url", F.lit("://"), F.lit("://user:secret@")))
               .when(r == 2, F.replace("url", F.lit(".example."), F.lit(".EXAMPLE.")))
               .when(r == 3, F.regexp_replace("url", r"(://[^/?#]+)", "$1:8080"))
               .otherwise(F.col("url")))
        p = p.withColumn("url", url)
        return p.select("page_id", T.safe_base_url(F.col("url")).alias("base_url"),
                        T.safe_filename(F.concat(F.lit("page/"), F.col("url"))).alias("file_key"))

    return {"s10_csv_cells": s10, "p23_p32_url_keys": urls}


def _shipped(query: Query) -> Query:
    """The query, run after the package was sent to the executors: its Python
    functions then import there, whatever folder the workers start in."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(score_queries())
    out.update(consensus_queries())
    out.update(pair_queries())
    out.update(inference_queries())
    out.update(phase_queries())
    out.update(reposvul_queries())
    out.update(key_queries())
    out.update(source_queries())
    return {name: _shipped(query) for name, query in out.items()}
