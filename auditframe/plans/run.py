"""Three-phase model run over a samples table.

samples -> render prompts A and B (P28) -> model hook (X1, ``mapInPandas``)
-> attempts table written once (exactly-once model calls; every later step
reads it) -> reports and issues (``plans/phases.py``); A and B joined on the sample
id (J3) -> prompt C -> the same chain -> the 26-column result row (P31).
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.functions import text as T
from auditframe.plans.phases import flatten, issues_of, normalize, phase_reports, wide_reports
from auditframe.session import cut_lineage, path_exists, replace_text

__all__ = ["DEFAULT_TEMPLATES", "call_phase", "normalize", "normalized_samples", "phase_documents", "render", "rerun", "run_resumable", "run_three_phases"]

# Prompt templates are job parameters (``str.format`` syntax). These short
# defaults carry the placeholders each phase needs; pass the production
# templates to ``run_three_phases``.
DEFAULT_TEMPLATES = {
    "A": {"system": "Locate the root cause from the code before the fix. Answer with strict JSON.",
          "user": "Bug type:\n{bug_type}\n\nCode before the fix:\n```c\n{func_before}\n```\n"},
    "B": {"system": "Explain the fix from both versions of the code. Answer with strict JSON.",
          "user": ("Bug type:\n{cwe_id}\n\nBefore:\n```c\n{func_before}\n```\n\nAfter:\n```c\n{func_after}\n```\n\n"
                   "Commit message:\n{commit_msg}\n\nDescription:\n{bug_description}\n")},
    "C": {"system": "Compare the two reports and score them. Answer with strict JSON.",
          "user": "Blind report:\n{blind_report}\n\nPatch-informed report:\n{omniscient_report}\n"},
}

ATTEMPT_SCHEMA = (
    "sample_id string, phase string, attempt bigint, error_type string, message string, "
    "status_code int, request_id string, finish_reason string, model_output string"
)


def render(template: str, values: dict[str, Column]) -> Column:
    """``str.format`` of a template with column values (``{{``/``}}``
    escapes). The template is split once on the driver; rows are filled by
    ``concat`` on the executors."""
    parts: list[Column] = []
    buf: list[str] = []
    i, n = 0, len(template)
    while i < n:
        ch = template[i]
        if ch in "{}" and i + 1 < n and template[i + 1] == ch:
            buf.append(ch)
            i += 2
            continue
        if ch == "{":
            j = template.index("}", i)
            name = template[i + 1:j]
            if name not in values:
                raise KeyError(name)
            if buf:
                parts.append(F.lit("".join(buf)))
                buf = []
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
            i = j + 1
            continue
        buf.append(ch)
        i += 1
    if buf:
        parts.append(F.lit("".join(buf)))
    return F.concat(*parts) if parts else F.lit("")


def normalized_samples(samples: DataFrame) -> DataFrame:
    """Input defaults (P2): anonymised text preferred, blanks and NA words
    become the default text; other fields default to ""."""
    cols = samples.columns

    def opt(name: str) -> Column | None:
        return F.col(name) if name in cols else None

    return samples.select(
        T.py_strip(F.col("sample_id")).alias("sample_id"),
        F.coalesce(F.col("func_before"), F.lit("")).alias("func_before"),
        F.coalesce(F.col("func_after"), F.lit("")).alias("func_after"),
        T.text_with_default(F.col("commit_msg"), T.DEFAULT_COMMIT_MSG, opt("commit_msg_anonymized")).alias("commit_msg"),
        T.text_with_default(F.col("bug_description"), T.DEFAULT_DESCRIPTION, opt("bug_description_anonymized")).alias(
            "bug_description"),
        *[T.text_with_default(F.col(c), "", na_words=True).alias(c) for c in ("commit_id", "project", "cwe")],
    )


def call_phase(prompts: DataFrame, model_factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """The model hook over (sample_id, phase, system_prompt, user_prompt);
    the attempts it returns are written once (``cut_lineage``) so a task
    retry or a second read never calls the model again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for batch in batches:
            yield model(batch)

    return cut_lineage(prompts.mapInPandas(run, ATTEMPT_SCHEMA))


def call_phase_once(
    prompts: DataFrame, model_factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], ledger: str, slices: int = 16,
) -> DataFrame:
    """X1 with an append-only ledger of attempts: the model is called only for
    (sample, phase) that the ledger does not hold yet.

    Prompts are called in ``slices`` by a hash of their sample, each one job that
    appends its attempts when all of it is done; what fails costs the calls of one
    slice, and a later run goes on behind the others. Returns the ledger's attempts
    of these prompts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for batch in batches:
            yield model(batch)

    spark, keys = prompts.sparkSession, ["sample_id", "phase"]
    prompts = cut_lineage(prompts.withColumn("_slice", F.pmod(F.xxhash64("sample_id"), F.lit(slices)).cast("int")))
    for i in range(slices):
        part = prompts.where(F.col("_slice") == i).drop("_slice")
        if path_exists(spark, ledger):
            part = part.join(spark.read.schema(ATTEMPT_SCHEMA).parquet(ledger).select(*keys), keys, "left_anti")
        if not part.isEmpty():
            part.select("sample_id", "phase", "system_prompt", "user_prompt").mapInPandas(run, ATTEMPT_SCHEMA).write.mode("append").parquet(ledger)
    if not path_exists(spark, ledger):
        return spark.createDataFrame([], ATTEMPT_SCHEMA)
    return spark.read.schema(ATTEMPT_SCHEMA).parquet(ledger).join(prompts.select(*keys), keys, "left_semi")


def phase_c_prompts(samples: DataFrame, reports: DataFrame, templates: dict[str, dict[str, str]]) -> DataFrame:
    """P28 for phase C: both reports of a sample as JSON texts in its prompt."""
    t = templates["C"]
    return wide_reports(samples, reports).select(
        "sample_id", F.lit("C").alias("phase"), F.lit(t["system"]).alias("system_prompt"),
        render(t["user"], {"blind_report": F.col("report_A"), "omniscient_report": F.col("report_B")}).alias("user_prompt"))


def recorded_reports(samples: DataFrame, attempts: DataFrame, phases: Sequence[str], columns: Sequence[str] = ("*",)) -> DataFrame:
    """X2 of some phases, written once: prompts, issues and results read the same rows.
    ``columns`` are those that are read, so that no others are worked out and kept."""
    parts = [phase_reports(samples, attempts, p).select(*columns) for p in phases]
    return cut_lineage(functools.reduce(DataFrame.unionByName, parts))


def _first_prompts(s: DataFrame, t: dict[str, dict[str, str]]) -> DataFrame:
    """P28 for the phases A and B of normalised samples."""
    vals = {c: F.col(c) for c in s.columns}
    vals["bug_type"] = vals["cwe_id"] = F.col("cwe")
    parts = [s.select("sample_id", F.lit(p).alias("phase"), F.lit(t[p]["system"]).alias("system_prompt"),
                      render(t[p]["user"], vals).alias("user_prompt")) for p in ("A", "B")]
    return parts[0].unionByName(parts[1])


def _three_phases(samples: DataFrame, call: Callable[[DataFrame], DataFrame], templates: dict | None) -> tuple[DataFrame, DataFrame]:
    t = templates or DEFAULT_TEMPLATES
    s = cut_lineage(normalized_samples(samples))
    reports = recorded_reports(s, call(_first_prompts(s, t)), ("A", "B"))
    reports = reports.unionByName(recorded_reports(s, call(phase_c_prompts(s, reports, t)), ("C",)))
    issues = issues_of(reports).select(F.current_timestamp().alias("timestamp_utc"), "*")
    return flatten(wide_reports(s, reports)), issues


def run_three_phases(
    samples: DataFrame,
    model_factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    templates: dict[str, dict[str, str]] | None = None,
    workers: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Results (26 columns) and issues for every sample.

    ``workers`` repartitions the prompts before the model call (the
    worker processes of a single machine become tasks)."""
    return _three_phases(samples, lambda p: call_phase(p.repartition(workers) if workers else p, model_factory), templates)


def run_resumable(
    samples: DataFrame,
    model_factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    root: str,
    templates: dict[str, dict[str, str]] | None = None,
    slices: int = 16,
) -> str:
    """X7 as a job that can be run again after a failure: attempts are kept in the
    ledger ``root/ledger`` and no call is made twice (``rerun`` is for calls whose
    attempts failed). Results, phase documents and issues are written beside each
    other and appear together, when ``root/current`` names their folder; returns it."""
    spark = samples.sparkSession
    results, issues = _three_phases(samples, lambda p: call_phase_once(p, model_factory, f"{root}/ledger", slices), templates)
    results = cut_lineage(results)
    folder = f"run-{uuid.uuid4().hex}"
    results.write.parquet(f"{root}/{folder}/results")
    phase_documents(results).write.partitionBy("phase").json(f"{root}/{folder}/documents")
    issues.write.json(f"{root}/{folder}/issues")
    replace_text(spark, f"{root}/current", folder)
    return folder


def current_run(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame] | None:
    """(results, phase documents) of the last complete ``run_resumable``, or None."""
    if not path_exists(spark, f"{root}/current"):
        return None
    folder = spark.read.option("wholetext", True).text(f"{root}/current").first()[0]
    return spark.read.parquet(f"{root}/{folder}/results"), spark.read.json(f"{root}/{folder}/documents")


def phase_documents(full_results: DataFrame) -> DataFrame:
    """One long table (phase, storage key, body) for per-phase documents;
    write with ``.write.partitionBy("phase").json(path)``."""
    key = T.safe_filename(F.col("sample_id"))
    return full_results.select(
        key.alias("file_key"), "sample_id",
        F.inline(F.array(
            F.struct(F.lit("phase_a").alias("phase"), F.col("phase_a_raw").alias("body")),
            F.struct(F.lit("phase_b").alias("phase"), F.col("phase_b_raw").alias("body")),
            F.struct(F.lit("phase_c").alias("phase"), F.col("phase_c_raw").alias("body")),
            F.struct(F.lit("combined").alias("phase"), F.to_json(F.struct(*full_results.columns)).alias("body")),
        )),
    )


def rerun(
    samples: DataFrame,
    error_log: DataFrame,
    model_factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    existing: DataFrame | None = None,
    templates: dict[str, dict[str, str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Samples named in an error log (F15 entries with ``sample_id`` and
    ``line``) are run again and upserted into the existing results; returns
    (results table, remaining issues). Run-level entries are ignored (U9)."""
    from auditframe.plans.inference import rerun_selection, upsert

    entries = error_log.where(F.col("reason").isNull()).select("sample_id", F.col("line").alias("seen"))
    chosen = rerun_selection(samples, entries).drop("seen", "rerun_order")
    results, issues = run_three_phases(chosen, model_factory, templates)
    if existing is None:
        return results, issues
    if "position" not in existing.columns:
        raise ValueError("the existing results need their stored order in a position column")
    ordered = existing
    updates = results.withColumn("version", F.lit(1))
    return upsert(ordered, updates), issues
