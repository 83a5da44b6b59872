"""Model-call bookkeeping: attempt resolution (X4), issues (X5), rerun
selection (F15, U9, J7, A15) and the result-table upsert (S8, U6).

Model calls have side effects and cost, so the plan is: write the raw
``attempts`` table once (``cut_lineage`` / a table in the shared checkpoint
folder), then derive resolutions, issues and reruns from it, so task retries
never call a model twice. ``call_model`` runs a user-supplied batch callable
per partition with ``mapInPandas`` (X1).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.functions import text as T
from auditframe.functions import variant as V
from auditframe.functions.jsonfix import decode_model_json
from auditframe.operators.keys import require_unique
from auditframe.operators.ordinals import with_group_ordinal, with_ordinal

MAX_ATTEMPTS = 3


CALL = ("sample_id", "phase", "call_no")


def number_attempts(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Recorded attempts, all of them, in time order per (sample, phase): a call
    makes up to ``max_attempts``, so the next attempt begins another call
    (``call_no`` from 1, ``attempt`` from 1 within it)."""
    if max_attempts < 1:
        raise ValueError("max_attempts must be at least 1")
    n = with_group_ordinal(attempts, ["sample_id", "phase"], ["event_ts", "event_id"], "_n")
    return n.withColumns({
        "call_no": F.floor((F.col("_n") - 1) / max_attempts) + 1, "attempt": F.pmod(F.col("_n") - 1, F.lit(max_attempts)) + 1}).drop("_n")


def resolve_attempts(attempts: DataFrame) -> DataFrame:
    """The first attempt of a call that is not truncated and decodes (fence
    unwrapped, repaired by P20) to a JSON object wins; otherwise the call is an
    issue that keeps the redacted message of its last attempt. Without a
    ``call_no`` all attempts of a (sample, phase) are one call."""
    call = [c for c in CALL if c in attempts.columns]
    decoded = decode_model_json(T.unwrap_code_fence(F.col("model_output")))
    usable = F.col("error_type").isNull() & (F.coalesce(F.col("finish_reason"), F.lit("")) != "length")
    a = attempts.withColumn("_j", decoded).withColumn("_ok", usable & V.is_object(F.col("_j"))).withColumn("_body", F.to_json("_j"))
    return a.groupBy(*call).agg(
        F.count("*").alias("attempts_made"),
        F.min(F.when(F.col("_ok"), F.col("attempt"))).alias("winning_attempt"),
        F.min_by(F.col("_body"), F.when(F.col("_ok"), F.col("attempt"))).alias("payload"),
        F.max_by(T.safe_diagnostic_text(F.col("message"), 2000), F.col("attempt")).alias("last_message"),
    ).select(
        *call,
        F.coalesce(F.col("winning_attempt"), F.col("attempts_made")).cast("bigint").alias("attempts_used"),
        F.col("winning_attempt").isNotNull().alias("resolved"),
        "winning_attempt", "payload",
        F.when(F.col("winning_attempt").isNull(), F.col("last_message")).alias("issue_message"),
    )


def issue_log(resolved: DataFrame) -> DataFrame:
    """X5/S11 rows: one issue per unresolved call, in (sample, phase) order."""
    return resolved.where(~F.col("resolved")).select(
        F.current_timestamp().alias("timestamp_utc"), "sample_id", "phase",
        F.lit("ModelCallError").alias("error_type"), F.col("issue_message").alias("message"),
    )


def rerun_ids(issues: DataFrame) -> DataFrame:
    """F15 + U9: distinct failed ids in first-seen order; run-level entries
    (``[RUN]``) and blank ids are ignored."""
    sid = T.py_strip(F.coalesce(F.col("sample_id"), F.lit("")))
    valid = issues.withColumn("sample_id", sid).where((F.col("sample_id") != "") & (F.col("sample_id") != "[RUN]"))
    first = valid.groupBy("sample_id").agg(F.min("seen").alias("seen"))
    return with_ordinal(first, ["seen", "sample_id"], "rerun_order")


def rerun_selection(samples: DataFrame, issues: DataFrame) -> DataFrame:
    """The samples named in the error log, in first-seen order."""
    ids = rerun_ids(issues)
    return samples.join(ids, "sample_id", "inner").orderBy("rerun_order")


def rerun_summary(issues: DataFrame) -> DataFrame:
    """Entries, distinct failed samples (run-level entry excluded)."""
    sid = T.py_strip(F.coalesce(F.col("sample_id"), F.lit("")))
    return issues.agg(
        F.count("*").alias("issues"),
        F.count_distinct(F.when((sid != "") & (sid != "[RUN]"), sid)).alias("failed_samples"),
    )


def upsert(existing: DataFrame, updates: DataFrame, key: str = "sample_id") -> DataFrame:
    """Replace rows in place, append new ones, last write wins.

    ``updates`` carries ``version`` (larger = later); the winner per key is
    found with ``max_by`` (skew-safe aggregate); a replaced row keeps the
    position of the existing one, new rows follow in update order.
    """
    cols = [c for c in existing.columns if c not in (key, "position")]
    last = updates.groupBy(key).agg(F.max_by(F.struct(*cols, "version"), F.col("version")).alias("_u"))
    last = last.select(key, *[F.col(f"_u.{c}").alias(c) for c in cols], F.col("_u.version").alias("_v"))
    kept = existing.join(last.select(key), key, "left_anti").select(key, *cols, "position")
    replaced = existing.select(key, "position").join(last, key, "inner").select(key, *cols, "position")
    base_max = existing.agg(F.max("position").alias("_m"))
    new = last.join(existing.select(key), key, "left_anti")
    new = with_ordinal(new, ["_v", key], "_n")
    new = new.withColumn("_one", F.lit(1)).join(F.broadcast(base_max.withColumn("_one", F.lit(1))), "_one")
    new = new.select(key, *cols, (F.coalesce(F.col("_m"), F.lit(0)) + F.col("_n")).cast("bigint").alias("position"))
    return kept.unionByName(replaced).unionByName(new)


def checked_upsert(existing: DataFrame, updates: DataFrame, key: str = "sample_id", in_plan: bool = False) -> DataFrame:
    """S8 with the checks of the stored table: another header or a repeated id
    in it is an error (with ``in_plan`` the upsert's own jobs find it, the first of
    which number the new rows while the plan is built)."""
    have, want = set(existing.columns) - {"position"}, set(updates.columns) - {"version"}
    if have != want:
        raise ValueError(f"the result table has other columns: {sorted(have ^ want)}")
    return upsert(require_unique(existing, key, in_plan), updates, key)


def call_model(prompts: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
               schema: str) -> DataFrame:
    """Run a user-supplied batch model over rendered prompts.

    ``make_model()`` is called once per partition (the executor takes the
    place of the reference's worker process); the returned callable maps a
    pandas batch of prompts to a batch of attempt rows with ``schema``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            yield model(batch)

    return prompts.mapInPandas(run, schema)
