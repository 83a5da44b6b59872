"""Pair building and deduplication: D1, D2, D3, D5, D11, D12.

Every converter returns one DataFrame with a nullable ``reason`` column:
written rows have ``reason IS NULL``, rejects carry the reason (S14), and the
counters are one conditional aggregate over it (A10). Duplicate rules find
the winner with an aggregate joined back on the key -- partial aggregation
keeps a hot key from landing in one task -- and group by the 64-character
SHA-256 pair key, never by the function bodies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import score as S
from auditframe.functions import text as T
from auditframe.functions import variant as V
from auditframe.functions.udfs import unified_diff
from auditframe.operators.ordinals import with_group_ordinal, with_ordinal, with_running_sums
from auditframe.operators.quantiles import interpolated, ranked_counts
from auditframe.session import cut_lineage

# Dataset name -> sample-id fallback prefix.
SAMPLE_PREFIX = {"vulnerability_score": "vscore"}
# Pair-table columns in order.
PAIR_COLUMNS = (
    "sample_id", "commit_id", "commit_short", "project", "func_before", "func_after",
    "diff", "diff_length", "commit_msg", "cwe", "commit_msg_anonymized",
)


def source_fields(df: DataFrame) -> DataFrame:
    """Dataset-specific mapping to (url, message, project, raw CWE).
    titanvul: commit_link / commit_message; benchvul: commit_link / commit_msg /
    repo_name; vulnerability_score (and the generic layout): commit_url /
    commit_msg. The pair view carries one set of columns for all layouts."""
    explicit = F.when(F.col("dataset") == "benchvul", T.clean("repo_name")).otherwise(F.lit(""))
    return df.withColumns(
        {
            "_url": T.clean("commit_url"),
            "_msg": T.clean("commit_msg"),
            "_explicit_project": explicit,
            "_raw_cwe": T.clean("cwe_id"),
        }
    )


def bodies(rows: DataFrame) -> DataFrame:
    """(dataset, doc_id, pair_key, func_before, func_after): the cleaned function
    texts, once per key; rows of one pair key have the same ones."""
    return rows.select(
        "dataset", "doc_id", T.pair_key(F.col("func_before"), F.col("func_after")).alias("pair_key"),
        T.clean("func_before").alias("func_before"), T.clean("func_after").alias("func_after"),
    ).dropDuplicates(["dataset", "doc_id", "pair_key"])


def join_null_safe(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Inner join on ``keys`` (left column -> right column) in which null equals
    null; the right side's key columns go."""
    to = {k: f"_right_{i}" for i, k in enumerate(keys.values())}
    r = right.withColumnsRenamed(to)
    on = [left[a].eqNullSafe(r[to[b]]) for a, b in keys.items()]
    return left.join(r, on).drop(*to.values())


def convert_paired(rows: DataFrame) -> DataFrame:
    """D1 for every dataset at once (partitioned by ``dataset``).

    F4 (missing / unchanged), U1 (first pair wins inside a dataset), P3..P7.
    Returns all input rows with ``row`` (1-based per dataset) and ``reason``,
    without the function texts: only their key travels through the numbering
    and the winner rule; ``attach_bodies`` joins the texts to the rows wanted.
    """
    before, after = T.clean("func_before"), T.clean("func_after")
    pre = F.when((before == "") | (after == ""), F.lit("missing_function")).when(before == after, F.lit("unchanged_pair"))
    narrow = source_fields(rows.withColumns({"pair_key": T.pair_key(F.col("func_before"), F.col("func_after")), "_pre": pre})).select(
        "dataset", "dataset_ord", "doc_id", "pair_key", "_pre", "_url", "_msg", "_explicit_project", "_raw_cwe")
    df = with_group_ordinal(narrow, ["dataset"], ["doc_id"], "row")
    firsts = df.where(F.col("_pre").isNull()).groupBy("dataset", "pair_key").agg(F.min("row").alias("_first"))
    # rows with a reason need no winner: a null key keeps blank pairs from meeting in one task
    df = df.withColumn("_key", F.when(F.col("_pre").isNull(), F.col("pair_key")))
    df = df.join(firsts.withColumnRenamed("pair_key", "_key"), ["dataset", "_key"], "left")
    reason = F.coalesce(F.col("_pre"), F.when(F.col("row") > F.col("_first"), F.lit("duplicate_pair")))
    df = df.withColumn("reason", reason)
    commit = T.commit_id_from_url(F.col("_url"))
    fallback = F.coalesce(F.element_at(F.create_map(*[x for k, v in SAMPLE_PREFIX.items() for x in (F.lit(k), F.lit(v))]),
                                       F.col("dataset")), F.col("dataset"))
    df = df.withColumn("commit_id", commit)
    return df.select(
        "dataset", "dataset_ord", "doc_id", "row", "reason", "pair_key",
        T.sample_id(F.col("commit_id"), fallback, F.col("row")).alias("sample_id"),
        "commit_id",
        F.left("commit_id", F.lit(8)).alias("commit_short"),
        F.when(F.col("_explicit_project") != "", F.col("_explicit_project"))
        .otherwise(T.project_from_url(F.col("_url"))).alias("project"),
        F.col("_msg").alias("commit_msg"),
        T.cwe_json(T.cwe_values(F.col("_raw_cwe"))).alias("cwe"),
        F.lit("").alias("commit_msg_anonymized"),
    )


def attach_bodies(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The chosen pairs with their function texts, joined once by (dataset, doc_id,
    pair_key): ids that are null or repeated neither lose a pair nor multiply it."""
    return join_null_safe(pairs, bodies(rows), {k: k for k in ("dataset", "doc_id", "pair_key")})


def with_diff(pairs: DataFrame) -> DataFrame:
    """P8 on written rows only: the Python diff runs after every filter."""
    d = pairs.withColumn("diff", unified_diff(F.col("func_before"), F.col("func_after")))
    return d.withColumn("diff_length", F.length("diff"))


def pair_table(rows: DataFrame) -> DataFrame:
    """D1 output: dataset and the 11 pair columns of every written pair."""
    written = convert_paired(rows).where(F.col("reason").isNull())
    return with_diff(attach_bodies(written, rows)).select("dataset", *PAIR_COLUMNS)


def dedup_table(rows: DataFrame) -> DataFrame:
    """D5 output: the owners' rows with merged metadata and recomputed diff."""
    owners = deduplicate(convert_paired(rows).where(F.col("reason").isNull())).where("emit")
    for c in ("commit_id", "commit_short", "project", "commit_msg", "cwe"):
        owners = owners.withColumn(c, F.col(f"m_{c}"))
    return with_diff(attach_bodies(owners, rows)).select("dataset", *PAIR_COLUMNS)


def conversion_counts(converted: DataFrame) -> DataFrame:
    """A10: read / written / invalid / unchanged / duplicates per dataset;
    read = written + invalid + unchanged + duplicates."""
    r = F.col("reason")
    return converted.groupBy("dataset").agg(
        F.count("*").alias("read"),
        F.count_if(r.isNull()).alias("written"),
        F.count_if(r == "missing_function").alias("invalid"),
        F.count_if(r == "unchanged_pair").alias("unchanged"),
        F.count_if(r == "duplicate_pair").alias("duplicates"),
    )


def deduplicate(pairs: DataFrame) -> DataFrame:
    """D5 / U2 + A11: across datasets in priority order (``dataset_ord``), the
    first dataset holding a pair key owns it and emits it once, with metadata
    merged over all datasets: first non-blank commit id / short / project /
    message in (priority, row) order and the order-preserving union of CWEs.

    Returns every input row with ``owner``, ``first_in_dataset`` and the
    merged metadata; owners are the rows with ``emit``.
    """
    p = pairs.withColumn("_pos", F.struct("dataset_ord", "row"))
    ordered = F.struct(F.col("dataset_ord"), F.col("row"))
    merged = p.groupBy("pair_key").agg(
        F.min("dataset_ord").alias("owner_ord"),
        *[
            F.coalesce(F.min_by(T.clean(F.col(c)), F.when(T.clean(F.col(c)) != "", ordered)), F.lit("")).alias(f"m_{c}")
            for c in ("commit_id", "commit_short", "project", "commit_msg")
        ],
    )
    # CWE union: explode each copy's list, keep every CWE's first position
    # (aggregate), then collect the distinct CWEs of a key in that order --
    # the list is bounded by the CWE vocabulary, not by the number of copies
    each = p.select("pair_key", ordered.alias("_o"),
                    F.posexplode(T.cwe_values(F.col("cwe"))).alias("_i", "_c"))
    firsts_cwe = each.groupBy("pair_key", "_c").agg(F.min(F.struct("_o", "_i")).alias("_at"))
    cwe_union = firsts_cwe.groupBy("pair_key").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_c"))), lambda x: x["_c"])).alias("m_cwe"))
    merged = merged.join(cwe_union, "pair_key", "left").withColumn("m_cwe", F.coalesce("m_cwe", F.lit("[]")))
    firsts = p.groupBy("dataset", "pair_key").agg(F.min("row").alias("_first_row"))
    out = p.join(merged, "pair_key").join(firsts, ["dataset", "pair_key"])
    return out.withColumns(
        {
            "first_in_dataset": F.col("row") == F.col("_first_row"),
            "emit": (F.col("row") == F.col("_first_row")) & (F.col("dataset_ord") == F.col("owner_ord")),
        }
    ).drop("_pos", "_first_row")


def dedup_counts(dedup: DataFrame) -> DataFrame:
    """Read / written / within / cross per dataset; read = written +
    within + cross."""
    first = F.col("first_in_dataset")
    return dedup.groupBy("dataset").agg(
        F.count("*").alias("read"),
        F.count_if("emit").alias("written"),
        F.count_if(~first).alias("within_dataset_duplicates"),
        F.count_if(first & (F.col("dataset_ord") != F.col("owner_ord"))).alias("cross_dataset_duplicates"),
    )


# ------------------------------------------------------------------ D2 PrimeVul
def parse_turn_lines(lines: DataFrame) -> DataFrame:
    """Lines of merged JSONL sources (source, line, value) -> the records that
    ``pair_adjacent`` takes. Blank lines are skipped; a line that is not JSON or
    not an object resets the pairing and keeps ``line_reason``."""
    v = F.col("v")
    parsed = lines.where(~T.is_blank(F.col("value"))).select("source", "line", F.try_parse_json("value").alias("v"))
    text = {"func": "func", "commit_id": "commit_id", "cve": "cve", "project": "project", "commit_message": "commit_message", "cwe": "cwe"}
    cwe = F.coalesce(F.array_join(F.try_variant_get(v, "$.cwe", "array<string>"), ", "), F.try_variant_get(v, "$.cwe", "string"))
    return parsed.select(
        "source", "line", (~V.is_object(v)).alias("invalid_line"),
        F.when(v.isNull(), F.lit("invalid_json")).when(~V.is_object(v), F.lit("invalid_record")).alias("line_reason"),
        F.try_variant_get(v, "$.target", "int").alias("target"),
        *[(cwe if name == "cwe" else F.try_variant_get(v, f"$.{field}", "string")).alias(name) for name, field in text.items()],
    )


def line_rejects(records: DataFrame) -> DataFrame:
    """The lines that ``parse_turn_lines`` could not take."""
    return records.where("line_reason is not null").select("source", "line", F.col("line_reason").alias("reason"))


def adjacent_counts(pairs: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """A10 of D2: pairs read, written, invalid, unchanged; ``skipped_lines``
    counts unreadable lines when the records are given."""
    r = F.col("reason")
    out = pairs.agg(
        F.count("read_pairs").alias("read"), F.count_if(r.isNull()).alias("written"),
        F.count_if(r.isNotNull() & (r != "unchanged_pair")).alias("invalid"), F.count_if(r == "unchanged_pair").alias("unchanged"))
    if records is None:
        return out
    bad = records.agg(F.count_if("invalid_line").alias("skipped_lines"))
    return out.withColumn("_k", F.lit(1)).join(bad.withColumn("_k", F.lit(1)), "_k").drop("_k")


def pair_adjacent(records: DataFrame) -> DataFrame:
    """W1 + W8: adjacent-record pairing per source (gaps and islands).

    An unreadable line or a non-object ends the waiting record silently; the
    remaining valid records of a segment pair up two by two; a record still
    waiting at the end of a source is an ``unpaired_final_record`` reject.
    ``read_pairs`` numbers the pairs across sources in (source, line) order.

    No window is partitioned by source (one source may hold a large share of
    all lines): a global running count of unreadable lines (range-partitioned
    prefix sums) gives each line its segment; per-source and per-segment
    aggregates, joined back, give the segment-local rank; the partner is the
    next rank in the same segment, found by an equi-join on a unique key.
    """
    bad = F.col("invalid_line").cast("int")
    # function texts do not travel through the numbering; they are joined to the
    # pairs by their digest, so null or repeated (source, line) cannot mix them
    func = T.clean("func")
    keyed = records.withColumn("_digest", F.sha2(func, 256))
    run = with_running_sums(keyed.drop("func"), ["source", "line"], {"bad_run": bad})
    # valid lines up to and including this one (global), for valid rows
    run = run.withColumn("valid_run", F.col("ordinal") - F.col("bad_run"))
    per_source = run.groupBy("source").agg(
        F.min_by(F.col("bad_run") - bad, F.col("ordinal")).alias("_bad0"),
        F.sum(bad).alias("_last_seg"),
    )
    lines = run.join(per_source, "source").withColumn("_seg", F.col("bad_run") - F.col("_bad0"))
    valid = lines.where(~F.col("invalid_line"))
    seg_start = valid.groupBy("source", "_seg").agg(F.min("valid_run").alias("_v0"))
    valid = valid.join(seg_start, ["source", "_seg"]).withColumn("_rn", F.col("valid_run") - F.col("_v0") + 1)
    fields = [c for c in keyed.columns if c not in ("source", "invalid_line", "func")]
    firsts = valid.where(F.col("_rn") % 2 == 1).select("source", "_seg", "_rn", "_last_seg",
                                                        F.struct(*fields).alias("_b"))
    seconds = valid.where(F.col("_rn") % 2 == 0).select(
        "source", "_seg", (F.col("_rn") - 1).alias("_rn"), F.struct(*fields).alias("_next"))
    matched = firsts.join(seconds, ["source", "_seg", "_rn"], "left")
    pairs = matched.where(F.col("_next").isNotNull()).withColumn("line", F.col("_b")["line"])
    tail = matched.where(F.col("_next").isNull() & (F.col("_seg") == F.col("_last_seg")))
    pairs = with_ordinal(pairs, ["source", "line"], "read_pairs").withColumns(
        {"_line2": F.col("_next")["line"], "_digest": F.col("_b")["_digest"], "_digest2": F.col("_next")["_digest"]})
    text = keyed.select("source", "line", "_digest", func.alias("_before")).dropDuplicates(["source", "line", "_digest"])
    pairs = join_null_safe(pairs, text, {"source": "source", "line": "line", "_digest": "_digest"})
    pairs = join_null_safe(pairs, text.withColumnRenamed("_before", "_after"), {"source": "source", "_line2": "line", "_digest2": "_digest"})
    b, a = F.col("_b"), F.col("_next")
    before, after = F.col("_before"), F.col("_after")
    reason = (
        # null-safe: a missing target is out of order, a missing id differs from a present one
        F.when(~b["target"].eqNullSafe(F.lit(1)) | ~a["target"].eqNullSafe(F.lit(0)), F.lit("invalid_target_order"))
        .when(~b["commit_id"].eqNullSafe(a["commit_id"]) | ~b["cve"].eqNullSafe(a["cve"]), F.lit("metadata_mismatch"))
        .when((before == "") | (after == ""), F.lit("missing_function"))
        .when(before == after, F.lit("unchanged_pair"))
    )
    commit = T.clean(b["commit_id"])
    out = pairs.select(
        "source",
        F.col("line").alias("first_line"),
        "read_pairs",
        reason.alias("reason"),
        T.sample_id(commit, "primevul", F.col("read_pairs")).alias("sample_id"),
        commit.alias("commit_id"),
        F.left(commit, F.lit(8)).alias("commit_short"),
        T.clean(b["project"]).alias("project"),
        before.alias("func_before"),
        after.alias("func_after"),
        T.clean(b["commit_message"]).alias("commit_msg"),
        T.cwe_json(T.cwe_values(b["cwe"])).alias("cwe"),
    )
    rejects_tail = tail.select(
        "source", F.col("_b")["line"].alias("first_line"), F.lit(None).cast("bigint").alias("read_pairs"),
        F.lit("unpaired_final_record").alias("reason"),
    )
    return out.unionByName(rejects_tail, allowMissingColumns=True)


# ------------------------------------------------------------------ D3 MegaVul
def megavul_filter(records: DataFrame, max_diff_chars: int = 1500, max_function_chars: int = 5000,
                   max_function_lines: int = 500, with_texts: bool = False) -> DataFrame:
    """D3: F5 candidate test (``is_vul`` literally true, three non-blank
    strings) and F6 inclusive length limits; sample id uses the 0-based
    record index. ``reason`` is NULL (written), ``not_vulnerable``,
    ``invalid`` or ``filtered``; ``with_texts`` keeps the three texts."""
    for name, limit in (("max_diff_chars", max_diff_chars), ("max_function_chars", max_function_chars),
                        ("max_function_lines", max_function_lines)):
        if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
            raise ValueError(f"{name} must be a positive integer")
    b, a, d = F.col("func_before"), F.col("func"), F.col("diff_func")
    blank = T.is_blank(b) | T.is_blank(a) | T.is_blank(d)
    too_long = (
        (F.length(d) > max_diff_chars)
        | (F.length(b) > max_function_chars)
        | (F.length(a) > max_function_chars)
        | (T.line_count_splitlines(b) > max_function_lines)
        | (T.line_count_splitlines(a) > max_function_lines)
    )
    reason = (
        F.when(F.col("is_vul").isNull() | ~F.col("is_vul"), F.lit("not_vulnerable"))
        .when(blank, F.lit("invalid"))
        .when(too_long, F.lit("filtered"))
    )
    commit = T.py_strip(F.coalesce(F.col("commit_hash"), F.lit("")))
    return records.select(
        "record_index",
        reason.alias("reason"),
        T.sample_id(commit, "megavul", F.col("record_index")).alias("sample_id"),
        commit.alias("commit_id"),
        F.left(commit, F.lit(8)).alias("commit_short"),
        F.coalesce(F.col("repo_name"), F.lit("")).alias("project"),
        F.length(d).alias("diff_length"),
        F.coalesce(F.col("commit_msg"), F.lit("")).alias("commit_msg"),
        F.to_json(F.coalesce(F.col("cwe_ids"), F.array().cast("array<string>"))).alias("cwe"),
        *([b, a.alias("func_after"), d.alias("diff")] if with_texts else []),
    )


def megavul_counts(filtered: DataFrame) -> DataFrame:
    r = F.col("reason")
    return filtered.agg(
        F.count("*").alias("read"),
        F.count_if(r.isNull() | (r != "not_vulnerable")).alias("candidates"),
        F.count_if(r.isNull()).alias("written"),
        F.count_if(r == "filtered").alias("filtered"),
        F.count_if(r == "invalid").alias("invalid"),
    )


# ------------------------------------------------------------------ D11
def oversized_fields(df: DataFrame, columns: Sequence[str], max_field_length: int = 131072) -> DataFrame:
    """F8: rows with any field longer than ``max_field_length`` go to the
    excluded side with the offending lengths (null counts as 0)."""
    lengths = F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]),
        F.array(*[F.coalesce(F.length(F.col(c)), F.lit(0)) for c in columns]),
    )
    over = F.map_filter(lengths, lambda k, v: v > max_field_length)
    return df.withColumn("oversized", over).withColumn("excluded", F.size("oversized") > 0)


# ------------------------------------------------------------------ D12
# Length-profile bins (right-closed) and percentiles.
CHAR_BINS = (500, 1000, 2000, 5000, 10000, 20000, 50000, 100000)
CHAR_LABELS = ("<=500", "501-1000", "1001-2000", "2001-5000", "5001-10000", "10001-20000",
               "20001-50000", "50001-100000", ">100000")
LINE_BINS = (10, 20, 50, 100, 200, 500)
LINE_LABELS = ("<=10", "11-20", "21-50", "51-100", "101-200", "201-500", ">500")
PERCENTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


def _bin_label(v: Column, bins, labels) -> Column:
    out = F.when(v <= bins[0], F.lit(labels[0]))
    for edge, label in zip(bins[1:], labels[1:-1]):
        out = out.when(v <= edge, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def length_profile(pairs: DataFrame) -> DataFrame:
    """D12 / A9 (statistics part): per metric mean, sample std and nine
    linearly interpolated quantiles. Lengths are counted per value first; the
    quantiles are found by rank among the distinct lengths, spread over tasks."""
    counts = cut_lineage(_length_long(pairs).groupBy("metric", "value").agg(F.count("*").alias("_n"))).withColumn("value", F.col("value").cast("bigint"))
    n, total = F.sum("_n"), F.sum(F.col("value") * F.col("_n"))
    squares = F.sum((F.col("value") * F.col("value")).cast("decimal(38,0)") * F.col("_n"))
    # exact sums; one division each
    spread = (n.cast("decimal(20,0)") * squares.cast("decimal(38,0)") - total.cast("decimal(19,0)") * total.cast("decimal(19,0)")).cast("double")
    moments = counts.groupBy("metric").agg(
        n.alias("sample_count"), (total / n).alias("_mean"),
        F.when(n > 1, F.sqrt(spread / n.cast("double") / (n - 1).cast("double"))).alias("_std"))
    agg = moments.join(interpolated(ranked_counts(counts, ["metric"], "value", "_n"), ["metric"], "value", "_n", PERCENTILES), "metric")
    fmt = lambda c: F.format_number(c, 6)
    cols = [F.regexp_replace(fmt(F.col("_q")[i]), ",", "").alias(f"p{int(p * 100)}") for i, p in enumerate(PERCENTILES)]
    return agg.select(
        "metric", "sample_count",
        F.regexp_replace(fmt(F.col("_mean")), ",", "").alias("mean"),
        F.regexp_replace(fmt(F.col("_std")), ",", "").alias("std"),
        *cols,
    )


def _length_long(pairs: DataFrame) -> DataFrame:
    metrics = pairs.select(
        F.length("diff").alias("diff_characters"),
        T.line_count_newlines(F.col("diff")).alias("diff_lines"),
        F.length("func_before").alias("func_before_characters"),
        F.length("func_after").alias("func_after_characters"),
        T.line_count_newlines(F.col("func_before")).alias("func_before_lines"),
        T.line_count_newlines(F.col("func_after")).alias("func_after_lines"),
    )
    return metrics.unpivot([], list(metrics.columns), "metric", "value").where(F.col("value").isNotNull())


def length_bins(pairs: DataFrame) -> DataFrame:
    """D12 / A9 (bins part): right-closed bins per metric with counts and
    percentages (HALF_UP, 2 digits); all bins listed."""
    long = _length_long(pairs)
    is_line = F.col("metric").endswith("_lines")
    label = F.when(is_line, _bin_label(F.col("value"), LINE_BINS, LINE_LABELS)).otherwise(
        _bin_label(F.col("value"), CHAR_BINS, CHAR_LABELS)
    )
    counts = long.groupBy("metric", label.alias("bin")).agg(F.count("*").alias("count"))
    totals = long.groupBy("metric").agg(F.count("*").alias("total"))
    metrics = ["diff_characters", "diff_lines", "func_before_characters", "func_after_characters",
               "func_before_lines", "func_after_lines"]
    spark = pairs.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric")).select(
        "metric",
        F.explode(F.when(F.col("metric").endswith("_lines"), F.array(*[F.lit(x) for x in LINE_LABELS])).otherwise(
            F.array(*[F.lit(x) for x in CHAR_LABELS]))).alias("bin"),
    )
    out = grid.join(F.broadcast(counts), ["metric", "bin"], "left").join(F.broadcast(totals), "metric", "left")
    cnt = F.coalesce(F.col("count"), F.lit(0)).cast("bigint")
    total = F.coalesce(F.col("total"), F.lit(0))
    pct_hundredths = F.when(total == 0, F.lit(0)).otherwise(S.half_up_div(cnt * 10000, total))
    return out.select("metric", "bin", cnt.alias("count"), S.micro_text(pct_hundredths, 2).alias("percentage"))
