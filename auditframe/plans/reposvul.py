"""ReposVul conversion (D4): F7, A12, P27, J4, P24..P26, F8, P7, P8.

A record holds the vulnerable function; its fix is the same function in the
source file at the fixing commit. Function records are filtered, duplicate
function ids are folded into the first record (CWE union), and each record
is joined once with a files table on (project, commit, path); the best matching
definition is picked right after the join, so file contents go no further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import text as T
from auditframe.functions import variant as V
from auditframe.functions.udfs import best_definition, unified_diff

#: Longest text of any output column (the reference's CSV field limit).
MAX_FIELD_CHARS = 131072
# Columns of the written pairs, in order.
PAIR_FIELDS = (
    "sample_id", "commit_id", "commit_short", "project", "func_before", "func_after",
    "diff", "diff_length", "commit_msg", "cwe", "commit_msg_anonymized",
)
RECORD_TEXTS = ("function_id", "function", "commit_id", "commit_message", "project", "file_name")


def records_from_lines(lines: DataFrame) -> DataFrame:
    """(line, value) JSONL rows -> typed records. Lines that are not JSON or not
    an object keep a ``line_reason`` and nothing else; a scalar CWE becomes a
    list of one; ``target`` counts only as the number 1."""
    v = F.col("v")

    def cwes(c: Column) -> Column:
        return F.coalesce(F.try_variant_get(c, "$", "array<string>"), F.array_compact(F.array(F.try_variant_get(c, "$", "string"))))

    parsed = lines.where(~T.is_blank(F.col("value"))).select(F.col("line").alias("record_index"), F.try_parse_json("value").alias("v"))
    return parsed.select(
        "record_index",
        F.when(v.isNull(), F.lit("JSONDecodeError")).when(~V.is_object(v), F.lit("invalid_record")).alias("line_reason"),
        *[F.try_variant_get(v, f"$.{c}", "string").alias(c) for c in RECORD_TEXTS],
        F.coalesce(F.when(V.is_number(V.field(v, "target")), F.try_variant_get(v, "$.target", "double")), F.lit(0.0)).cast("int").alias("target"),
        V.truthy(V.field(v, "outdated")).cast("int").alias("outdated"),
        cwes(V.field(v, "cwe_id")).alias("cwe_id"),
    )


def _filtered(records: DataFrame, include_outdated: bool) -> DataFrame:
    """unreadable lines; target == 1; outdated dropped unless asked; missing
    id rejected."""
    line_reason = F.col("line_reason") if "line_reason" in records.columns else F.lit(None).cast("string")
    out = records.withColumn(
        "reason",
        F.when(line_reason.isNotNull(), line_reason)
        .when(~F.coalesce(F.col("target") == 1, F.lit(False)), F.lit("not_target"))
        .when(~F.lit(include_outdated) & F.coalesce(F.col("outdated") != 0, F.lit(False)), F.lit("outdated"))
        .when(T.is_blank(F.col("function_id")), F.lit("missing_function_id")),
    )
    return out.drop("line_reason")


def _copies(cands: DataFrame) -> DataFrame:
    """(function_id, record_index, copies): the first record of every function id."""
    return cands.groupBy("function_id").agg(F.min("record_index").alias("record_index"), F.count("*").alias("copies"))


def _folded(cands: DataFrame) -> DataFrame:
    """One row per function id -- the first record, CWE lists united in
    order (trimmed, blanks dropped). The union is built from per-CWE first
    positions, so a hot function id never collects its copies into one row; the list
    of an id without copies is its own union. ``record_index`` tells records apart."""
    # the first record is chosen by its index alone; its texts are joined once, when
    # the union is known
    agg = _copies(cands)
    repeated = cands.select("function_id", "record_index", "cwe_id").join(agg.where(F.col("copies") > 1).select("function_id"), "function_id")
    each = repeated.select("function_id", "record_index", F.posexplode("cwe_id").alias("_i", "_c")).withColumn(
        "_c", T.py_strip(F.col("_c"))).where(F.col("_c") != "")
    first = each.groupBy("function_id", "_c").agg(F.min(F.struct("record_index", "_i")).alias("_at"))
    union = first.groupBy("function_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_c"))), lambda x: x["_c"]).alias("_union"))
    out = cands.join(agg.join(union, "function_id", "left"), ["function_id", "record_index"])
    own = F.array_distinct(F.filter(F.transform("cwe_id", T.py_strip), lambda c: c != ""))
    cwes = F.coalesce(F.when(F.col("copies") > 1, F.col("_union")).otherwise(own), F.array().cast("array<string>"))
    return out.withColumn("cwes", cwes).drop("_union")


def file_key(project, commit, path) -> dict[str, Column]:
    """The normalised key of a source file; a blank part makes it incomplete."""
    return {
        "k_project": F.btrim(T.py_strip(F.coalesce(F.col(project), F.lit(""))), F.lit("/")),
        "k_commit": T.py_strip(F.coalesce(F.col(commit), F.lit(""))),
        "k_path": F.replace(T.py_strip(F.coalesce(F.col(path), F.lit(""))), F.lit("\\"), F.lit("/")),
    }


def convert_reposvul(
    records: DataFrame, files: DataFrame, include_outdated: bool = False, max_field_chars: int = MAX_FIELD_CHARS,
) -> DataFrame:
    """One row per input record with ``reason`` (NULL = written pair) and
    the 11 pair columns. ``files`` (project, commit_id, path, content) holds
    source files at the fixing commits; of repeated keys the smallest content
    counts. A written row has no column longer than ``max_field_chars``."""
    f = _filtered(records, include_outdated)
    rejects = f.where(F.col("reason").isNotNull()).select("record_index", "function_id", "reason")
    cands = f.where(F.col("reason").isNull()).drop("reason")
    kept = _folded(cands)
    key = ["k_project", "k_commit", "k_path"]
    keyed = kept.withColumns(file_key("project", "commit_id", "file_name")).withColumns({
        "fname": T.function_name(F.col("function")), "func_before": T.clean(F.col("function"))})
    incomplete = (F.col("k_project") == "") | (F.col("k_commit") == "") | (F.col("k_path") == "")
    keyed = keyed.withColumn("_pre", F.when(incomplete, F.lit("incomplete_key")).when(
        F.col("func_before") == "", F.lit("empty_function")).when(F.col("fname") == "", F.lit("no_function_name")))
    fl = files.select("content", *[c.alias(k) for k, c in file_key("project", "commit_id", "path").items()])
    fl = fl.groupBy(*key).agg(F.min("content").alias("content"))
    joined = keyed.join(fl, key, "left").withColumn(
        "_pre", F.coalesce("_pre", F.when(F.col("content").isNull(), F.lit("missing_file"))))
    # rows with a reason pass the UDFs as NULL
    matched = joined.withColumn(
        "func_after", best_definition(F.when(F.col("_pre").isNull(), F.col("content")), F.col("func_before"), F.col("fname"))).drop("content")
    before = F.col("func_before")
    after = T.clean(F.col("func_after"))
    reason = F.coalesce(
        F.col("_pre"),
        F.when(F.col("func_after").isNull(), F.lit("no_match"))
        .when(after == "", F.lit("empty_function"))
        .when(before == after, F.lit("unchanged")),
    )
    out = matched.withColumn("reason", reason).withColumn("func_after", after)
    is_pair = F.col("reason").isNull()
    out = out.withColumn("diff", F.when(is_pair, unified_diff(F.when(is_pair, before), F.when(is_pair, F.col("func_after")))))
    suffix = F.element_at(F.split(F.col("function_id"), "_"), -1)
    commit = T.py_strip(F.col("commit_id"))
    written = out.select(
        "record_index", "function_id", "reason",
        F.concat(F.left(commit, F.lit(8)), F.lit("_"), suffix).alias("sample_id"),
        commit.alias("commit_id"), F.left(commit, F.lit(8)).alias("commit_short"),
        F.coalesce("project", F.lit("")).alias("project"), "func_before", "func_after", "diff",
        F.length("diff").alias("diff_length"), F.coalesce("commit_message", F.lit("")).alias("commit_msg"),
        F.to_json("cwes").alias("cwe"), F.lit("").alias("commit_msg_anonymized"),
    )
    longest = F.greatest(*[F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in PAIR_FIELDS])
    written = written.withColumn("reason", F.coalesce("reason", F.when(longest > max_field_chars, F.lit("oversized_csv_field"))))
    # the copies take no texts and no CWE lists along
    index = cands.select("function_id", "record_index")
    dup = index.join(_copies(cands).where(F.col("copies") > 1), ["function_id", "record_index"]).drop("copies")
    folded = dup.select("function_id").join(index, "function_id").join(
        dup.withColumnRenamed("record_index", "_first"), "function_id").where(
        F.col("record_index") != F.col("_first")
    ).select("record_index", "function_id", F.lit("duplicate_function").alias("reason"))
    return written.unionByName(rejects.unionByName(folded), allowMissingColumns=True)


# Reasons of records that never become candidates.
NOT_CANDIDATES = ("not_target", "outdated", "missing_function_id", "duplicate_function", "JSONDecodeError", "invalid_record")


def reposvul_counts(converted: DataFrame) -> DataFrame:
    """A10: records read, candidates (function ids), written, folded duplicates
    and skipped (every reject that the log holds)."""
    r = F.col("reason")
    return converted.agg(
        F.count("*").alias("read"),
        F.count_if(r.isNull() | ~r.isin(*NOT_CANDIDATES)).alias("candidates"),
        F.count_if(r.isNull()).alias("written"),
        F.count_if(r == "duplicate_function").alias("duplicates"),
        F.count_if(r.isNotNull() & ~r.isin("duplicate_function", "not_target")).alias("skipped"),
    )
