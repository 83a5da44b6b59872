"""Views over the driver tables that stand in for the reference's inputs.

The driver tables hold no vulnerability data, so each job runs on a view
derived from them with plain projections; every view grows with its table.

``scored_results``  lineitem  -> multi-model result rows (3 models, text scores,
                                raw phase reports, error rows by residue)
``pair_rows``       documents -> before/after function pairs in 4 datasets
``turn_records``    conversations -> adjacent-record JSONL stream
``url_rows``        pages     -> commit URLs
``attempt_rows``    events    -> model-call attempts
``sample_rows``     orders+customer -> pipeline input samples
``response_rows``   orders    -> recorded model responses of those samples
``nested_details``  events    -> nested JSON values with secrets
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.sources.tables import dealt, table

# Model names and their order in the reports.
MODELS = ("chatgpt", "claude", "deepseek")
# Residue modulus that places error rows in the scored view.
SCORED_MOD = 97

OK_RAW = '{"ok":true}'


def _micro_text(u: Column) -> Column:
    return F.concat((u / 1_000_000).cast("bigint").cast("string"), F.lit("."), F.lpad(F.pmod(u, F.lit(1_000_000)).cast("string"), 6, "0"))


def scored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of three models (26-column table subset used by scorers).

    Every line of ``lineitem`` is a row: the line numbers go round the models
    (later lines of an order repeat a model's sample id, as reruns do); base id
    ``o_<orderkey>``; E, L, F from discount, tax and quantity in exact
    micro-units; two source files per model by supplier parity; row order inside
    a file is (l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_orderkey,
    l_linenumber).
    """
    li = dealt(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
    ), "l_orderkey", "l_partkey", "l_linenumber")
    ordinal = (F.pmod(F.col("l_linenumber") - 1, F.lit(len(MODELS))) + 1).cast("int")
    r = F.pmod(F.col("l_partkey"), F.lit(SCORED_MOD))
    e_u = F.round(F.col("l_discount") * 100).cast("bigint") * 100000
    l_u = F.round(F.col("l_tax") * 100).cast("bigint") * 125000
    f_u = F.round(F.col("l_quantity")).cast("bigint") * 20000
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), ordinal)
    file_ord = F.pmod(F.col("l_suppkey"), F.lit(2)).cast("int")
    var_txt = (
        F.when(r == 6, F.lit("not-a-number"))
        .when(r == 11, F.lit("-0.5"))
        .when(r == 19, F.lit("Infinity"))
        .otherwise(_micro_text(e_u))
    )
    step_txt = (
        F.when(r == 7, F.lit(""))
        .when(r == 13, F.concat(F.lit(" "), _micro_text(l_u), F.lit(" ")))
        .otherwise(_micro_text(l_u))
    )
    flow_txt = (
        F.when(r == 8, F.lit("NaN"))
        .when(r == 10, F.lit("1.5"))
        .when(r == 20, F.lit("1e-1"))
        .otherwise(_micro_text(f_u))
    )
    a_raw = (
        F.when(r == 1, F.lit(""))
        .when(r == 4, F.lit("[1,2]"))
        .when(r == 16, F.lit('{"pipeline_placeholder":0,"pipeline_error":""}'))
        .when(r == 18, F.lit('  {"pipeline_placeholder":{"a":1}}  '))
        .otherwise(F.lit(OK_RAW))
    )
    b_raw = (
        F.when(r == 5, F.lit('{"pipeline_placeholder":true,"pipeline_error":"failed"}'))
        .when(r == 14, F.lit('{"pipeline_error": oops}'))
        .when(r == 17, F.lit('{"pipeline_placeholder":[],"note":"pipeline_error"}'))
        .otherwise(F.lit(OK_RAW))
    )
    c_raw = (
        F.when(r == 2, F.lit("{garbage}"))
        .when(r == 3, F.lit('{"pipeline_placeholder":false}'))
        .when(r == 15, F.lit('{"pipeline_placeholder":"false"}'))
        .when(r == 22, F.lit('{"pipeline_error":null,"pipeline_placeholder":1.5}'))
        .otherwise(F.lit(OK_RAW))
    )
    sid = F.when(r == 12, F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))).otherwise(
        F.concat(F.lit("o_"), F.col("l_orderkey").cast("string"))
    )
    return li.select(
        model.alias("model"),
        ordinal.alias("model_ord"),
        file_ord.alias("file_ord"),
        F.concat(model, F.lit("_part"), file_ord.cast("string"), F.lit(".csv")).alias("source_file"),
        F.struct(
            F.col("l_shipdate").alias("shipdate"),
            F.col("l_partkey").alias("partkey"),
            F.col("l_suppkey").alias("suppkey"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_orderkey").alias("orderkey"),
            F.col("l_linenumber").alias("linenumber"),
        ).alias("row_key"),
        sid.alias("sample_id"),
        var_txt.alias("phase_c_variable_match_score"),
        step_txt.alias("phase_c_step_position_score"),
        flow_txt.alias("phase_c_dataflow_path_score"),
        F.lit("consistent").alias("phase_c_overall_consistency"),
        F.when(r == 9, F.lit("[PHASE_C_ERROR] timeout")).otherwise(F.lit("ok")).alias("phase_c_comment"),
        a_raw.alias("phase_a_raw"),
        b_raw.alias("phase_b_raw"),
        c_raw.alias("phase_c_raw"),
    )


# Text columns of the scored view that the phase-marker rule inspects.
SCORED_TEXT_COLUMNS = (
    "sample_id",
    "phase_c_variable_match_score",
    "phase_c_step_position_score",
    "phase_c_dataflow_path_score",
    "phase_c_overall_consistency",
    "phase_c_comment",
    "phase_a_raw",
    "phase_b_raw",
    "phase_c_raw",
)


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline input samples (8 text fields) from orders joined to customer.

    Every order is one sample ``o_<orderkey>``; some commit messages are blank
    and some descriptions are the NA word, to exercise the default rules.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "inner")
    k = F.col("o_orderkey")
    ks = k.cast("string")
    body = F.pmod(k, F.lit(7)).cast("string")
    return j.select(
        F.concat(F.lit("o_"), ks).alias("sample_id"),
        F.concat(F.lit("int f_"), ks, F.lit("(int x) { return x + "), body, F.lit("; }")).alias("func_before"),
        F.concat(F.lit("int f_"), ks, F.lit("(int x) { if (x < 0) return 0; return x + "), body, F.lit("; }")).alias(
            "func_after"
        ),
        F.when(F.pmod(k, F.lit(11)) == 0, F.lit("")).otherwise(F.concat(F.lit("fix "), F.col("o_orderpriority"))).alias(
            "commit_msg"
        ),
        F.when(F.pmod(k, F.lit(13)) == 0, F.lit("NA")).otherwise(F.concat(F.col("c_mktsegment"), F.lit(" issue"))).alias(
            "bug_description"
        ),
        F.md5(ks).alias("commit_id"),
        F.col("c_name").alias("project"),
        F.concat(F.lit("CWE-"), (F.col("c_nationkey") + 100).cast("string")).alias("cwe"),
    )


# Dataset names in deduplication priority order.
DATASETS = ("titanvul", "benchvul", "vulnerability_score", "primevul")


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before/after function pairs from ``documents`` in four datasets.

    dataset = doc_id % 4 (priority = that number); before = text, after =
    text with 'e' -> 'a' (unchanged when the text has no 'e'); blanks and
    padding by residue; commit URL, message, repo name and CWE text built
    from the id so metadata merges have something to merge.
    """
    d = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    k = F.col("doc_id")
    t = F.col("text")
    ks = k.cast("string")
    r37 = F.pmod(k, F.lit(37))
    before = F.when(r37 == 5, F.lit("")).when(r37 == 7, F.concat(F.lit("  "), t, F.lit("\n"))).otherwise(t)
    after = F.when(r37 == 6, F.lit("   ")).otherwise(F.replace(t, F.lit("e"), F.lit("a")))
    h = F.md5(t)
    url = (
        F.when(F.pmod(k, F.lit(19)) == 3, F.lit(""))
        .when(F.pmod(k, F.lit(2)) == 0, F.concat(
            F.lit("https://github.com/org"), F.pmod(k, F.lit(5)).cast("string"), F.lit("/repo"),
            F.pmod(k, F.lit(3)).cast("string"), F.lit("/commit/"), h))
        .otherwise(F.concat(
            F.lit("https://gitlab.com/team"), F.pmod(k, F.lit(5)).cast("string"), F.lit("/proj/-/commit/"),
            F.left(h, F.lit(12))))
    )
    r9 = F.pmod(k, F.lit(9))
    cwe = (
        F.when(r9 == 0, F.lit(""))
        .when(r9 == 1, F.concat(F.lit("CWE-0"), F.pmod(k, F.lit(90)).cast("string")))
        .when(r9 == 2, F.concat(F.lit('["cwe-'), F.pmod(k, F.lit(40)).cast("string"), F.lit('", "CWE-'),
                                F.pmod(k, F.lit(40)).cast("string"), F.lit('"]')))
        .when(r9 == 3, F.lit("NVD-CWE-noinfo"))
        .when(r9 == 4, F.lit("nvd-cwe-other, CWE-79"))
        .otherwise(F.concat(F.lit("CWE-"), F.pmod(k, F.lit(300)).cast("string")))
    )
    ds_ord = F.pmod(k, F.lit(4)).cast("int")
    return d.select(
        k.alias("doc_id"),
        ds_ord.alias("dataset_ord"),
        F.element_at(F.array(*[F.lit(x) for x in DATASETS]), ds_ord + 1).alias("dataset"),
        before.alias("func_before"),
        after.alias("func_after"),
        url.alias("commit_url"),
        F.when(F.pmod(k, F.lit(23)) == 4, F.lit("")).otherwise(F.concat(F.lit("fix issue "), ks)).alias("commit_msg"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("bench/repo"), F.pmod(k, F.lit(7)).cast("string")))
        .otherwise(F.lit("")).alias("repo_name"),
        cwe.alias("cwe_id"),
    )


def turn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent-record JSONL stream from ``conversations``.

    source = conv_id, line = turn; user turns are vulnerable records
    (target 1), assistant turns fixed ones (target 0); system turns and
    ``(conv_id + turn) % 7 = 0`` lines are unreadable lines that reset the
    pairing; commit / CVE metadata disagree by residue.
    """
    c = dealt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")
    conv = F.col("conv_id")
    turn = F.col("turn")
    bad = (F.col("role") == "system") | (F.pmod(conv + turn, F.lit(7)) == 0)
    return c.select(
        conv.alias("source"),
        turn.alias("line"),
        bad.alias("invalid_line"),
        F.when(F.col("role") == "user", F.lit(1)).otherwise(F.lit(0)).alias("target"),
        F.col("text").alias("func"),
        F.concat(F.lit("c"), F.md5(conv.cast("string"))).alias("commit_id"),
        F.concat(F.lit("CVE-"), conv.cast("string"), F.when(F.pmod(turn, F.lit(5)) == 3, F.lit("x")).otherwise(F.lit(""))).alias("cve"),
        F.concat(F.lit("proj"), F.pmod(conv, F.lit(13)).cast("string")).alias("project"),
        F.concat(F.lit("msg "), conv.cast("string")).alias("commit_message"),
        F.concat(F.lit("CWE-"), F.pmod(conv, F.lit(50)).cast("string")).alias("cwe"),
    )


def megavul_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MegaVul-style JSON records from ``documents`` (record_index = doc_id).

    ``is_vul`` false or null by residue, blank fields by residue, diff text
    built from the first lines of before/after, null commit hashes.
    """
    d = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    k = F.col("doc_id")
    t = F.col("text")
    after = F.replace(t, F.lit("e"), F.lit("a"))
    r10 = F.pmod(k, F.lit(10))
    return d.select(
        k.alias("record_index"),
        F.when(r10 == 0, F.lit(False)).when(r10 == 5, F.lit(None).cast("boolean")).otherwise(F.lit(True)).alias("is_vul"),
        F.when(F.pmod(k, F.lit(17)) == 3, F.lit("  ")).otherwise(t).alias("func_before"),
        after.alias("func"),
        F.concat(F.lit("-"), F.split_part(t, F.lit("\n"), F.lit(1)), F.lit("\n+"),
                 F.split_part(after, F.lit("\n"), F.lit(1))).alias("diff_func"),
        F.when(F.pmod(k, F.lit(7)) == 2, F.lit(None).cast("string")).otherwise(F.md5(t)).alias("commit_hash"),
        F.concat(F.lit("mv/repo"), F.pmod(k, F.lit(6)).cast("string")).alias("repo_name"),
        F.concat(F.lit("megavul fix "), k.cast("string")).alias("commit_msg"),
        F.array(F.concat(F.lit("CWE-"), F.pmod(k, F.lit(120)).cast("string"))).alias("cwe_ids"),
    )


def attempt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-call attempts from ``events``: one row per call attempt.

    sample = ``o_<user_id>``; phase = A/B/C by event id; ``error`` events are
    failed calls (HTTP 502 with a secret in the body); every 11th attempt is
    truncated (finish_reason = length); some payloads are not JSON, not an
    object, fenced, lack a closer, have a comma too many or follow another
    value. ``event_ts`` / ``event_id`` order the attempts of one call.
    """
    e = dealt(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props"), "event_id")
    k = F.col("event_id")
    err = F.col("event_type") == "error"
    payload = (
        F.when(F.pmod(k, F.lit(13)) == 0, F.lit("not json {"))
        .when(F.pmod(k, F.lit(17)) == 0, F.lit("[1, 2]"))
        .when(F.pmod(k, F.lit(7)) == 1, F.concat(F.lit('{"id": '), k.cast("string"), F.lit(", }")))
        .when(F.pmod(k, F.lit(7)) == 2, F.concat(F.lit('{"id": ['), k.cast("string")))
        .when(F.pmod(k, F.lit(7)) == 3, F.concat(F.lit('{"old": 1} {"id": '), k.cast("string"), F.lit("}")))
        .when(F.pmod(k, F.lit(7)) == 4, F.concat(F.lit('```json\n{"id": '), k.cast("string"), F.lit("}\n```")))
        .when(F.pmod(k, F.lit(7)) == 5, F.lit('{"id": NaN}'))
        .otherwise(F.col("props"))
    )
    return e.select(
        F.concat(F.lit("o_"), F.col("user_id").cast("string")).alias("sample_id"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.pmod(k, F.lit(3)) + 1).cast("int")).alias("phase"),
        F.col("ts").alias("event_ts"),
        k.alias("event_id"),
        F.when(err, F.lit("APIError")).alias("error_type"),
        F.when(err, F.concat(F.lit("HTTP 502 Bearer tok"), k.cast("string"), F.lit(" api_key=sk-"), k.cast("string")))
        .alias("message"),
        F.when(err, F.lit(502)).alias("status_code"),
        F.when(F.pmod(k, F.lit(11)) == 0, F.lit("length")).otherwise(F.lit("stop")).alias("finish_reason"),
        F.when(~err, payload).alias("model_output"),
    )


#: Parts of the model responses by order key ``k``, as SQL; each phase has residues
#: with a defect, the rest is well-formed.
_NODE = """CASE {r} WHEN {text} THEN '"x"' WHEN {lacks} THEN '{{"step_location": "line 1", "issue_description": "d"}}'
  WHEN {blank} THEN '{{"variable_name": " ", "step_location": null, "issue_description": "d", "extra": [1, 2]}}'
  ELSE concat('{{"variable_name": "x", "step_location": "line 1", "issue_description": "', o_orderpriority, '"}}') END"""
_RESPONSES = {
    "A": """CASE k % 23 WHEN 17 THEN '{"confidence": 3}' ELSE concat(
      '{"non_standard_external_calls": ', CASE k % 23 WHEN 8 THEN '["log", 7]' ELSE concat('["f_', k, '", "log"]') END,
      ', "data_flow_path": ', CASE k % 23 WHEN 4 THEN '"  "' WHEN 20 THEN '5' ELSE concat('"x -> f_', k, ' -> return"') END,
      ', "vulnerability_node": ', """ + _NODE.format(r="k % 23", text=5, lacks=6, blank=7) + """,
      CASE k % 23 WHEN 1 THEN '' WHEN 2 THEN ', "confidence": 101' WHEN 3 THEN ', "confidence": true' WHEN 19 THEN ', "confidence": 5.0'
        ELSE concat(', "confidence": ', k % 101) END,
      CASE k % 23 WHEN 9 THEN '' WHEN 21 THEN ', "additional_context_needed": 4' ELSE ', "additional_context_needed": null' END,
      ', "reviewer": "team ', k % 7, '"}') END""",
    "B": """concat(
      '{"data_flow_path": ', CASE k % 19 WHEN 11 THEN 'null' ELSE '"a -> b"' END,
      ', "vulnerability_node": ', """ + _NODE.format(r="k % 19", text=9, lacks=10, blank=13) + """,
      CASE k % 19 WHEN 1 THEN '' WHEN 2 THEN ', "cwe_type": ["CWE-1", " CWE-2 "]' WHEN 3 THEN ', "cwe_type": []'
        WHEN 4 THEN ', "cwe_type": ["CWE-1", 5]' ELSE concat(', "cwe_type": "CWE-', k % 200, '"') END,
      CASE k % 19 WHEN 5 THEN '' WHEN 6 THEN '' WHEN 7 THEN ', "depends_on_caller": "yes"'
        ELSE concat(', "depends_on_caller": ', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END) END,
      CASE k % 19 WHEN 6 THEN '' WHEN 8 THEN ', "caller_constraint": 3' WHEN 5 THEN ', "caller_constraint": "caller checks"'
        ELSE ', "caller_constraint": null' END,
      CASE k % 19 WHEN 7 THEN concat(', "api_key": {"v": "k', k, '"}, "notes": ["Bearer abc', k, '", {"n": "sk-zz', k, ' end"}]') ELSE '' END, '}')""",
    "C": """concat(
      '{"variable_match_score": ', CASE k % 5 WHEN 0 THEN '0' WHEN 1 THEN '0.25' WHEN 2 THEN '0.5' WHEN 3 THEN '0.75' ELSE '1' END,
      ', "step_position_score": 0.5, "dataflow_path_score": ', CASE k % 17 WHEN 1 THEN '"0.5"' WHEN 2 THEN 'true' ELSE '1' END,
      ', "overall_consistency": ', CASE k % 17 WHEN 3 THEN '" "' ELSE '"consistent"' END,
      CASE k % 17 WHEN 4 THEN concat(', "comment": {"note": "n', k, '", "tags": [1, 2]}') WHEN 5 THEN '' ELSE ', "comment": "ok"' END, '}')""",
}
#: How a phase's attempts come out, as SQL: the residue, whether all attempts fail in
#: the same way (else the second one succeeds), and the text around a body.
_CALLS = {
    "A": ("k % 23", (12, 13, 14, 15, 16)), "B": ("k % 19", (12,)), "C": ("k % 17", (7,)),
}


def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded model responses of ``sample_rows``: every order calls the phases A,
    B and C in up to three attempts. Some calls fail (a status and a request id, or
    neither), some answers are cut off, no JSON, no object, fenced, lack a closer,
    have a comma too many or follow a draft."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    parts = []
    for phase, (residue, failing) in _CALLS.items():
        rows = o.select(F.col("o_orderkey").alias("k"), F.expr(residue.replace("k", "o_orderkey")).alias("r"), "o_orderpriority")
        rows = rows.withColumn("body", F.expr(_RESPONSES[phase]))
        tries = F.when(F.col("r").isin(*failing), F.when((F.lit(phase) == "A") & (F.col("r") == 12), 2).otherwise(3)).otherwise(1)
        rows = rows.withColumn("attempt", F.explode(F.sequence(F.lit(1), tries)))
        r = F.when(F.lit(phase) == "A", F.col("r")).when(F.lit(phase) == "B", F.col("r") + 100).otherwise(F.col("r") + 200)
        lost = ((r == 12) & (F.col("attempt") == 1)) | (r == 13)
        text = (
            F.when(r == 10, F.concat(F.lit("```json\n"), "body", F.lit("\n```"))).when(r == 11, F.expr("concat(left(body, length(body) - 1), ' ,}')"))
            .when(r == 15, "not json {").when(r == 16, "[1, 2]").when(r == 18, F.concat(F.lit('{"draft": 1} '), "body"))
            .when(r == 22, F.expr("left(body, length(body) - 1)")).when(r == 206, F.concat(F.lit(" ```JSON\n"), "body", F.lit("```\n"))).otherwise(F.col("body")))
        parts.append(rows.select(
            F.concat(F.lit("o_"), F.col("k").cast("string")).alias("sample_id"), F.lit(phase).alias("phase"), F.col("attempt").cast("bigint").alias("attempt"),
            F.when(lost, "APITimeoutError").when(r == 112, "APIConnectionError").alias("error_type"),
            F.when(lost, F.concat(F.lit("timeout  after 120 s, Bearer tok"), F.col("k").cast("string"))).when(r == 112, "connection reset").alias("message"),
            F.when(lost, 504).alias("status_code"), F.when(lost, F.concat(F.lit("req-"), F.col("k").cast("string"))).alias("request_id"),
            F.when(lost | (r == 112), F.lit(None)).when(r.isin(14, 207), "length").otherwise("stop").alias("finish_reason"),
            F.when(~(lost | (r == 112)), text).alias("model_output")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def nested_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON values with secrets at several depths from ``events``: ``props`` inside
    objects and lists, secret-named keys holding texts, numbers and objects."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    k = F.col("event_id").cast("string")
    deep = F.when(F.pmod("event_id", F.lit(31)) == 0, F.lit('{"a": {"b": {"c": {"d": ["Bearer deep, x"]}}}}')).otherwise(F.lit("null"))
    body = F.concat(
        F.lit('{"props": '), F.col("props"), F.lit(', "auth": {"Api-Key": {"v": '), k, F.lit('}, "user": "u'), F.col("user_id").cast("string"),
        F.lit('"}, "log": ["bearer  tok'), k, F.lit('; next", {"msg": "key sk-'), k, F.lit('_x.", "client_secret": '), k,
        F.lit('}, [true, null, 1.5]], "kind": "'), F.col("event_type"), F.lit('", "deep": '), deep, F.lit("}"))
    return e.select("event_id", F.parse_json(body).alias("details"))


def _vulnerable(name: Column, k: Column) -> Column:
    body = F.pmod(k, F.lit(7)).cast("string")
    return F.concat(F.lit("int "), name, F.lit("(int x)\n{\n  return x + "), body, F.lit(";\n}"))


def _fixed(name: Column, k: Column) -> Column:
    body = F.pmod(k, F.lit(7)).cast("string")
    return F.concat(F.lit("int "), name, F.lit("(int x)\n{\n  if (x < 0)\n    return 0;\n  return x + "), body, F.lit(";\n}"))


def reposvul_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ReposVul-style records from ``orders``: the vulnerable functions.

    target 0 / outdated / duplicate function ids / padded keys by residue; the
    CWE field has one or two entries.
    """
    o = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    k = F.col("o_orderkey")
    ks = k.cast("string")
    fid = F.when(F.pmod(k, F.lit(17)) == 1, k - 1).otherwise(k)
    name = F.concat(F.lit("f_"), ks)
    project = F.concat(F.lit("proj/c"), F.col("o_custkey").cast("string"))
    padded = F.pmod(k, F.lit(5)) == 2
    return o.select(
        k.alias("record_index"),
        F.concat(F.lit("repo_fn_"), fid.cast("string")).alias("function_id"),
        _vulnerable(name, k).alias("function"),
        F.md5(ks).alias("commit_id"),
        F.concat(F.lit("fix order "), ks).alias("commit_message"),
        F.when(padded, F.concat(F.lit("/"), project, F.lit("/"))).otherwise(project).alias("project"),
        F.when(padded, F.concat(F.lit("src\\"), name, F.lit(".c "))).otherwise(F.concat(F.lit("src/"), name, F.lit(".c"))).alias("file_name"),
        F.when(F.pmod(k, F.lit(9)) == 0, F.lit(0)).otherwise(F.lit(1)).alias("target"),
        F.when(F.pmod(k, F.lit(13)) == 0, F.lit(1)).otherwise(F.lit(0)).alias("outdated"),
        F.when(F.pmod(k, F.lit(2)) == 0, F.array(F.concat(F.lit("CWE-"), F.pmod(k, F.lit(30)).cast("string"))))
        .otherwise(F.array(F.concat(F.lit("CWE-"), F.pmod(k, F.lit(30)).cast("string")), F.lit("CWE-20")))
        .alias("cwe_id"),
    )


def reposvul_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files at the fixing commits (replacing the download): each holds a
    prototype, a helper that mentions the function in a comment and a string
    with a brace, and the fixed definition; some files are absent, some still
    hold the vulnerable text, some hold another function; in some a stray quote
    stands in front (an apostrophe in a directive, a digit separator)."""
    o = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    k = F.col("o_orderkey")
    ks = k.cast("string")
    name = F.concat(F.lit("f_"), ks)
    definition = (
        F.when(F.pmod(k, F.lit(31)) == 7, _vulnerable(name, k))
        .when(F.pmod(k, F.lit(37)) == 9, _fixed(F.concat(F.lit("g_"), ks), k)).otherwise(_fixed(name, k)))
    content = F.concat(
        F.lit("#include <stdio.h>\n\n"), F.when(F.pmod(k, F.lit(6)) == 1, "#error you can't build \"this\n").when(
            F.pmod(k, F.lit(6)) == 4, "static const int big = 1'000;\n").otherwise(""), F.lit("int "), name, F.lit("(int x);\n\nstatic const char *helper(void)\n{\n  /* see "),
        name, F.lit("( } */\n  return \"}\";\n}\n\n"), definition, F.lit("\n"),
    )
    return o.where(F.pmod(k, F.lit(29)) != 4).select(
        F.concat(F.lit("proj/c"), F.col("o_custkey").cast("string")).alias("project"),
        F.md5(ks).alias("commit_id"),
        F.concat(F.lit("src/"), name, F.lit(".c")).alias("path"),
        content.alias("content"),
    )
