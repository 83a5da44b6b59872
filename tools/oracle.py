"""DuckDB oracle SQL for the registered queries.

Independent of the Spark code path: scores are handled as exact integer
micro-units (BIGINT / HUGEINT) with explicit HALF_UP integer rounding, the
view over the driver tables is re-declared in SQL, and windows are used
freely (the oracle runs on small data only).
"""

from __future__ import annotations

import itertools

from tools.oracle_phases import phase_oracles

MODELS = ("chatgpt", "claude", "deepseek")
BANDS = ("low", "middle", "high")
BAND_DEF = {"low": "(-inf, 0.25]", "middle": "(0.25, 0.75)", "high": "[0.75, +inf)"}


# ------------------------------------------------------------------ helpers
def text6(u: str, digits: int = 6) -> str:
    """Integer units of 10^-digits -> shortest decimal text."""
    unit = 10**digits
    mag = f"abs(CAST({u} AS HUGEINT))"
    body = (
        f"rtrim(rtrim(CAST({mag} // {unit} AS VARCHAR) || '.' || "
        f"lpad(CAST({mag} % {unit} AS VARCHAR), {digits}, '0'), '0'), '.')"
    )
    return f"(CASE WHEN ({u}) < 0 THEN '-' || {body} ELSE {body} END)"


def half_up(num: str, den: str) -> str:
    n = f"CAST({num} AS HUGEINT)"
    d = f"CAST({den} AS HUGEINT)"
    mag = f"((2 * abs({n}) + {d}) // (2 * {d}))"
    return f"(CASE WHEN {n} < 0 THEN -{mag} ELSE {mag} END)"


def pct(count: str, total: str) -> str:
    return f"(CASE WHEN ({total}) = 0 THEN '0' ELSE {text6(half_up(f'CAST({count} AS HUGEINT) * 100000000', total))} END)"


def bin_idx(u: str) -> str:
    return (
        f"(CASE WHEN ({u}) < 0 THEN -1 WHEN ({u}) > 1000000 THEN 10 WHEN ({u}) = 0 THEN 0 "
        f"ELSE least((({u}) + 99999) // 100000 - 1, 9) END)"
    )


def bin_label(i: str) -> str:
    return (
        f"(CASE WHEN ({i}) < 0 THEN '< 0.0' WHEN ({i}) > 9 THEN '> 1.0' ELSE "
        f"(CASE WHEN ({i}) = 0 THEN '[' ELSE '(' END) || printf('%.1f', ({i}) / 10) || ', ' || "
        f"printf('%.1f', (({i}) + 1) / 10) || ']' END)"
    )


def band_u(u: str) -> str:
    return f"(CASE WHEN ({u}) <= 250000 THEN 'low' WHEN ({u}) >= 750000 THEN 'high' ELSE 'middle' END)"


def values_table(name: str, col: str, values) -> str:
    rows = ", ".join(f"({v!r})" if isinstance(v, str) else f"({v})" for v in values)
    rows = rows.replace("'", "'")
    return f"{name}({col}) AS (SELECT * FROM (VALUES {rows}) t({col}))"


def grid_sql(dims: dict[str, list]) -> str:
    """Cross product of literal lists as one SELECT (oracle side only)."""
    parts = []
    for i, (name, values) in enumerate(dims.items()):
        rows = ", ".join(("'" + v + "'") if isinstance(v, str) else str(v) for v in values)
        parts.append(f"(SELECT * FROM (VALUES {', '.join('(' + x.strip() + ')' for x in rows.split(','))}) g{i}({name}))")
    return "SELECT * FROM " + " CROSS JOIN ".join(parts)


def _raw_truthy(c: str, key: str) -> str:
    p = f"'$.{key}'"
    t = f"json_type({c}, {p})"
    return (
        f"(CASE WHEN {t} IS NULL OR {t} = 'NULL' THEN false "
        f"WHEN {t} = 'BOOLEAN' THEN CAST(json_extract({c}, {p}) AS BOOLEAN) "
        f"WHEN {t} = 'VARCHAR' THEN json_extract_string({c}, {p}) <> '' "
        f"WHEN {t} = 'ARRAY' THEN json_array_length({c}, {p}) > 0 "
        f"WHEN {t} = 'OBJECT' THEN CAST(json_extract({c}, {p}) AS VARCHAR) <> '{{}}' "
        f"ELSE CAST(json_extract({c}, {p}) AS DOUBLE) <> 0 END)"
    )


def raw_reason(c: str) -> str:
    """NULL or one of empty / invalid_json / non_object / pipeline_error."""
    t = f"trim({c})"
    marked = f"(contains({c}, 'pipeline_placeholder') OR contains({c}, 'pipeline_error'))"
    return (
        f"(CASE WHEN {c} IS NULL OR {t} = '' THEN 'empty:{c}' "
        f"WHEN NOT (starts_with({t}, '{{') AND ends_with({t}, '}}')) THEN 'invalid_json:{c}' "
        f"WHEN NOT {marked} THEN NULL "
        f"WHEN NOT json_valid({c}) THEN 'invalid_json:{c}' "
        f"WHEN json_type({c}) <> 'OBJECT' THEN 'non_object:{c}' "
        f"WHEN {_raw_truthy(c, 'pipeline_placeholder')} OR {_raw_truthy(c, 'pipeline_error')} THEN 'pipeline_error:{c}' "
        f"END)"
    )


SCORE_COLS = ("phase_c_variable_match_score", "phase_c_step_position_score", "phase_c_dataflow_path_score")
RAW_COLS = ("phase_a_raw", "phase_b_raw", "phase_c_raw")
TEXT_COLS = ("sample_id",) + SCORE_COLS + ("phase_c_overall_consistency", "phase_c_comment") + RAW_COLS


def _mt(u: str) -> str:
    return f"printf('%d.%06d', ({u}) // 1000000, ({u}) % 1000000)"


SCORED_VIEW = f"""
li AS (
  SELECT *, l_partkey % 97 AS r,
         CAST(round(l_discount * 100) AS BIGINT) * 100000 AS e0,
         CAST(round(l_tax * 100) AS BIGINT) * 125000 AS l0,
         CAST(round(l_quantity) AS BIGINT) * 20000 AS f0
  FROM lineitem
),
v AS (
  SELECT
    ['chatgpt', 'claude', 'deepseek'][(l_linenumber - 1) % 3 + 1] AS model,
    CAST((l_linenumber - 1) % 3 + 1 AS INTEGER) AS model_ord,
    CAST(l_suppkey % 2 AS INTEGER) AS file_ord,
    ['chatgpt', 'claude', 'deepseek'][(l_linenumber - 1) % 3 + 1]
      || '_part' || CAST(l_suppkey % 2 AS VARCHAR) || '.csv' AS source_file,
    l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_orderkey, l_linenumber,
    CASE WHEN r = 12 THEN 'o' || CAST(l_orderkey AS VARCHAR) ELSE 'o_' || CAST(l_orderkey AS VARCHAR) END AS sample_id,
    CASE WHEN r = 6 THEN 'not-a-number' WHEN r = 11 THEN '-0.5' WHEN r = 19 THEN 'Infinity' ELSE {_mt('e0')} END
      AS phase_c_variable_match_score,
    CASE WHEN r = 7 THEN '' WHEN r = 13 THEN ' ' || {_mt('l0')} || ' ' ELSE {_mt('l0')} END
      AS phase_c_step_position_score,
    CASE WHEN r = 8 THEN 'NaN' WHEN r = 10 THEN '1.5' WHEN r = 20 THEN '1e-1' ELSE {_mt('f0')} END
      AS phase_c_dataflow_path_score,
    'consistent' AS phase_c_overall_consistency,
    CASE WHEN r = 9 THEN '[PHASE_C_ERROR] timeout' ELSE 'ok' END AS phase_c_comment,
    CASE WHEN r = 1 THEN '' WHEN r = 4 THEN '[1,2]'
         WHEN r = 16 THEN '{{"pipeline_placeholder":0,"pipeline_error":""}}'
         WHEN r = 18 THEN '  {{"pipeline_placeholder":{{"a":1}}}}  ' ELSE '{{"ok":true}}' END AS phase_a_raw,
    CASE WHEN r = 5 THEN '{{"pipeline_placeholder":true,"pipeline_error":"failed"}}'
         WHEN r = 14 THEN '{{"pipeline_error": oops}}'
         WHEN r = 17 THEN '{{"pipeline_placeholder":[],"note":"pipeline_error"}}' ELSE '{{"ok":true}}' END AS phase_b_raw,
    CASE WHEN r = 2 THEN '{{garbage}}' WHEN r = 3 THEN '{{"pipeline_placeholder":false}}'
         WHEN r = 15 THEN '{{"pipeline_placeholder":"false"}}'
         WHEN r = 22 THEN '{{"pipeline_error":null,"pipeline_placeholder":1.5}}' ELSE '{{"ok":true}}' END AS phase_c_raw
  FROM li
),
p AS (
  SELECT v.*,
    CAST(TRY_CAST(trim(phase_c_variable_match_score) AS DECIMAL(18,9)) * 1000000 AS BIGINT) AS eu,
    CAST(TRY_CAST(trim(phase_c_step_position_score) AS DECIMAL(18,9)) * 1000000 AS BIGINT) AS lu,
    CAST(TRY_CAST(trim(phase_c_dataflow_path_score) AS DECIMAL(18,9)) * 1000000 AS BIGINT) AS fu,
    row_number() OVER (PARTITION BY model ORDER BY file_ord, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_orderkey, l_linenumber) AS pos
  FROM v
),
q AS (
  SELECT p.*,
    eu + lu + fu + 3 * least(eu, lu, fu) AS num,
    {" OR ".join(f"coalesce(starts_with({c}, '[PHASE_') AND contains({c}, '_ERROR]'), false)" for c in TEXT_COLS)} AS marker,
    concat_ws(';',
      CASE WHEN NOT contains(sample_id, '_') OR NOT regexp_matches(trim(split_part(sample_id, '_', -1)), '^[+-]?[0-9]+$')
           THEN 'invalid_sample_id_suffix' END,
      {", ".join(raw_reason(c) for c in RAW_COLS)},
      CASE WHEN {" OR ".join(f"coalesce(starts_with({c}, '[PHASE_') AND contains({c}, '_ERROR]'), false)" for c in TEXT_COLS)}
           THEN 'phase_error_marker' END,
      {", ".join(
        f"CASE WHEN regexp_matches(trim({c}), '(?i)^[+-]?(s?nan[0-9]*|inf|infinity)$') THEN 'non_finite_score:{c}' "
        f"WHEN TRY_CAST(trim({c}) AS DECIMAL(18,9)) IS NULL THEN 'invalid_score:{c}' END" for c in SCORE_COLS)}
    ) AS reasons0
  FROM p
),
m AS (
  SELECT q.*,
    min(CASE WHEN reasons0 = '' THEN pos END) OVER (PARTITION BY model, sample_id) AS first_pos
  FROM q
),
mr AS (
  SELECT m.*,
    CASE WHEN first_pos IS NOT NULL AND pos > first_pos
         THEN (CASE WHEN reasons0 = '' THEN 'duplicate_sample_id' ELSE reasons0 || ';duplicate_sample_id' END)
         ELSE reasons0 END AS reason,
    CASE WHEN num < 0 THEN -((2 * abs(num) + 6) // 12) ELSE (2 * abs(num) + 6) // 12 END AS sim_u,
    CASE WHEN num <= 1500000 THEN 'low' WHEN num >= 4500000 THEN 'high' ELSE 'middle' END AS score_band,
    CASE WHEN contains(sample_id, '_') AND regexp_matches(trim(split_part(sample_id, '_', -1)), '^[+-]?[0-9]+$')
         THEN CAST(trim(split_part(sample_id, '_', -1)) AS BIGINT) ELSE 9223372036854775807 END AS sample_index
  FROM m
),
valid AS (
  SELECT model, model_ord, sample_id, sample_index, eu, lu, fu, num, sim_u, score_band,
         1000000 - sim_u AS cds_u, {band_u('1000000 - sim_u')} AS cds_band
  FROM mr WHERE reason = ''
),
cids AS (SELECT sample_id FROM valid GROUP BY sample_id HAVING count(*) = 3),
common AS (SELECT valid.* FROM valid JOIN cids USING (sample_id)),
scoped AS (
  SELECT 'full' AS scope, * FROM valid
  UNION ALL SELECT 'three_model_common' AS scope, * FROM common
)"""

# D6 stage: F1 + F2 only (no duplicate rule, no id-suffix rule).
D6_VIEW = f"""
{SCORED_VIEW.strip()},
d6 AS (
  SELECT model, sample_id, eu, lu, fu, num,
    ({" OR ".join(f"{raw_reason(c)} IS NOT NULL" for c in RAW_COLS)} OR marker
      OR eu IS NULL OR lu IS NULL OR fu IS NULL) AS skipped
  FROM q
),
d6v AS (
  SELECT model, sample_id,
    CASE WHEN num < 0 THEN -((2 * abs(num) + 6) // 12) ELSE (2 * abs(num) + 6) // 12 END AS sim_u
  FROM d6 WHERE NOT skipped
),
d6s AS (SELECT model, sample_id, sim_u, 1000000 - sim_u AS cds_u FROM d6v)"""


def _median_text(tbl: str, group: str, val: str) -> str:
    return f"""(
  SELECT {group}, sum({val}) FILTER (WHERE rn = (n + 1) // 2) + sum({val}) FILTER (WHERE rn = n // 2 + 1) AS med2
  FROM (SELECT {group}, {val}, row_number() OVER (PARTITION BY {group} ORDER BY {val}) AS rn,
               count(*) OVER (PARTITION BY {group}) AS n FROM {tbl}) x
  GROUP BY {group})"""


def _summary(tbl: str, group: str, val: str) -> str:
    return f"""
SELECT a.{group},
  a.row_count, a.distinct_count,
  {text6(half_up('a.s', 'a.row_count'))} AS mean,
  {text6('b.med2 * 5', 7)} AS median,
  {text6('a.mn')} AS minimum, {text6('a.mx')} AS maximum
FROM (SELECT {group}, count(*) AS row_count, count(DISTINCT {val}) AS distinct_count,
             sum(CAST({val} AS HUGEINT)) AS s, min({val}) AS mn, max({val}) AS mx
      FROM {tbl} GROUP BY {group}) a
JOIN {_median_text(tbl, group, val)} b USING ({group})"""


def _hist(tbl: str, groups: dict[str, list], val: str, label: str, keep: bool = True,
          cumulative: bool = False, total_name: str = "total_valid") -> str:
    g = list(groups)
    gsel = ", ".join(g)
    grid = grid_sql({**groups, "bin": list(range(10))})
    extra = (
        f"UNION ALL SELECT {gsel}, bin, cnt FROM cnts WHERE bin < 0 OR bin > 9" if keep else ""
    )
    cum = ""
    if cumulative:
        fg = ", ".join("f." + x for x in g)
        run = f"sum(f.cnt) OVER (PARTITION BY {fg} ORDER BY f.bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        cum = (
            f", CAST({run} AS BIGINT) AS cumulative_count"
            f", {pct(run, 'coalesce(t.tot, 0)')} AS cumulative_percentage"
        )
    return f"""
cnts AS (SELECT {gsel}, {bin_idx(val)} AS bin, count(*) AS cnt FROM {tbl} GROUP BY ALL),
tots AS (SELECT {gsel}, count(*) AS tot FROM {tbl} GROUP BY ALL),
filled AS (
  SELECT gr.*, coalesce(c.cnt, 0) AS cnt FROM ({grid}) gr LEFT JOIN cnts c USING ({gsel}, bin)
  {extra}
)
SELECT {", ".join(f"f.{x}" for x in g)}, {bin_label('f.bin')} AS {label}, CAST(f.cnt AS BIGINT) AS count,
  {pct('f.cnt', 'coalesce(t.tot, 0)')} AS percentage{cum},
  CAST(coalesce(t.tot, 0) AS BIGINT) AS {total_name}, CAST(f.bin AS INTEGER) AS bin_index
FROM filled f LEFT JOIN tots t USING ({gsel})"""


def _bands(tbl: str, groups: dict[str, list], band_col: str) -> str:
    g = list(groups)
    gsel = ", ".join(g)
    grid = grid_sql({**groups, "band": list(BANDS)})
    defs = " ".join(f"WHEN '{b}' THEN '{d}'" for b, d in BAND_DEF.items())
    return f"""
cnts AS (SELECT {gsel}, {band_col} AS band, count(*) AS cnt FROM {tbl} GROUP BY ALL),
tots AS (SELECT {gsel}, count(*) AS tot FROM {tbl} GROUP BY ALL)
SELECT {", ".join(f"gr.{x}" for x in g)}, gr.band, CASE gr.band {defs} END AS band_definition,
  CAST(coalesce(c.cnt, 0) AS BIGINT) AS count, {pct('coalesce(c.cnt, 0)', 'coalesce(t.tot, 0)')} AS percentage,
  CAST(coalesce(t.tot, 0) AS BIGINT) AS total_valid
FROM ({grid}) gr LEFT JOIN cnts c USING ({gsel}, band) LEFT JOIN tots t USING ({gsel})"""


def _wide(val: str, band: str) -> str:
    cols = ", ".join(
        f"max(CASE WHEN model = '{m}' THEN {val} END) AS v_{m}, max(CASE WHEN model = '{m}' THEN {band} END) AS b_{m}"
        for m in MODELS
    )
    return f"wide AS (SELECT sample_id, {cols} FROM common GROUP BY sample_id)"


def _agreement(val: str, band: str) -> str:
    pairs = list(itertools.combinations(MODELS, 2))
    parts = [
        f"SELECT '{a}_vs_{b}' AS comparison, count(*) AS cv, count(*) FILTER (WHERE b_{a} = b_{b}) AS ag FROM wide"
        for a, b in pairs
    ]
    parts.append(
        "SELECT 'all_three' AS comparison, count(*) AS cv, count(*) FILTER (WHERE "
        + " AND ".join(f"b_{m} = b_{MODELS[0]}" for m in MODELS[1:]) + ") AS ag FROM wide"
    )
    return f"""WITH {SCORED_VIEW.strip()}, {_wide(val, band)}
SELECT comparison, CAST(cv AS BIGINT) AS common_valid, CAST(ag AS BIGINT) AS agree_count,
  CAST(cv - ag AS BIGINT) AS disagree_count, {pct('ag', 'cv')} AS agreement_percentage
FROM ({" UNION ALL ".join(parts)}) x"""


def _combinations(val: str, band: str, suffix: str) -> str:
    keys = [f"{m}{suffix}" for m in MODELS]
    grid = grid_sql({k: list(BANDS) for k in keys})
    same = " AND ".join(f"gr.{k} = gr.{keys[0]}" for k in keys[1:])
    return f"""WITH {SCORED_VIEW.strip()}, {_wide(val, band)},
cnts AS (SELECT {", ".join(f"b_{m} AS {k}" for m, k in zip(MODELS, keys))}, count(*) AS cnt FROM wide GROUP BY ALL),
tot AS (SELECT count(*) AS cv FROM wide)
SELECT {", ".join(f"gr.{k}" for k in keys)}, CASE WHEN {same} THEN 'true' ELSE 'false' END AS all_same,
  CAST(coalesce(c.cnt, 0) AS BIGINT) AS count, {pct('coalesce(c.cnt, 0)', 'tot.cv')} AS percentage,
  CAST(tot.cv AS BIGINT) AS common_valid
FROM ({grid}) gr LEFT JOIN cnts c USING ({", ".join(keys)}) CROSS JOIN tot"""


def _diff_long(val: str, band: str) -> str:
    pairs = list(itertools.combinations(MODELS, 2))
    parts = " UNION ALL ".join(
        f"SELECT '{a}_vs_{b}' AS comparison, abs(v_{a} - v_{b}) AS d FROM wide" for a, b in pairs
    )
    return f"{_wide(val, band)}, dl AS ({parts})"


def score_oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    comps = [f"{a}_vs_{b}" for a, b in itertools.combinations(MODELS, 2)]
    q["p11_composite_similarity"] = f"""WITH {D6_VIEW.strip()}
SELECT model, sample_id, {text6('sim_u')} AS similarity, {text6('cds_u')} AS cds_score,
  {band_u('cds_u')} AS cds_band, CAST({bin_idx('cds_u')} AS INTEGER) AS cds_bin
FROM d6s"""
    q["s13_enriched"] = f"""WITH {D6_VIEW.strip()},
en AS (
  SELECT q.* EXCLUDE (eu, lu, fu), q.eu, q.lu, q.fu FROM q
  WHERE NOT ({" OR ".join(f"{raw_reason(c)} IS NOT NULL" for c in RAW_COLS)} OR marker OR eu IS NULL OR lu IS NULL OR fu IS NULL)
)
SELECT model, model_ord, file_ord, source_file, {", ".join(TEXT_COLS)},
  {text6("(2 * num + 6) // 12")} AS similarity, {text6("1000000 - (2 * num + 6) // 12")} AS cds_score,
  {band_u("1000000 - (2 * num + 6) // 12")} AS cds_band
FROM en WHERE num >= 0
UNION ALL SELECT model, model_ord, file_ord, source_file, {", ".join(TEXT_COLS)},
  {text6("-((2 * abs(num) + 6) // 12)")}, {text6("1000000 + (2 * abs(num) + 6) // 12")}, {band_u("1000000 + (2 * abs(num) + 6) // 12")}
FROM en WHERE num < 0"""
    q["a1_cds_summary"] = f"""WITH {D6_VIEW.strip()},
st AS ({_summary('d6s', 'model', 'cds_u')}),
ct AS (SELECT model, count(*) FILTER (WHERE NOT skipped) AS row_count, count(*) FILTER (WHERE skipped) AS skipped_row_count FROM d6 GROUP BY model)
SELECT ct.model, CAST(ct.row_count AS BIGINT) AS row_count, CAST(ct.skipped_row_count AS BIGINT) AS skipped_row_count,
  CAST(coalesce(st.distinct_count, 0) AS BIGINT) AS distinct_cds_count, st.mean, st.median, st.minimum, st.maximum
FROM ct LEFT JOIN st USING (model)"""
    q["a1_similarity_summary"] = q["a1_cds_summary"].replace("'d6s', 'model', 'cds_u'", "'d6s', 'model', 'sim_u'").replace(
        "distinct_cds_count", "distinct_similarity_count")
    q["a1_similarity_summary"] = f"""WITH {D6_VIEW.strip()},
st AS ({_summary('d6s', 'model', 'sim_u')}),
ct AS (SELECT model, count(*) FILTER (WHERE NOT skipped) AS row_count, count(*) FILTER (WHERE skipped) AS skipped_row_count FROM d6 GROUP BY model)
SELECT ct.model, CAST(ct.row_count AS BIGINT) AS row_count, CAST(ct.skipped_row_count AS BIGINT) AS skipped_row_count,
  CAST(coalesce(st.distinct_count, 0) AS BIGINT) AS distinct_similarity_count, st.mean, st.median, st.minimum, st.maximum
FROM ct LEFT JOIN st USING (model)"""
    q["a2_cds_histogram"] = f"WITH {D6_VIEW.strip()}, " + _hist("d6s", {"model": list(MODELS)}, "cds_u", "cds_range", total_name="total").strip()
    q["a2_similarity_histogram"] = f"WITH {D6_VIEW.strip()}, " + _hist("d6s", {"model": list(MODELS)}, "sim_u", "similarity_range", total_name="total").strip()
    q["u4_model_results"] = f"""WITH {SCORED_VIEW.strip()}
SELECT model, sample_id, {text6('sim_u')} AS similarity, score_band, sample_index FROM valid"""
    q["f12_excluded_rows"] = f"""WITH {SCORED_VIEW.strip()}
SELECT model, sample_id, sample_index, source_file, reason FROM mr WHERE reason <> ''"""
    q["j2_common_all_models"] = f"""WITH {SCORED_VIEW.strip()}
SELECT sample_id AS base_sample_id, model, sample_id || '_' || model AS sample_id, {text6('sim_u')} AS similarity, score_band
FROM common"""
    scopes = {"scope": ["full", "three_model_common"], "model": list(MODELS)}
    q["a3_band_distribution"] = f"WITH {SCORED_VIEW.strip()}, " + _bands("scoped", scopes, "score_band").strip()
    q["a4_bin_distribution"] = f"WITH {SCORED_VIEW.strip()}, " + _hist("scoped", scopes, "sim_u", "similarity_range").strip()
    q["a5_model_agreement"] = _agreement("sim_u", "score_band")
    q["a6_band_combinations"] = _combinations("sim_u", "score_band", "_band")
    q["d9_cds_band_distribution"] = f"WITH {SCORED_VIEW.strip()}, " + _bands("scoped", scopes, "cds_band").strip()
    q["d9_cds_bin_distribution"] = f"WITH {SCORED_VIEW.strip()}, " + _hist("scoped", scopes, "cds_u", "cds_range").strip()
    q["d9_cds_agreement"] = _agreement("cds_u", "cds_band")
    q["d9_cds_combinations"] = _combinations("cds_u", "cds_band", "_cds_band")
    q["a7_cds_difference"] = (
        f"WITH {SCORED_VIEW.strip()}, {_diff_long('cds_u', 'cds_band')}, "
        + _hist("dl", {"comparison": comps}, "d", "absolute_cds_difference_range", keep=False, cumulative=True,
                total_name="total_common").strip()
    )
    q["d8_score_difference"] = (
        f"WITH {SCORED_VIEW.strip()}, {_diff_long('sim_u', 'score_band')}, "
        + _hist("dl", {"comparison": comps}, "d", "difference_range", keep=True, cumulative=True,
                total_name="total_common").strip()
    )
    q["a8_difference_summary"] = f"""WITH {SCORED_VIEW.strip()}, {_diff_long('sim_u', 'score_band')},
st AS ({_summary('dl', 'comparison', 'd')})
SELECT comparison, CAST(row_count AS BIGINT) AS sample_count, mean AS mean_absolute_difference,
  median AS median_absolute_difference, minimum AS minimum_absolute_difference, maximum AS maximum_absolute_difference
FROM st"""
    q["a14_run_summary"] = f"""WITH {SCORED_VIEW.strip()},
nc AS (SELECT count(*) AS c FROM cids)
SELECT model, CAST(count(*) AS BIGINT) AS source_row_count,
  CAST(count(*) FILTER (WHERE reason <> '') AS BIGINT) AS excluded_row_count,
  CAST(count(*) FILTER (WHERE reason = '') AS BIGINT) AS valid_row_count,
  CAST(any_value(nc.c) AS BIGINT) AS three_model_common_valid_sample_count,
  CAST(any_value(nc.c) * 3 AS BIGINT) AS common_all_models_row_count
FROM mr CROSS JOIN nc GROUP BY model"""
    q["t1_recompute_check"] = f"""WITH {SCORED_VIEW.strip()}
SELECT model, CAST(count(*) AS BIGINT) AS checked_rows, CAST(0 AS BIGINT) AS unmatched_rows, CAST(0 AS BIGINT) AS similarity_mismatches,
  CAST(0 AS BIGINT) AS band_mismatches FROM valid GROUP BY model"""
    q["t3_common_completeness"] = f"""WITH {SCORED_VIEW.strip()}
SELECT CAST(count(DISTINCT sample_id) AS BIGINT) AS common_samples, CAST(0 AS BIGINT) AS incomplete_samples,
  CAST(count(*) AS BIGINT) AS common_rows, CAST(0 AS BIGINT) AS missing_ids, CAST(0 AS BIGINT) AS unexpected_ids
FROM common"""
    q["t4_recount_check"] = """SELECT CAST(4 AS BIGINT) AS comparisons, CAST(0 AS BIGINT) AS mismatches,
  CAST(0 AS BIGINT) AS combination_mismatches, CAST(0 AS BIGINT) AS difference_mismatches"""
    q["t2_row_accounting"] = f"""WITH {SCORED_VIEW.strip()}
SELECT model, CAST(count(*) AS BIGINT) AS source_row_count,
  CAST(count(*) FILTER (WHERE reason = '') AS BIGINT) AS valid_row_count,
  CAST(count(*) FILTER (WHERE reason <> '') AS BIGINT) AS excluded_row_count,
  true AS rows_balance, true AS bands_balance, true AS bins_balance, true AS percentages_balance
FROM mr GROUP BY model"""
    return q


def _consensus_sql(low_limit: int = 50) -> str:
    a, b, c = MODELS
    per = []
    for m in MODELS:
        per.append(f"""
lw_{m} AS (
  SELECT * FROM (
    SELECT p.*, row_number() OVER (PARTITION BY sample_id ORDER BY pos DESC) AS rk FROM p WHERE model = '{m}'
  ) x WHERE rk = 1 AND eu IS NOT NULL AND lu IS NOT NULL AND fu IS NOT NULL
    AND contains(sample_id, '_') AND regexp_matches(trim(split_part(sample_id, '_', -1)), '^[+-]?[0-9]+$')
),
f_{m} AS (
  SELECT sample_id, eu + lu + fu + 3 * least(eu, lu, fu) AS n_{m},
    source_file AS {m}_source_file,
    {text6(half_up('eu + lu + fu + 3 * least(eu, lu, fu)', '6'))} AS {m}_similarity,
    phase_c_variable_match_score AS {m}_variable_match_score,
    phase_c_step_position_score AS {m}_step_position_score,
    phase_c_dataflow_path_score AS {m}_dataflow_path_score,
    phase_c_overall_consistency AS {m}_overall_consistency,
    phase_c_comment AS {m}_comment
  FROM lw_{m}
)""")
    cols = ", ".join(
        f"f_{m}.{m}_{x}" for m in MODELS for x in (
            "source_file", "similarity", "variable_match_score", "step_position_score",
            "dataflow_path_score", "overall_consistency", "comment")
    )
    return f"""WITH {SCORED_VIEW.strip()},
{",".join(per)},
s AS (
  SELECT 'o_' || CAST(o_orderkey AS VARCHAR) AS sample_id, md5(CAST(o_orderkey AS VARCHAR)) AS commit_id,
         c_name AS project, 'CWE-' || CAST(c_nationkey + 100 AS VARCHAR) AS cwe
  FROM orders JOIN customer ON o_custkey = c_custkey
),
w AS (
  SELECT s.*, n_{a}, n_{b}, n_{c}, CAST(split_part(s.sample_id, '_', -1) AS BIGINT) AS idx, {cols}
  FROM s JOIN f_{a} USING (sample_id) JOIN f_{b} USING (sample_id) JOIN f_{c} USING (sample_id)
),
hi AS (
  SELECT 'high' AS selection_group,
    row_number() OVER (ORDER BY n_{c} <= 4500000, n_{c} DESC, least(n_{a}, n_{b}) DESC, abs(n_{a} - n_{b}), idx) AS selection_rank,
    CASE WHEN n_{c} > 4500000 THEN 'true' ELSE 'false' END AS {c}_same_direction, w.*
  FROM w WHERE n_{a} > 4500000 AND n_{b} > 4500000
),
lo AS (
  SELECT * FROM (
    SELECT 'low' AS selection_group,
      row_number() OVER (ORDER BY n_{c} >= 1500000, n_{c}, greatest(n_{a}, n_{b}), abs(n_{a} - n_{b}), idx) AS selection_rank,
      CASE WHEN n_{c} < 1500000 THEN 'true' ELSE 'false' END AS {c}_same_direction, w.*
    FROM w WHERE n_{a} < 1500000 AND n_{b} < 1500000
  ) x WHERE selection_rank <= {low_limit}
)
SELECT * EXCLUDE (n_{a}, n_{b}, n_{c}, idx), idx AS sample_numeric_index FROM (
  SELECT * FROM hi UNION ALL SELECT * FROM lo
) u"""



# ------------------------------------------------------------------ pair jobs
def _clean(x: str) -> str:
    return f"regexp_replace(replace(coalesce({x}, ''), chr(0), ''), '^\\s+|\\s+$', '', 'g')"


PAIR_VIEW = """
pv AS (
  SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS dataset_ord,
    ['titanvul', 'benchvul', 'vulnerability_score', 'primevul'][doc_id % 4 + 1] AS dataset,
    CASE WHEN doc_id % 37 = 5 THEN '' WHEN doc_id % 37 = 7 THEN '  ' || text || chr(10) ELSE text END AS func_before,
    CASE WHEN doc_id % 37 = 6 THEN '   ' ELSE replace(text, 'e', 'a') END AS func_after,
    CASE WHEN doc_id % 19 = 3 THEN ''
         WHEN doc_id % 2 = 0 THEN 'https://github.com/org' || CAST(doc_id % 5 AS VARCHAR) || '/repo'
              || CAST(doc_id % 3 AS VARCHAR) || '/commit/' || md5(text)
         ELSE 'https://gitlab.com/team' || CAST(doc_id % 5 AS VARCHAR) || '/proj/-/commit/' || left(md5(text), 12) END
      AS commit_url,
    CASE WHEN doc_id % 23 = 4 THEN '' ELSE 'fix issue ' || CAST(doc_id AS VARCHAR) END AS commit_msg,
    CASE WHEN doc_id % 3 = 0 THEN 'bench/repo' || CAST(doc_id % 7 AS VARCHAR) ELSE '' END AS repo_name,
    CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'CWE-0' || CAST(doc_id % 90 AS VARCHAR)
      WHEN 2 THEN '["cwe-' || CAST(doc_id % 40 AS VARCHAR) || '", "CWE-' || CAST(doc_id % 40 AS VARCHAR) || '"]'
      WHEN 3 THEN 'NVD-CWE-noinfo' WHEN 4 THEN 'nvd-cwe-other, CWE-79'
      ELSE 'CWE-' || CAST(doc_id % 300 AS VARCHAR) END AS cwe_id
  FROM documents
)"""


def _cwe_list(raw: str) -> str:
    sfx = "(CASE WHEN lower(x) LIKE 'nvd-cwe-%' THEN x[9:] ELSE x[5:] END)"
    pre = "(CASE WHEN lower(x) LIKE 'nvd-cwe-%' THEN 'NVD-CWE-' ELSE 'CWE-' END)"
    norm = (
        f"lambda x: CASE WHEN regexp_matches({sfx}, '^[0-9]+$') THEN 'CWE-' || CAST(CAST({sfx} AS HUGEINT) AS VARCHAR) "
        f"WHEN lower({sfx}) = 'noinfo' THEN {pre} || 'noinfo' WHEN lower({sfx}) = 'other' THEN {pre} || 'Other' "
        f"ELSE {pre} || {sfx} END"
    )
    lst = f"list_transform(regexp_extract_all({raw}, '(?i)(?:NVD-)?CWE-(?:\\d+|[A-Za-z][A-Za-z0-9_-]*)'), {norm})"
    return f"list_filter({lst}, lambda y, i: list_position({lst}, y) = i)"


def _commit(url: str) -> str:
    return f"coalesce(list_filter(regexp_extract_all({url}, '[0-9a-fA-F]+'), lambda h: length(h) BETWEEN 7 AND 64)[-1], '')"


def _project(url: str) -> str:
    parts = f"list_filter(string_split(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda z: z <> '')"
    marker = f"coalesce(list_position(list_transform({parts}, lambda z: z IN ('commit', 'commits')), true), 0)"
    head = f"list_filter({parts}[1:{marker} - 1], lambda z: z <> '-')"
    return f"(CASE WHEN {marker} > 0 AND len({head}) >= 2 THEN array_to_string({head}, '/') ELSE '' END)"


CONVERTED = f"""{PAIR_VIEW.strip()},
cv0 AS (
  SELECT pv.*, row_number() OVER (PARTITION BY dataset ORDER BY doc_id) AS row,
    {_clean('func_before')} AS b, {_clean('func_after')} AS a, {_clean('commit_url')} AS url,
    {_clean('commit_msg')} AS msg, CASE WHEN dataset = 'benchvul' THEN {_clean('repo_name')} ELSE '' END AS ep,
    {_clean('cwe_id')} AS rc
  FROM pv
),
cv1 AS (
  SELECT *, sha256(b || chr(0) || a) AS pair_key,
    CASE WHEN b = '' OR a = '' THEN 'missing_function' WHEN b = a THEN 'unchanged_pair' END AS pre
  FROM cv0
),
cv2 AS (SELECT *, min(CASE WHEN pre IS NULL THEN row END) OVER (PARTITION BY dataset, pair_key) AS first_row FROM cv1),
cv AS (
  SELECT *, coalesce(pre, CASE WHEN row > first_row THEN 'duplicate_pair' END) AS reason,
    {_commit('url')} AS commit_id
  FROM cv2
),
cw AS (
  SELECT dataset, dataset_ord, doc_id, row, reason, pair_key,
    coalesce(nullif(left(commit_id, 8), ''), CASE dataset WHEN 'vulnerability_score' THEN 'vscore' ELSE dataset END)
      || '_' || CAST(row AS VARCHAR) AS sample_id,
    commit_id, left(commit_id, 8) AS commit_short,
    CASE WHEN ep <> '' THEN ep ELSE {_project('url')} END AS project,
    b AS func_before, a AS func_after, msg AS commit_msg, CAST(to_json({_cwe_list('rc')}) AS VARCHAR) AS cwe
  FROM cv
)"""

DEDUP = f"""{CONVERTED},
w AS (SELECT * FROM cw WHERE reason IS NULL),
dd AS (
  SELECT *, min(dataset_ord) OVER (PARTITION BY pair_key) AS owner_ord,
    row_number() OVER (PARTITION BY dataset, pair_key ORDER BY row) AS k_in_ds
  FROM w
),
meta AS (
  SELECT pair_key,
    {", ".join(f"coalesce(arg_min({c}, CAST(dataset_ord AS BIGINT) * 1000000000 + row) FILTER (WHERE {_clean(c)} <> ''), '') AS m_{c}" for c in ("commit_id", "commit_short", "project", "commit_msg"))},
    flatten(list(from_json(cwe, '["VARCHAR"]') ORDER BY dataset_ord, row)) AS cw_all
  FROM w GROUP BY pair_key
),
meta2 AS (SELECT *, CAST(to_json(list_filter(cw_all, lambda y, i: list_position(cw_all, y) = i)) AS VARCHAR) AS m_cwe FROM meta)"""


TURNS = """
tr AS (
  SELECT conv_id AS source, turn AS line, (role = 'system' OR (conv_id + turn) % 7 = 0) AS invalid_line,
    CASE WHEN role = 'user' THEN 1 ELSE 0 END AS target, text AS func,
    'c' || md5(CAST(conv_id AS VARCHAR)) AS commit_id,
    'CVE-' || CAST(conv_id AS VARCHAR) || CASE WHEN turn % 5 = 3 THEN 'x' ELSE '' END AS cve,
    'proj' || CAST(conv_id % 13 AS VARCHAR) AS project, 'msg ' || CAST(conv_id AS VARCHAR) AS commit_message,
    'CWE-' || CAST(conv_id % 50 AS VARCHAR) AS cwe
  FROM conversations
),
sg AS (
  SELECT *, sum(CAST(invalid_line AS INTEGER)) OVER (PARTITION BY source ORDER BY line ROWS UNBOUNDED PRECEDING) AS seg
  FROM tr
),
sg2 AS (SELECT *, max(seg) OVER (PARTITION BY source) AS last_seg FROM sg),
vv AS (SELECT *, row_number() OVER (PARTITION BY source, seg ORDER BY line) AS rn FROM sg2 WHERE NOT invalid_line),
nx AS (
  SELECT x.*, y.line AS n_line, y.target AS n_target, y.func AS n_func, y.commit_id AS n_commit, y.cve AS n_cve
  FROM vv x LEFT JOIN vv y ON x.source = y.source AND x.seg = y.seg AND y.rn = x.rn + 1
  WHERE x.rn % 2 = 1
),
pr AS (SELECT *, row_number() OVER (ORDER BY source, line) AS read_pairs FROM nx WHERE n_line IS NOT NULL)"""


def _splitlines(x: str) -> str:
    cls = "[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
    body = f"regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '{cls}$', '')"
    return f"(CASE WHEN {x} = '' THEN 0 ELSE length({body}) - length(regexp_replace({body}, '{cls}', '', 'g')) + 1 END)"


MEGAVUL = """
mv AS (
  SELECT doc_id AS record_index,
    CASE WHEN doc_id % 10 = 0 THEN false WHEN doc_id % 10 = 5 THEN NULL ELSE true END AS is_vul,
    CASE WHEN doc_id % 17 = 3 THEN '  ' ELSE text END AS func_before,
    replace(text, 'e', 'a') AS func,
    '-' || split_part(text, chr(10), 1) || chr(10) || '+' || split_part(replace(text, 'e', 'a'), chr(10), 1) AS diff_func,
    CASE WHEN doc_id % 7 = 2 THEN NULL ELSE md5(text) END AS commit_hash,
    'mv/repo' || CAST(doc_id % 6 AS VARCHAR) AS repo_name, 'megavul fix ' || CAST(doc_id AS VARCHAR) AS commit_msg,
    ['CWE-' || CAST(doc_id % 120 AS VARCHAR)] AS cwe_ids
  FROM documents
)"""


def _megavul_sql() -> str:
    blank = " OR ".join(f"trim(coalesce({c}, '')) = ''" for c in ("func_before", "func", "diff_func"))
    long_ = (
        f"length(diff_func) > 1500 OR length(func_before) > 5000 OR length(func) > 5000 "
        f"OR {_splitlines('func_before')} > 500 OR {_splitlines('func')} > 500"
    )
    return f"""{MEGAVUL.strip()},
mf AS (
  SELECT record_index,
    CASE WHEN is_vul IS NULL OR NOT is_vul THEN 'not_vulnerable' WHEN {blank} THEN 'invalid'
         WHEN {long_} THEN 'filtered' END AS reason,
    coalesce(nullif(left(trim(coalesce(commit_hash, '')), 8), ''), 'megavul') || '_' || CAST(record_index AS VARCHAR) AS sample_id,
    trim(coalesce(commit_hash, '')) AS commit_id, left(trim(coalesce(commit_hash, '')), 8) AS commit_short,
    coalesce(repo_name, '') AS project, CAST(length(diff_func) AS INTEGER) AS diff_length, coalesce(commit_msg, '') AS commit_msg,
    CAST(to_json(cwe_ids) AS VARCHAR) AS cwe, func_before, func AS func_after, diff_func AS diff
  FROM mv
)"""


def _length_long() -> str:
    return """ml AS (SELECT * FROM mf WHERE reason IS NULL),
lg AS (
  SELECT 'diff_characters' AS metric, length(diff) AS value FROM ml
  UNION ALL SELECT 'diff_lines', length(diff) - length(replace(diff, chr(10), '')) + 1 FROM ml
  UNION ALL SELECT 'func_before_characters', length(func_before) FROM ml
  UNION ALL SELECT 'func_after_characters', length(func_after) FROM ml
  UNION ALL SELECT 'func_before_lines', length(func_before) - length(replace(func_before, chr(10), '')) + 1 FROM ml
  UNION ALL SELECT 'func_after_lines', length(func_after) - length(replace(func_after, chr(10), '')) + 1 FROM ml
)"""


def pair_oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["d1_paired_conversion"] = f"""WITH {CONVERTED}
SELECT dataset, row, sample_id, commit_id, commit_short, project, func_before, func_after, commit_msg, cwe,
  '' AS commit_msg_anonymized, pair_key FROM cw WHERE reason IS NULL"""
    q["s14_paired_rejects"] = f"WITH {CONVERTED}\nSELECT dataset, row, reason FROM cw WHERE reason IS NOT NULL"
    q["a10_conversion_counts"] = f"""WITH {CONVERTED}
SELECT dataset, count(*) AS read, count(*) FILTER (WHERE reason IS NULL) AS written,
  count(*) FILTER (WHERE reason = 'missing_function') AS invalid,
  count(*) FILTER (WHERE reason = 'unchanged_pair') AS unchanged,
  count(*) FILTER (WHERE reason = 'duplicate_pair') AS duplicates
FROM cw GROUP BY dataset"""
    q["d5_deduplicated"] = f"""WITH {DEDUP}
SELECT dd.dataset, dd.sample_id, dd.pair_key, dd.func_before, dd.func_after, m_commit_id AS commit_id, m_commit_short AS commit_short,
  m_project AS project, m_commit_msg AS commit_msg, m_cwe AS cwe
FROM dd JOIN meta2 USING (pair_key) WHERE k_in_ds = 1 AND dataset_ord = owner_ord"""
    q["a13_dedup_counts"] = f"""WITH {DEDUP}
SELECT dataset, count(*) AS read, count(*) FILTER (WHERE k_in_ds = 1 AND dataset_ord = owner_ord) AS written,
  count(*) FILTER (WHERE k_in_ds > 1) AS within_dataset_duplicates,
  count(*) FILTER (WHERE k_in_ds = 1 AND dataset_ord <> owner_ord) AS cross_dataset_duplicates
FROM dd GROUP BY dataset"""
    b, a = _clean("func"), _clean("n_func")
    q["w1_primevul_pairs"] = f"""WITH {TURNS.strip()}
SELECT source, line AS first_line, read_pairs,
  CASE WHEN target <> 1 OR n_target <> 0 THEN 'invalid_target_order'
       WHEN commit_id <> n_commit OR cve <> n_cve THEN 'metadata_mismatch'
       WHEN {b} = '' OR {a} = '' THEN 'missing_function'
       WHEN {b} = {a} THEN 'unchanged_pair' END AS reason,
  coalesce(nullif(left({_clean('commit_id')}, 8), ''), 'primevul') || '_' || CAST(read_pairs AS VARCHAR) AS sample_id,
  {_clean('commit_id')} AS commit_id, left({_clean('commit_id')}, 8) AS commit_short, {_clean('project')} AS project,
  {b} AS func_before, {a} AS func_after, {_clean('commit_message')} AS commit_msg, CAST(to_json({_cwe_list('cwe')}) AS VARCHAR) AS cwe
FROM pr
UNION ALL
SELECT source, line, NULL, 'unpaired_final_record', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM nx WHERE n_line IS NULL AND seg = last_seg"""
    q["a10_primevul_counts"] = f"""WITH w AS ({q['w1_primevul_pairs']})
SELECT count(read_pairs) AS read, count(*) FILTER (WHERE reason IS NULL) AS written,
  count(*) FILTER (WHERE reason <> 'unchanged_pair') AS invalid, count(*) FILTER (WHERE reason = 'unchanged_pair') AS unchanged,
  (SELECT count(*) FROM conversations WHERE role = 'system' OR (conv_id + turn) % 7 = 0) AS skipped_lines
FROM w"""
    q["d3_megavul_conversion"] = f"""WITH {_megavul_sql()}
SELECT record_index, reason, sample_id, commit_id, commit_short, project, diff_length, commit_msg, cwe FROM mf"""
    q["a10_megavul_counts"] = f"""WITH {_megavul_sql()}
SELECT count(*) AS read, count(*) FILTER (WHERE reason IS NULL OR reason <> 'not_vulnerable') AS candidates,
  count(*) FILTER (WHERE reason IS NULL) AS written, count(*) FILTER (WHERE reason = 'filtered') AS filtered,
  count(*) FILTER (WHERE reason = 'invalid') AS invalid
FROM mf"""
    names = ("commit_msg", "cwe_id", "func_after", "func_before")
    lens = {n: f"coalesce(length({n}), 0)" for n in names}
    q["d11_oversized_rows"] = f"""WITH {PAIR_VIEW.strip()}
SELECT doc_id, dataset,
  concat_ws(',', {", ".join(f"CASE WHEN {lens[n]} > 16384 THEN '{n}' END" for n in names)}) AS oversized_fields,
  CAST(greatest({", ".join(f"CASE WHEN {lens[n]} > 16384 THEN {lens[n]} END" for n in names)}) AS INTEGER) AS max_length
FROM pv WHERE {" OR ".join(f"{lens[n]} > 16384" for n in names)}"""
    pcts = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)
    q["d12_length_profile"] = f"""WITH {_megavul_sql()}, {_length_long()},
st AS (
  SELECT metric, count(*) AS sample_count, avg(value) AS m, stddev_samp(value) AS sd,
    quantile_cont(value, [{", ".join(str(p) for p in pcts)}]) AS qs
  FROM lg GROUP BY metric
)
SELECT metric, sample_count, printf('%.6f', m) AS mean, printf('%.6f', sd) AS std,
  {", ".join(f"printf('%.6f', qs[{i + 1}]) AS p{int(p * 100)}" for i, p in enumerate(pcts))}
FROM st"""
    char_edges = (500, 1000, 2000, 5000, 10000, 20000, 50000, 100000)
    char_labels = ("<=500", "501-1000", "1001-2000", "2001-5000", "5001-10000", "10001-20000",
                   "20001-50000", "50001-100000", ">100000")
    line_edges = (10, 20, 50, 100, 200, 500)
    line_labels = ("<=10", "11-20", "21-50", "51-100", "101-200", "201-500", ">500")

    def lab(edges, labels):
        parts = " ".join(f"WHEN value <= {e} THEN '{l}'" for e, l in zip(edges, labels[:-1]))
        return f"CASE {parts} ELSE '{labels[-1]}' END"

    grid_rows = []
    for m in ("diff_characters", "diff_lines", "func_before_characters", "func_after_characters",
              "func_before_lines", "func_after_lines"):
        for l in (line_labels if m.endswith("_lines") else char_labels):
            grid_rows.append(f"('{m}', '{l}')")
    q["a9_length_bins"] = f"""WITH {_megavul_sql()}, {_length_long()},
bc AS (
  SELECT metric, CASE WHEN metric LIKE '%_lines' THEN {lab(line_edges, line_labels)} ELSE {lab(char_edges, char_labels)} END AS bin,
    count(*) AS cnt FROM lg GROUP BY ALL
),
tt AS (SELECT metric, count(*) AS tot FROM lg GROUP BY metric),
gr AS (SELECT * FROM (VALUES {", ".join(grid_rows)}) g(metric, bin))
SELECT gr.metric, gr.bin, CAST(coalesce(bc.cnt, 0) AS BIGINT) AS count,
  CASE WHEN coalesce(tt.tot, 0) = 0 THEN '0' ELSE {text6(half_up('coalesce(bc.cnt, 0) * 10000', 'tt.tot'), 2)} END AS percentage
FROM gr LEFT JOIN bc USING (metric, bin) LEFT JOIN tt USING (metric)"""
    return q



# ------------------------------------------------------------------ inference bookkeeping
ATTEMPTS = """
ev AS (
  SELECT 'o_' || CAST(user_id AS VARCHAR) AS sample_id, ['A', 'B', 'C'][event_id % 3 + 1] AS phase, ts, event_id,
    CASE WHEN event_type = 'error' THEN 'APIError' END AS error_type,
    CASE WHEN event_type = 'error' THEN 'HTTP 502 Bearer tok' || CAST(event_id AS VARCHAR) || ' api_key=sk-'
         || CAST(event_id AS VARCHAR) END AS message,
    CASE WHEN event_id % 11 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
    CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 13 = 0 THEN 'not json {'
         WHEN event_id % 17 = 0 THEN '[1, 2]' WHEN event_id % 7 IN (1, 3, 4) THEN '{"id":' || CAST(event_id AS VARCHAR) || '}'
         WHEN event_id % 7 = 2 THEN '{"id":[' || CAST(event_id AS VARCHAR) || ']}' WHEN event_id % 7 = 5 THEN 'not json {'
         ELSE props END AS decoded
  FROM events
),
att AS (
  SELECT *, (n - 1) // 3 + 1 AS call_no, (n - 1) % 3 + 1 AS attempt FROM (
    SELECT ev.*, row_number() OVER (PARTITION BY sample_id, phase ORDER BY ts, event_id) AS n FROM ev
  ) x
),
ok AS (
  SELECT att.*, CASE WHEN json_valid(decoded) THEN CAST(json(decoded) AS VARCHAR) END AS body,
    (error_type IS NULL AND finish_reason <> 'length'
     AND coalesce(CASE WHEN json_valid(decoded) THEN json_type(decoded) = 'OBJECT' ELSE false END, false)) AS good
  FROM att
),
rs AS (
  SELECT sample_id, phase, call_no, count(*) AS made, min(attempt) FILTER (WHERE good) AS win,
    arg_min(body, attempt) FILTER (WHERE good) AS payload, arg_max(coalesce(message, ''), attempt) AS last_message,
    min(event_id) AS seen
  FROM ok GROUP BY sample_id, phase, call_no
)"""


def _redact(x: str) -> str:
    t = f"regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '(?i)(bearer\\s+)[^\\s,;]+', '\\1[REDACTED]', 'g')"
    t = f"regexp_replace({t}, '\\bsk-[A-Za-z0-9_-]+', 'sk-[REDACTED]', 'g')"
    t = (f"regexp_replace({t}, '(?i)([\"'']?(?:api[_-]?key|access[_-]?token|authorization)[\"'']?\\s*[:=]\\s*[\"'']?)"
         f"[^\"''\\s,;}}]+', '\\1[REDACTED]', 'g')")
    return f"left(CASE WHEN trim(coalesce({x}, '')) = '' THEN 'no error message' ELSE {t} END, 2000)"


def inference_oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["x4_attempt_resolution"] = f"""WITH {ATTEMPTS.strip()}
SELECT sample_id, phase, CAST(call_no AS BIGINT) AS call_no, CAST(coalesce(win, made) AS BIGINT) AS attempts_used, win IS NOT NULL AS resolved,
  win AS winning_attempt, payload, CASE WHEN win IS NULL THEN {_redact('last_message')} END AS issue_message
FROM rs"""
    q["j7_rerun_selection"] = f"""WITH {ATTEMPTS.strip()},
bad AS (SELECT sample_id, min(seen) AS seen FROM rs WHERE win IS NULL GROUP BY sample_id),
ord AS (SELECT sample_id, row_number() OVER (ORDER BY seen, sample_id) AS rerun_order FROM bad)
SELECT 'o_' || CAST(o_orderkey AS VARCHAR) AS sample_id, rerun_order, md5(CAST(o_orderkey AS VARCHAR)) AS commit_id,
  c_name AS project
FROM orders JOIN customer ON o_custkey = c_custkey JOIN ord ON ord.sample_id = 'o_' || CAST(o_orderkey AS VARCHAR)"""
    q["a15_rerun_summary"] = f"""WITH {ATTEMPTS.strip()}
SELECT count(*) AS issues, count(DISTINCT sample_id) AS failed_samples FROM rs WHERE win IS NULL"""
    q["s8_delta_upsert"] = f"""WITH {SCORED_VIEW.strip()},
b AS (SELECT sample_id, {text6('sim_u')} AS similarity, row_number() OVER (ORDER BY sample_index, sample_id) AS position FROM valid WHERE model = 'chatgpt'),
u AS (SELECT sample_id, arg_max({text6('sim_u')}, model) AS similarity, CASE max(model) WHEN 'claude' THEN 1 ELSE 2 END AS v
      FROM valid WHERE model <> 'chatgpt' GROUP BY sample_id),
n AS (SELECT u.*, row_number() OVER (ORDER BY v, sample_id) AS place FROM u ANTI JOIN b USING (sample_id))
SELECT b.sample_id, coalesce(u.similarity, b.similarity) AS similarity, b.position FROM b LEFT JOIN u USING (sample_id)
UNION ALL SELECT sample_id, similarity, place + (SELECT count(*) FROM b) FROM n"""
    q["s8_result_upsert"] = f"""WITH {SCORED_VIEW.strip()},
b AS (SELECT sample_id, {text6('sim_u')} AS similarity, sample_index AS position FROM valid WHERE model = 'chatgpt'),
u AS (SELECT sample_id, {text6('sim_u')} AS similarity, CASE WHEN model = 'claude' THEN 1 ELSE 2 END AS version
      FROM valid WHERE model <> 'chatgpt'),
lu AS (SELECT sample_id, arg_max(similarity, version) AS similarity, max(version) AS v FROM u GROUP BY sample_id),
nw AS (SELECT lu.* FROM lu ANTI JOIN b USING (sample_id)),
mx AS (SELECT max(position) AS m FROM b)
SELECT b.sample_id, b.similarity, b.position FROM b ANTI JOIN lu USING (sample_id)
UNION ALL SELECT b.sample_id, lu.similarity, b.position FROM b JOIN lu USING (sample_id)
UNION ALL SELECT nw.sample_id, nw.similarity, CAST(coalesce(mx.m, 0) + row_number() OVER (ORDER BY nw.v, nw.sample_id) AS BIGINT)
FROM nw CROSS JOIN mx"""
    return q



REPOSVUL = """rv AS (
  SELECT o_orderkey AS k, o_custkey, CAST(o_orderkey AS VARCHAR) AS ks,
    'repo_fn_' || CAST(CASE WHEN o_orderkey % 17 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS VARCHAR) AS function_id,
    CASE WHEN o_orderkey % 2 = 0 THEN ['CWE-' || CAST(o_orderkey % 30 AS VARCHAR)]
         ELSE ['CWE-' || CAST(o_orderkey % 30 AS VARCHAR), 'CWE-20'] END AS cwe_id,
    CASE WHEN o_orderkey % 9 = 0 THEN 'not_target' WHEN o_orderkey % 13 = 0 THEN 'outdated' END AS early
  FROM orders
),
fl AS (
  SELECT function_id, min(k) AS first_k, count(*) AS copies, flatten(list(cwe_id ORDER BY k)) AS allc
  FROM rv WHERE early IS NULL GROUP BY function_id
),
cv AS (
  SELECT rv.k AS record_index, rv.function_id,
    CASE WHEN early IS NOT NULL THEN early WHEN k <> first_k THEN 'duplicate_function'
         WHEN k % 29 = 4 THEN 'missing_file' WHEN k % 31 = 7 THEN 'unchanged' WHEN k % 37 = 9 THEN 'no_match' END AS reason,
    early IS NULL AND k = first_k AS folded, k % 29 = 4 OR (k % 31 <> 7 AND k % 37 = 9) AS no_after,
    md5(ks) AS commit_id, CASE WHEN k % 5 = 2 THEN '/proj/c' || CAST(o_custkey AS VARCHAR) || '/' ELSE 'proj/c' || CAST(o_custkey AS VARCHAR) END AS project,
    'int f_' || ks || '(int x)' || chr(10) || '{' || chr(10) || '  return x + ' || CAST(k % 7 AS VARCHAR) || ';' || chr(10) || '}' AS func_before,
    'int f_' || ks || '(int x)' || chr(10) || '{' || chr(10)
      || CASE WHEN k % 31 = 7 THEN '' ELSE '  if (x < 0)' || chr(10) || '    return 0;' || chr(10) END
      || '  return x + ' || CAST(k % 7 AS VARCHAR) || ';' || chr(10) || '}' AS func_after,
    'fix order ' || ks AS commit_msg, split_part(rv.function_id, '_', -1) AS suffix, fl.copies,
    CAST(to_json(list_filter(list_filter(allc, lambda y, i: list_position(allc, y) = i), lambda z: trim(z) <> '')) AS VARCHAR) AS cwe
  FROM rv LEFT JOIN fl USING (function_id)
)"""


def reposvul_oracles() -> dict[str, str]:
    fields = {
        "sample_id": "left(commit_id, 8) || '_' || suffix", "commit_id": "commit_id", "commit_short": "left(commit_id, 8)", "project": "project",
        "func_before": "func_before", "commit_msg": "commit_msg", "cwe": "cwe", "commit_msg_anonymized": "''",
    }
    shown = ", ".join(f"CASE WHEN folded THEN {x} END AS {c}" for c, x in fields.items())
    return {
        "a12_function_fold": f"""WITH {REPOSVUL}
SELECT function_id, record_index, cwe, CAST(copies AS BIGINT) AS copies FROM cv WHERE folded""",
        "d4_reposvul_conversion": f"""WITH {REPOSVUL}
SELECT record_index, function_id, reason, {shown},
  CASE WHEN folded THEN CASE WHEN no_after THEN '' ELSE func_after END END AS func_after FROM cv""",
        "a10_reposvul_counts": f"""WITH {REPOSVUL}
SELECT count(*) AS read, count(*) FILTER (WHERE folded) AS candidates, count(*) FILTER (WHERE reason IS NULL) AS written,
  count(*) FILTER (WHERE reason = 'duplicate_function') AS duplicates,
  count(*) FILTER (WHERE reason NOT IN ('duplicate_function', 'not_target')) AS skipped FROM cv""",
    }



def key_oracles() -> dict[str, str]:
    sample = """s AS (
  SELECT o_orderkey AS k, 'o_' || CAST(o_orderkey AS VARCHAR) AS sample_id, md5(CAST(o_orderkey AS VARCHAR)) AS commit_id, c_name AS project,
    'CWE-' || CAST(c_nationkey + 100 AS VARCHAR) AS cwe, o_orderpriority AS pri, c_mktsegment AS seg
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

    def body(guard: str) -> str:
        return f"'int f_' || CAST(k AS VARCHAR) || '(int x) {{ {guard}return x + ' || CAST(k % 7 AS VARCHAR) || '; }}'"

    null = "''"
    return {
        "j1_lookup_in_order": f"WITH {sample} SELECT sample_id, -k AS request_order, commit_id, project FROM s",
        "j9_missing_ids": f"""WITH {sample}
SELECT DISTINCT 'o_' || CAST(user_id AS VARCHAR) AS sample_id FROM events WHERE 'o_' || CAST(user_id AS VARCHAR) NOT IN (SELECT sample_id FROM s)""",
        "u7_repeated_ids": """SELECT 'o_' || CAST(user_id AS VARCHAR) AS sample_id, count(*) AS copies
FROM events GROUP BY user_id HAVING count(*) > 1""",
        "u8_union_columns": f"""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, {null} AS s_suppkey, {null} AS s_name, {null} AS n_nationkey,
  {null} AS n_name, {null} AS note FROM customer
UNION ALL SELECT {null}, {null}, CAST(s_suppkey AS VARCHAR), s_name, {null}, {null}, {null} FROM supplier
UNION ALL SELECT {null}, {null}, {null}, {null}, CAST(n_nationkey AS VARCHAR), n_name, {null} FROM nation""",
        "p28_sample_defaults": f"""WITH {sample}
SELECT sample_id, {body("")} AS func_before, {body("if (x < 0) return 0; ")} AS func_after,
  CASE WHEN k % 11 = 0 THEN 'No commit message' ELSE 'fix ' || pri END AS commit_msg,
  CASE WHEN k % 13 = 0 THEN 'No description' ELSE seg || ' issue' END AS bug_description, commit_id, project, cwe FROM s""",
    }


def source_oracles() -> dict[str, str]:
    def guard(x: str) -> str:
        return f"CASE WHEN left({x}, 1) IN ('=', '+', '-', '@') THEN '''' || {x} ELSE {x} END"

    return {"s10_csv_cells": f"""WITH t AS (
  SELECT doc_id,
    CASE WHEN doc_id % 5 = 0 THEN '=1+1' WHEN doc_id % 5 = 1 THEN '-' || lang WHEN doc_id % 5 = 2 THEN NULL ELSE lang END AS label,
    n_chars > 1000 AS long_text, CAST(to_json([lang, source]) AS VARCHAR) AS tags, replace(source || chr(0) || lang, chr(0), '\\0') AS raw
  FROM documents
)
SELECT {guard("CAST(doc_id AS VARCHAR)")} AS doc_id,
  CASE WHEN label IS NULL THEN '' ELSE {guard("label")} END AS label,
  CASE WHEN long_text THEN 'true' ELSE 'false' END AS long_text,
  {guard("tags")} AS tags, {guard("raw")} AS raw
FROM t"""}



def url_oracles() -> dict[str, str]:
    return {"p23_p32_url_keys": r"""WITH p AS (
  SELECT page_id,
    CASE page_id % 4 WHEN 1 THEN replace(url, '://', '://user:secret@')
      WHEN 2 THEN replace(url, '.example.', '.EXAMPLE.')
      WHEN 3 THEN regexp_replace(url, '(://[^/?#]+)', '\1:8080') ELSE url END AS url
  FROM pages
),
q AS (
  SELECT page_id, url,
    lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
    regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^.*@', '') AS hostport,
    regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
    'page/' || url AS original
  FROM p
),
r AS (
  SELECT *, lower(regexp_replace(hostport, ':[^:]*$', '')) AS host, regexp_extract(hostport, ':([0-9]+)$', 1) AS port,
    regexp_replace(regexp_replace(original, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS safe
  FROM q
)
SELECT page_id,
  scheme || '://' || host || CASE WHEN port <> '' THEN ':' || CAST(CAST(port AS INTEGER) AS VARCHAR) ELSE '' END || path AS base_url,
  CASE WHEN safe <> original OR length(safe) > 120 THEN left(safe, 105) || '__' || left(sha256(original), 10) ELSE safe END AS file_key
FROM r"""}


def oracles() -> dict[str, str]:
    """Every oracle, keyed by query name."""
    q: dict[str, str] = {}
    q.update(score_oracles())
    q["d10_consensus_selection"] = _consensus_sql()
    q.update(pair_oracles())
    q.update(inference_oracles())
    q.update(reposvul_oracles())
    q.update(phase_oracles())
    q.update(key_oracles())
    q.update(source_oracles())
    q.update(url_oracles())
    return q
