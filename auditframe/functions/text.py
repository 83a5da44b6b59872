"""Text projections as built-in Column expressions (no Python in the hot path).

P1..P7, P9, P17..P19, P21, P23, P24, P27, P32, P33. The only text rule that
needs Python is the unified diff (P8), in ``auditframe.functions.udfs``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes exactly the characters for which
# str.isspace() is true (all below U+3001); derived here by that rule and
# handed to btrim, which is far cheaper than a Unicode regex.
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
# The same characters as ranges of a regex class: far cheaper than a Unicode one.
_WS_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A lone plain space is what a run becomes.
_WS_RUN_RE = rf"[{_WS_CLASS}]{{2,}}|[{_WS_CLASS}&&[^ ]]"

# Default texts of an input sample.
DEFAULT_COMMIT_MSG = "No commit message"
DEFAULT_DESCRIPTION = "No description"
# Pandas missing-value words that count as blank on input.
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# Labels of the unified diff.
DIFF_FROM = "before (vulnerable)"
DIFF_TO = "after (fixed)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` equivalent."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def strip_field(c) -> Column:
    """``py_strip`` of a short stored field, which seldom needs it: a text whose first
    and last characters are visible ASCII is taken as it is, since ``btrim`` looks up
    every character at the ends and copies the text. For plain columns: ``c`` is named
    four times."""
    t = _c(c)
    visible = (t >= F.lit("!")) & (t < F.lit("\u007f")) & F.right(t, F.lit(1)).between(F.lit("!"), F.lit("~"))
    return F.when(visible, t).otherwise(py_strip(t))


def clean(c) -> Column:
    """Null -> "", NUL removed, surrounding white space stripped."""
    return py_strip(F.replace(F.coalesce(_c(c), F.lit("")), F.lit("\u0000"), F.lit("")))


def is_blank(c) -> Column:
    return F.coalesce(py_strip(_c(c)) == "", F.lit(True))


def has_visible(c) -> Column:
    """``~is_blank`` of a text that is no NULL, found at the first character that is no
    white space: nothing is stripped, and ``c`` is named once."""
    return _c(c).rlike(f"[^{_WS_CLASS}]")


def text_with_default(c, default: str, anonymized=None, na_words: bool = True) -> Column:
    """Preferred anonymised text, else plain text, else the default.

    Blank (after strip) and, when ``na_words``, the pandas NA words count as
    missing; a present value is kept unstripped.
    """
    def present(x: Column) -> Column:
        s = py_strip(x)
        ok = x.isNotNull() & (s != "")
        if na_words:
            ok = ok & ~s.isin(*NA_WORDS)
        return ok

    plain = _c(c)
    out = F.when(present(plain), plain).otherwise(F.lit(default))
    if anonymized is not None:
        anon = _c(anonymized)
        out = F.when(present(anon), anon).otherwise(out)
    return out


# Fixed value: commit id pattern, 7..64 hex digits not touching other hex digits.
COMMIT_RE = r"(?<![0-9a-fA-F])[0-9a-fA-F]{7,64}(?![0-9a-fA-F])"


def commit_id_from_url(url) -> Column:
    """Last standalone run of 7..64 hex digits, else ""."""
    found = F.regexp_extract_all(F.coalesce(_c(url), F.lit("")), F.lit(COMMIT_RE), 0)
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def project_from_url(url) -> Column:
    """Path parts before the first ``commit``/``commits`` part, ``-`` dropped,
    joined by ``/``; "" when no marker or fewer than two parts."""
    path = F.coalesce(F.try_parse_url(F.coalesce(_c(url), F.lit("")), F.lit("PATH")), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    marker = F.array_position(
        F.transform(parts, lambda p: p.isin("commit", "commits")), F.lit(True)
    )
    before = F.when(marker > 1, F.slice(parts, F.lit(1), (marker - 1).cast("int"))).otherwise(
        F.array().cast("array<string>")
    )
    head = F.filter(before, lambda p: p != "-")
    return F.when((marker > 0) & (F.size(head) >= 2), F.array_join(head, "/")).otherwise(F.lit(""))


# Fixed value: CWE token pattern (case-insensitive).
CWE_RE = r"(?i)(?:NVD-)?CWE-(?:\d+|[A-Za-z][A-Za-z0-9_-]*)"


def cwe_values(raw) -> Column:
    """P5: CWE tokens canonicalised (leading zeros dropped, noinfo / Other,
    NVD- prefix kept), first occurrence order, distinct."""
    found = F.regexp_extract_all(F.coalesce(_c(raw), F.lit("")), F.lit(CWE_RE), 0)

    def norm(m: Column) -> Column:
        nvd = F.lower(m).startswith("nvd-cwe-")
        prefix = F.when(nvd, F.lit("NVD-CWE-")).otherwise(F.lit("CWE-"))
        suffix = F.when(nvd, F.substring(m, 9, 1 << 20)).otherwise(F.substring(m, 5, 1 << 20))
        digits = suffix.rlike(r"^[0-9]+$")
        return (
            F.when(digits, F.concat(F.lit("CWE-"), F.regexp_replace(suffix, "^0+(?=[0-9])", "")))
            .when(F.lower(suffix) == "noinfo", F.concat(prefix, F.lit("noinfo")))
            .when(F.lower(suffix) == "other", F.concat(prefix, F.lit("Other")))
            .otherwise(F.concat(prefix, suffix))
        )

    return F.array_distinct(F.transform(found, norm))


def cwe_json(values: Column) -> Column:
    """CWE list as the JSON text stored in the pair table."""
    return F.to_json(values)


def pair_key(before, after) -> Column:
    """SHA-256 hex of clean(before) + NUL + clean(after)."""
    return F.sha2(F.concat(clean(before), F.lit("\u0000"), clean(after)), 256)


def sample_id(commit_id, fallback: str | Column, ordinal) -> Column:
    """``<first 8 of commit id or fallback>_<ordinal>``."""
    fb = F.lit(fallback) if isinstance(fallback, str) else fallback
    prefix = F.left(F.coalesce(_c(commit_id), F.lit("")), F.lit(8))
    return F.concat(F.when(prefix != "", prefix).otherwise(fb), F.lit("_"), _c(ordinal).cast("string"))


def line_count_splitlines(c) -> Column:
    """P9 rule 1: ``len(text.splitlines())``."""
    t = F.coalesce(_c(c), F.lit(""))
    breaks = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
    body = F.regexp_replace(t, f"(?:{breaks})$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(body, breaks, -1)))


def line_count_newlines(c) -> Column:
    """P9 rule 2: ``text.count("\\n") + 1``."""
    t = _c(c)
    return F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1


# Fenced payload pattern (case-insensitive, dot matches newline).
FENCE_RE = r"(?is)^```(?:json)?[ \t\r\n]+(.*?)\s*```$"


def unwrap_code_fence(c) -> Column:
    """Strip, drop a leading BOM, unwrap a Markdown code fence."""
    stripped = strip_bom(c)
    return F.when(stripped.rlike(FENCE_RE), fenced_payload(stripped)).otherwise(stripped)


def strip_bom(c) -> Column:
    """P19, first step: strip, drop a leading BOM."""
    return F.ltrim(py_strip(_c(c)), F.lit("\ufeff"))


def fenced_payload(stripped: Column) -> Column:
    """P19, second step: what stands inside a code fence."""
    return py_strip(F.regexp_extract(stripped, FENCE_RE, 1))


# Secret patterns redacted from diagnostic text.
BEARER_RE = r"(?i)(bearer\s+)[^\s,;]+"
SK_RE = r"\bsk-[A-Za-z0-9_-]+"
KEY_VALUE_RE = (
    r"""(?i)(["']?(?:api[_-]?key|access[_-]?token|authorization)["']?\s*[:=]\s*["']?)[^"'\s,;}]+"""
)
# A text that is empty: replaced without naming the text twice.
_EMPTY_RE = r"\A\z"
SECRET_KEY_RE = r"(?i)(api[_-]?key|access[_-]?token|authorization|secret)"


def safe_diagnostic_text(c, limit: int) -> Column:
    """Collapse white space, redact bearer / sk- / key=value secrets, cut."""
    text = py_strip(F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), _WS_RUN_RE, " "))
    text = F.regexp_replace(text, _EMPTY_RE, "no error message")
    text = F.regexp_replace(text, BEARER_RE, "$1[REDACTED]")
    text = F.regexp_replace(text, SK_RE, "sk-[REDACTED]")
    text = F.regexp_replace(text, KEY_VALUE_RE, "$1[REDACTED]")
    return F.left(text, F.lit(limit))


def safe_error_message(c) -> Column:
    """Issue message: white space collapsed, bearer and sk- redacted, 1000 chars."""
    text = py_strip(F.regexp_replace(F.coalesce(_c(c), F.lit("")), _WS_RUN_RE, " "))
    text = F.regexp_replace(text, _EMPTY_RE, "no error message")
    text = F.regexp_replace(text, r"(?i)(bearer\s+)[^\s]+", "$1[REDACTED]")
    text = F.regexp_replace(text, SK_RE, "sk-[REDACTED]")
    return F.left(text, F.lit(1000))


def redact_string_leaf(c) -> Column:
    """P22 rule for one string value: bearer and sk- redacted, 4000 chars."""
    text = F.regexp_replace(_c(c), BEARER_RE, "$1[REDACTED]")
    return F.left(F.regexp_replace(text, SK_RE, "sk-[REDACTED]"), F.lit(4000))


def safe_base_url(c) -> Column:
    """Scheme://host[:port]/path[;params] without credentials, query, fragment."""
    url = F.coalesce(_c(c), F.lit(""))
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    hostport = F.regexp_replace(rest, r"^.*@", "")
    bracketed = hostport.startswith("[")
    host = F.when(bracketed, F.regexp_extract(hostport, r"^(\[[^\]]*\])", 1)).otherwise(
        F.lower(F.regexp_replace(hostport, r":[^:]*$", ""))
    )
    port_txt = F.when(bracketed, F.regexp_extract(hostport, r"^\[[^\]]*\]:(.*)$", 1)).otherwise(
        F.when(hostport.contains(":"), F.regexp_extract(hostport, r":([^:]*)$", 1)).otherwise(F.lit(""))
    )
    port_ok = port_txt.rlike(r"^[0-9]+$") & (port_txt.try_cast("int") <= 65535)
    port = F.when(port_ok, F.concat(F.lit(":"), port_txt.try_cast("int").cast("string"))).otherwise(F.lit(""))
    host = F.when(~bracketed & host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    valid = (scheme != "") & (host != "") & (host != "[]")
    return F.when(valid, F.concat(F.lower(scheme), F.lit("://"), host, port, path)).otherwise(
        F.lit("[invalid base URL]")
    )


def function_name(c) -> Column:
    """Last identifier followed by ``(`` in the text before the first ``{``."""
    head = F.split_part(F.coalesce(_c(c), F.lit("")), F.lit("{"), F.lit(1))
    names = F.regexp_extract_all(head, F.lit(r"([A-Za-z_$][\w$]*)\s*\("), 1)
    return F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit(""))


def safe_filename(c) -> Column:
    """Collision-free storage key for a sample id."""
    original = py_strip(_c(c))
    safe = F.regexp_replace(
        F.regexp_replace(original, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""
    )
    changed = (safe != original) | (F.length(safe) > 120)
    keyed = F.concat(F.left(safe, F.lit(105)), F.lit("__"), F.left(F.sha2(original, 256), F.lit(10)))
    return F.when(safe == "", F.lit(None).cast("string")).when(changed, keyed).otherwise(safe)


def prefixed(df_cols: list[str], prefix: str) -> list[Column]:
    """Columns renamed ``<prefix>_<name>``."""
    return [F.col(c).alias(f"{prefix}_{c}") for c in df_cols]
