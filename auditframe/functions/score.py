"""Exact score arithmetic (P10..P17) as Column expressions.

Scores are DECIMAL, never DOUBLE: Spark's ``round`` on DECIMAL is HALF_UP,
matching Python ``Decimal.quantize(..., ROUND_HALF_UP)``. Aggregates that must
be exact (mean, percentage, median) are computed on integer micro-units.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from auditframe.functions.text import py_strip, strip_field

# Result-table column names the scorers read.
SCORE_COLUMNS = (
    "phase_c_variable_match_score",
    "phase_c_step_position_score",
    "phase_c_dataflow_path_score",
)
RAW_COLUMNS = ("phase_a_raw", "phase_b_raw", "phase_c_raw")

# Band order, band definitions, band thresholds.
BAND_ORDER = ("low", "middle", "high")
BAND_DEFINITIONS = {
    "low": "(-inf, 0.25]",
    "middle": "(0.25, 0.75)",
    "high": "[0.75, +inf)",
}
LOW_CUT = "0.25"
HIGH_CUT = "0.75"

SCORE_TYPE = DecimalType(18, 9)
MICRO = 1_000_000
BIG = DecimalType(38, 0)
SORT_LAST = 2**63 - 1

# Python's Decimal accepts these spellings and calls them non-finite.
_NON_FINITE = r"(?i)^[+-]?(s?nan[0-9]*|inf|infinity)$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_score(c) -> Column:
    """P10: text -> DECIMAL(18,9); NULL for blank, non-number, NaN, infinity."""
    return strip_field(_c(c)).try_cast(SCORE_TYPE)


def is_non_finite_text(c) -> Column:
    return py_strip(_c(c)).rlike(_NON_FINITE)


def similarity_unrounded(e, l, f) -> Column:
    """((E+L+F)/3 + min(E,L,F)) / 2, kept exact as a DECIMAL quotient."""

    a, b, c = _c(e), _c(l), _c(f)
    return (a + b + c + F.least(a, b, c) * 3) / F.lit(6)


def similarity(e, l, f, digits: int = 6) -> Column:
    """Composite similarity rounded HALF_UP to ``digits`` (0..15)."""
    if isinstance(digits, bool) or not isinstance(digits, int) or not 0 <= digits <= 15:
        raise ValueError("round_digits must be an integer from 0 to 15")
    return F.round(similarity_unrounded(e, l, f), digits).cast(DecimalType(12 + digits, digits))


def cds(sim: Column, digits: int = 6) -> Column:
    """CDS = 1 - rounded similarity."""
    return (F.lit(1) - sim).cast(DecimalType(13 + digits, digits))


def band(value: Column) -> Column:
    """Inclusive ends, <= 0.25 low, >= 0.75 high, else middle (NULL stays NULL)."""

    v = value
    return (
        F.when(v <= F.lit(LOW_CUT).cast("decimal(3,2)"), "low")
        .when(v >= F.lit(HIGH_CUT).cast("decimal(3,2)"), "high")
        .when(v.isNotNull(), "middle")
    )


def band_from_numerator(e, l, f) -> Column:
    """Band of the *unrounded* similarity, decided on the
    exact numerator E+L+F+3*min compared with 6*cut, so no division happens."""

    a, b, c = _c(e), _c(l), _c(f)
    num = a + b + c + F.least(a, b, c) * 3
    return (
        F.when(num <= F.lit("1.5").cast("decimal(2,1)"), "low")
        .when(num >= F.lit("4.5").cast("decimal(2,1)"), "high")
        .when(num.isNotNull(), "middle")
    )


def bin_index(value: Column) -> Column:
    """0.1 bins; -1 below 0, 10 above 1, 0 at zero, else ceil(v/0.1)-1 capped at 9."""

    v = value
    return (
        F.when(v < 0, F.lit(-1))
        .when(v > 1, F.lit(10))
        .when(v == 0, F.lit(0))
        .otherwise(F.least(F.ceil(v * 10).cast("int") - 1, F.lit(9)))
    )


def bin_label(index: Column) -> Column:
    """P14 labels: ``[0.0, 0.1]``, ``(0.1, 0.2]`` .. ``(0.9, 1.0]``, ``< 0.0``, ``> 1.0``."""

    i = index
    left = F.when(i == 0, F.lit("[")).otherwise(F.lit("("))
    start = F.format_string("%d.%d", F.floor(i / 10), i % 10)
    end = F.format_string("%d.%d", F.floor((i + 1) / 10), (i + 1) % 10)
    return (
        F.when(i < 0, F.lit("< 0.0"))
        .when(i > 9, F.lit("> 1.0"))
        .otherwise(F.concat(left, start, F.lit(", "), end, F.lit("]")))
    )


def decimal_text(value: Column) -> Column:
    """Shortest text (no trailing zeros, no trailing point); plain notation.

    For DECIMAL with scale > 0 the text always has a point, so trimming
    trailing '0' and then '.' is exact; integral text is left alone."""
    s = value.cast("string")
    return F.when(s.contains("."), F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))).otherwise(s)


def to_micro(value: Column) -> Column:
    """DECIMAL with scale <= 6 -> exact integer micro-units (DECIMAL(38,0))."""
    return (value * MICRO).cast(BIG)


def idiv(a: Column, b: Column) -> Column:
    """SQL integer division (``div``) on DECIMAL(38,0) operands, exact."""
    return F.call_function("div", a.cast(BIG), b.cast(BIG)).cast(BIG)


def micro_text(micro: Column, scale_digits: int = 6) -> Column:
    """Integer units of 10^-scale_digits -> shortest decimal text.

    The integer (|v| < 10^25) times the exact literal 10^-scale gives a
    DECIMAL(33+, scale) with no rounding; it is printed plainly and trimmed
    of trailing zeros and point."""
    step = F.lit(Decimal(1).scaleb(-scale_digits)).cast(DecimalType(scale_digits + 1, scale_digits))
    return decimal_text(micro.cast(DecimalType(25, 0)) * step)


def half_up_div(num: Column, den: Column) -> Column:
    """Exact HALF_UP (away from zero) rounding of num/den for integers, den > 0."""
    d = den.cast(BIG)
    n = num.cast(BIG)
    mag = idiv(F.abs(n) * 2 + d, d * 2)
    return F.when(n < 0, -mag).otherwise(mag)


def percentage_micro(count: Column, total: Column) -> Column:
    """P16 in micro-units: count*100/total HALF_UP to 6 digits; 0 when total is 0."""
    t = total.cast(BIG)
    return F.when(t == 0, F.lit(0).cast(BIG)).otherwise(
        half_up_div(count.cast(BIG) * 100 * MICRO, F.when(t == 0, 1).otherwise(t))
    )


def percentage(count: Column, total: Column) -> Column:
    """P16 as text (``"33.333333"``, ``"0"`` when total is 0)."""
    return micro_text(percentage_micro(count, total))


def sample_suffix(sample_id: Column) -> Column:
    """Integer after the last ``_`` or NULL when there is none / it is not an integer."""
    tail = F.regexp_extract(sample_id, "_([^_]*)$", 1)
    return F.when(F.instr(sample_id, "_") > 0, _py_int(tail))


def _py_int(text: Column) -> Column:
    # Python int() accepts surrounding white space, a sign and digits.
    t = py_strip(text)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))


def sample_sort_key(sample_id: Column) -> Column:
    """Numeric suffix of the id; ids without one sort last."""
    return F.coalesce(sample_suffix(sample_id), F.lit(SORT_LAST).cast("bigint"))
