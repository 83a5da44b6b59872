"""Exact order statistics of many values per group without a one-task window.

The input is a table of distinct values with their counts. Its rows are range
partitioned by (group, value), so a group of many distinct values lies in many
tasks; running counts are taken per range partition and shifted by the totals of
the partitions before (``operators/ordinals.py``). A group's running count begins
at the smallest one of its rows. The value at a rank is then a filter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.operators.ordinals import with_running_sums


def ranked_counts(
    counts: DataFrame, group_cols: Sequence[str], value_col: str, count_col: str, order: Sequence[str | Column] | None = None,
) -> DataFrame:
    """``counts``, distinct by (group, value), with ``_before``: how many values of
    the group stand before the row's, and ``_tot``: all values of the group.
    ``order``: a total order by group and value, where these are not distinct."""
    g = list(group_cols)
    run = with_running_sums(counts, order or [*g, value_col], {"_run": F.col(count_col)}).drop("ordinal")
    groups = run.groupBy(*g).agg(F.min(F.col("_run") - F.col(count_col)).alias("_start"), F.sum(count_col).alias("_tot"))
    matched = groups.select(*[F.col(c).alias(f"_g_{c}") for c in g], "_start", "_tot")
    same = F.lit(True)
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return run.join(matched, same).withColumn("_before", F.col("_run") - F.col(count_col) - F.col("_start")).drop(
        "_run", "_start", *[f"_g_{c}" for c in g])


def at_rank(rank: Column, value_col: str, count_col: str) -> Column:
    """Aggregate over ``ranked_counts``: the value at a 1-based rank."""
    return F.max(F.when((F.col("_before") < rank) & (rank <= F.col("_before") + F.col(count_col)), F.col(value_col)))


def values_at(ranked: DataFrame, group_cols: Sequence[str], value_col: str, count_col: str, ranks: Mapping[str, Column]) -> DataFrame:
    """One row per group with the values at ``ranks`` (columns over ``_tot``)."""
    return ranked.groupBy(*group_cols).agg(*[at_rank(r, value_col, count_col).alias(name) for name, r in ranks.items()])


def interpolated(ranked: DataFrame, group_cols: Sequence[str], value_col: str, count_col: str, shares: Sequence[float]) -> DataFrame:
    """One row per group: ``_q``, the linearly interpolated quantiles at ``shares``."""
    ranks, g = {}, list(group_cols)
    for i, p in enumerate(shares):
        at = (F.col("_tot") - 1) * F.lit(float(p))
        ranks |= {f"_lo{i}": F.floor(at) + 1, f"_hi{i}": F.ceil(at) + 1}
    found = ranked.groupBy(*g).agg(F.max("_tot").alias("_tot"), *[at_rank(r, value_col, count_col).alias(n) for n, r in ranks.items()])
    out = []
    for i, p in enumerate(shares):
        at = (F.col("_tot") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        out.append(F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi))
    return found.select(*g, F.array(*out).alias("_q"))
