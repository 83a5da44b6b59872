"""Aggregation building blocks: exact median/mean, zero-filled grids, histograms.

Everything is partial-aggregation friendly: values are first reduced to
(group, value, count) so hot groups never travel as raw rows, and ranks are
found among the distinct values, spread over tasks (``operators/quantiles.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditframe.functions import score as S
from auditframe.operators.quantiles import at_rank, ranked_counts


def grid(spark: SparkSession, dims: dict[str, Sequence]) -> DataFrame:
    """Every combination of the given literal values (generator, no join).

    The result has prod(len(values)) rows, fixed by the parameters, never by data.
    """
    df = spark.range(1).select()
    for name, values in dims.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df


def zero_fill(counts: DataFrame, grid_df: DataFrame, keys: Sequence[str], count_col: str = "count") -> DataFrame:
    """Counts with 0 for the combinations of a small grid that have none; counted
    combinations outside the grid (a model that was not named) stay.
    """
    return counts.join(grid_df, list(keys), "full_outer").withColumn(
        count_col, F.coalesce(F.col(count_col), F.lit(0)).cast("bigint")
    )


def value_counts(df: DataFrame, group_cols: Sequence[str], value: Column) -> DataFrame:
    """(group, value in micro-units, count): the partial-aggregated input of A1."""
    g = list(group_cols)
    return df.select(*g, S.to_micro(value).alias("_v")).groupBy(*g, "_v").agg(F.count("*").alias("_n"))


def summary_from_counts(counts: DataFrame, group_cols: Sequence[str], skip_col: str | None = None) -> DataFrame:
    """A1 from (group, _v, _n): count, distinct, mean (HALF_UP), exact median,
    min, max as shortest text. The median is found by rank over the *distinct*
    values, whose running counts are spread over tasks by value range.

    With ``skip_col`` the counts also hold skipped rows (flag true); they are
    left out of the statistics and counted in ``skipped_row_count``, so one
    count table serves both without being read twice."""
    g = list(group_cols)
    if not g:
        raise ValueError("summary statistics need at least one group column")
    keep = ~F.col(skip_col) if skip_col else F.lit(True)
    c = counts.withColumn("_nv", F.when(keep, F.col("_n")).otherwise(F.lit(0)))
    # rows that are left out have no place among the values
    order = [*g, F.col("_v").asc_nulls_first(), *([skip_col] if skip_col else [])]
    ranked = ranked_counts(c, g, "_v", "_nv", order)
    k1 = F.floor((F.col("_tot") + 1) / 2)
    k2 = F.floor(F.col("_tot") / 2) + 1
    v = F.when(F.col("_nv") > 0, F.col("_v"))
    agg = ranked.groupBy(*g).agg(
        F.sum("_nv").alias("row_count"),
        F.sum(F.col("_n") - F.col("_nv")).alias("skipped_row_count"),
        F.count_distinct(v).alias("distinct_count"),
        F.sum(v * F.col("_nv")).cast(S.BIG).alias("_sum"),
        F.min(v).alias("_min"),
        F.max(v).alias("_max"),
        (at_rank(k1, "_v", "_nv") + at_rank(k2, "_v", "_nv")).cast(S.BIG).alias("_med2"),
    )
    has = F.col("row_count") > 0
    return agg.select(
        *g,
        "row_count",
        "skipped_row_count",
        "distinct_count",
        F.when(has, S.micro_text(S.half_up_div(F.col("_sum"), F.col("row_count")))).alias("mean"),
        F.when(has, S.micro_text(F.col("_med2") * 5, 7)).alias("median"),
        F.when(has, S.micro_text(F.col("_min"))).alias("minimum"),
        F.when(has, S.micro_text(F.col("_max"))).alias("maximum"),
    )


def summary_stats(df: DataFrame, group_cols: Sequence[str], value: Column) -> DataFrame:
    """A1 over a DECIMAL(.,6) value in one pass over the rows."""
    return summary_from_counts(value_counts(df, group_cols, value), group_cols).drop("skipped_row_count")


def bin_histogram(
    df: DataFrame,
    group_cols: Sequence[str],
    groups: dict[str, Sequence],
    value: Column,
    label_name: str,
    keep_out_of_range: bool = True,
    cumulative: bool = False,
    total_name: str = "total_valid",
) -> DataFrame:
    """0.1-bin histogram per group; bins 0..9 always present,
    ``< 0.0`` / ``> 1.0`` only when non-empty (or never, when not kept);
    percentages of all values in the group; optional running totals (W2).

    The rows are read once: per-(group, bin) counts are full-outer-joined to
    the literal grid (out-of-range bins survive the join), and totals and
    running sums are windows over that grid-sized table."""
    spark = df.sparkSession
    g = list(group_cols)
    counts = df.select(*g, S.bin_index(value).alias("_bin")).groupBy(*g, "_bin").agg(F.count("*").alias("count"))
    base = grid(spark, {**groups, "_bin": list(range(10))})
    filled = base.join(counts, g + ["_bin"], "full_outer").withColumn(
        "count", F.coalesce(F.col("count"), F.lit(0)).cast("bigint")
    )
    total = F.sum("count").over(Window.partitionBy(*g)).cast("bigint")
    filled = filled.withColumn(total_name, total)
    if not keep_out_of_range:
        filled = filled.where(F.col("_bin").between(0, 9))
    cols = [*g, S.bin_label(F.col("_bin")).alias(label_name), "count",
            S.percentage(F.col("count"), F.col(total_name)).alias("percentage")]
    if cumulative:
        w = Window.partitionBy(*g).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = F.sum("count").over(w)
        cols += [cum.cast("bigint").alias("cumulative_count"),
                 S.percentage(cum, F.col(total_name)).alias("cumulative_percentage")]
    cols.append(total_name)
    return filled.select(*cols, F.col("_bin").alias("bin_index"))


def band_distribution(
    df: DataFrame, group_cols: Sequence[str], groups: dict[str, Sequence], band_col: str
) -> DataFrame:
    """A3: three-band counts per group, all bands present, with percentages
    (rows read once; totals are a window over the grid-sized table)."""
    spark = df.sparkSession
    g = list(group_cols)
    counts = df.groupBy(*g, F.col(band_col).alias("band")).agg(F.count("*").alias("count"))
    base = grid(spark, {**groups, "band": list(S.BAND_ORDER)})
    filled = zero_fill(counts, base, g + ["band"])
    definition = F.create_map(*[x for b in S.BAND_ORDER for x in (F.lit(b), F.lit(S.BAND_DEFINITIONS[b]))])
    total = F.sum("count").over(Window.partitionBy(*g)).cast("bigint")
    filled = filled.withColumn("total_valid", total)
    return filled.select(
        *g,
        "band",
        definition[F.col("band")].alias("band_definition"),
        "count",
        S.percentage(F.col("count"), F.col("total_valid")).alias("percentage"),
        "total_valid",
    )
