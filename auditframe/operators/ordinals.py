"""Stable global and per-group ordinals without a single-partition window.

``row_number() over (order by k)`` without a partition pulls every row into
one task. Here the rows are range-partitioned and sorted by the key (a
distributed sort), each partition is counted, and a row's ordinal is its
partition's offset plus its position inside the partition. The offsets
table has one row per partition (bounded by the partition count, broadcast).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SHIFT = 1 << 33  # monotonically_increasing_id = partition_id * 2^33 + index


def with_ordinal(df: DataFrame, order_cols: Sequence[str | Column], name: str = "ordinal") -> DataFrame:
    """Add a 1-based ordinal following ``order_cols`` (must be a unique key).

    One plan: both the per-partition counts and the numbered rows read the
    *same* range exchange (exchange reuse), so partition membership cannot
    differ between them; the offsets table has one row per partition and is
    broadcast. Range bounds come from Spark's sampler over that single
    exchange, and the order inside a partition is total.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    from auditframe.session import cut_lineage

    # partition ids and positions are materialised once (reliable checkpoint
    # in the shared folder): the counts and the numbered rows then read the
    # same rows, whatever plan each read gets, and a lost executor cannot
    # reshuffle them
    tagged = cut_lineage(ordered.select(
        "*",
        F.spark_partition_id().alias("_pid"),
        (F.monotonically_increasing_id() - F.spark_partition_id().cast("bigint") * _SHIFT).alias("_pos"),
    ))
    counts = tagged.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        tagged.join(F.broadcast(offsets), "_pid", "inner")
        .withColumn(name, (F.col("_off") + F.col("_pos") + 1).cast("bigint"))
        .drop("_pid", "_pos", "_off")
    )


def with_group_ordinal(
    df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column], name: str = "ordinal"
) -> DataFrame:
    """1-based ordinal inside each group (``row_number() over (partition by g
    order by k)``), computed from one global ordinal and the group's first one,
    so a huge group is still spread over many tasks."""
    g = list(group_cols)
    glob = with_ordinal(df, [*g, *order_cols], "_gord")
    starts = glob.groupBy(*g).agg(F.min("_gord").alias("_gstart"))
    return (
        glob.join(starts, g, "inner")
        .withColumn(name, F.col("_gord") - F.col("_gstart") + 1)
        .drop("_gord", "_gstart")
    )


def with_running_sums(
    df: DataFrame, order_cols: Sequence[str | Column], values: dict[str, Column], ordinal: str = "ordinal"
) -> DataFrame:
    """Global ordinal plus inclusive running sums of ``values`` in
    ``order_cols`` order (unique key), without a one-task window.

    Rows are range-partitioned and sorted; a window *per range partition*
    (balanced by the sampler, however the keys are skewed) gives local
    running sums, and a broadcast table of per-partition totals (one row per
    partition) turns them into global ones."""
    from auditframe.session import cut_lineage

    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    tagged = cut_lineage(ordered.select(
        "*",
        F.spark_partition_id().alias("_pid"),
        (F.monotonically_increasing_id() - F.spark_partition_id().cast("bigint") * _SHIFT).alias("_pos"),
        *[v.cast("bigint").alias(f"_v_{k}") for k, v in values.items()],
    ))
    w = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = tagged.select("*", *[F.sum(f"_v_{k}").over(w).alias(f"_r_{k}") for k in values])
    totals = tagged.groupBy("_pid").agg(F.count("*").alias("_n"), *[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_on"),
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in values],
    )
    out = local.join(F.broadcast(offsets), "_pid", "inner").withColumn(
        ordinal, (F.col("_on") + F.col("_pos") + 1).cast("bigint"))
    for k in values:
        out = out.withColumn(k, (F.col(f"_o_{k}") + F.col(f"_r_{k}")).cast("bigint"))
    drop = ["_pid", "_pos", "_on"] + [f"_{p}_{k}" for k in values for p in ("v", "r", "o")]
    return out.drop(*drop)
