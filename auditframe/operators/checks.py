"""Checks whose outcome is a row of data: a ``problem`` table holds one text, null
when all is well. It fails the run of a plan that carries it, or is read at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_problem(df: DataFrame, *cases: tuple[Column, Column]) -> DataFrame:
    """The one-row problem table of ``df``: the text of the first case (an aggregate
    condition, a text) that holds."""
    text = F.coalesce(*[F.when(condition, text) for condition, text in cases], F.lit(None).cast("string"))
    return df.agg(text.alias("problem"))


def enforce(df: DataFrame, problem: DataFrame, in_plan: bool) -> DataFrame:
    """``df`` under a check. ``in_plan``: no job runs here, ``df``'s own run fails with
    the text (the one-row table is broadcast to it). Otherwise the table is read now
    and a ``ValueError`` raised."""
    if not in_plan:
        text = problem.first()["problem"]
        if text is not None:
            raise ValueError(text)
        return df
    one = problem.toDF("_problem").where(
        F.when(F.col("_problem").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("_problem")).cast("boolean"))).select(F.lit(1).alias("_checked"))
    return df.withColumn("_check", F.lit(1)).join(F.broadcast(one), F.col("_check") == F.col("_checked")).drop("_check", "_checked")
