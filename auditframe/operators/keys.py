"""Key lookups and duplicate policies that are not winner rules:
J1 (lookup in request order), J9 (missing / unexpected ids), U7 (strict
duplicates), U8 (union of tables with different columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.operators.checks import enforce, one_problem


def _named(key: Column) -> Column:
    """A key as a message shows it."""
    return F.coalesce(key.cast("string"), F.lit("null"))


def lookup_in_order(samples: DataFrame, requested: DataFrame, key: str = "sample_id",
                    order: str = "request_order", in_plan: bool = False) -> DataFrame:
    """Samples for the requested ids, in request order; ids that are not
    found (null too), or found more than once, are an error that names the smallest.
    ``requested`` is (key, order); the samples side is reduced to the requested
    keys by a semi join first. One aggregate over the keys alone finds both errors;
    ``in_plan`` leaves them to the run of the result, otherwise they raise here."""
    asked = requested.select(key)
    found = samples.join(asked, key, "left_semi")
    copies = found.select(key, F.lit(1).alias("_n")).unionByName(asked.select(key, F.lit(0).alias("_n"))).groupBy(key).agg(F.sum("_n").alias("_n"))
    name, n = _named(F.col(key)), F.col("_n")
    repeated, missing = F.min(F.when(n > 1, name)), F.min(F.when(n == 0, name))
    problem = one_problem(
        copies,
        (repeated.isNotNull(), F.concat(F.lit("repeated sample ids in input: "), repeated)),
        (missing.isNotNull(), F.concat(F.lit("sample ids not found: "), missing)))
    # every request stays in the join, so a run that finds no sample at all still meets the check
    joined = enforce(requested, problem, in_plan).join(found, key, "left")
    return joined.select(*samples.columns, *[c for c in requested.columns if c != key]).orderBy(order)


def missing_ids(expected: DataFrame, present: DataFrame, key: str = "sample_id") -> DataFrame:
    """Expected ids that are absent (``left_anti``)."""
    return expected.select(key).distinct().join(present.select(key), key, "left_anti")


def repeated_ids(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, copies) of the ids that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def require_unique(df: DataFrame, key: str = "sample_id", in_plan: bool = False) -> DataFrame:
    """``df``; any repeated id is an error that names the smallest (one aggregate
    over the ids alone). ``in_plan`` leaves it to the run of the result."""
    least = F.min(_named(F.col(key)))
    problem = one_problem(repeated_ids(df.select(key), key), (least.isNotNull(), F.concat(F.lit(f"duplicate {key}: "), least)))
    return enforce(df, problem, in_plan)


def union_all_columns(frames: Sequence[DataFrame], extra: Sequence[str] = ()) -> DataFrame:
    """U8: ordered union of tables whose columns differ; missing columns are
    empty strings; the column order is the first-seen order, then ``extra``."""
    order: list[str] = []
    for f in frames:
        for c in f.columns:
            if c not in order:
                order.append(c)
    for c in extra:
        if c not in order:
            order.append(c)
    out = None
    for f in frames:
        g = f.select(*[(F.col(c) if c in f.columns else F.lit("")).cast("string").alias(c) for c in order])
        out = g if out is None else out.unionByName(g)
    return out
