"""Order statistics over many distinct values against a direct computation."""

import random
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from auditframe.operators import stats
from auditframe.operators.quantiles import interpolated, ranked_counts, values_at


def test_ranks_and_quantiles(spark):
    rng = random.Random(3)
    data = {g: [rng.randrange(-50, 10**rng.randrange(1, 12)) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 3000), (None, 7))}
    rows = [(g, v) for g, vs in data.items() for v in vs]
    counts = spark.createDataFrame(rows, "g string, v bigint").groupBy("g", "v").agg(F.count("*").alias("n"))
    ranked = ranked_counts(counts, ["g"], "v", "n")
    shares = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)
    third = values_at(ranked, ["g"], "v", "n", {"third": F.lit(3), "last": F.col("_tot")}).collect()
    assert {r["g"]: (r["third"], r["last"]) for r in third} == {g: (sorted(v)[2] if len(v) > 2 else None, max(v)) for g, v in data.items()}
    for r in interpolated(ranked, ["g"], "v", "n", shares).collect():
        assert np.allclose(r["_q"], np.quantile(data[r["g"]], shares), rtol=1e-12)


def test_median_of_many_digits_is_spread(spark):
    """15 digits: as many distinct values as rows, found without a window per group."""
    rng = random.Random(4)
    values = [Decimal(rng.randrange(10**6)).scaleb(-6) for _ in range(5001)]
    df = spark.createDataFrame([("m", i % 7 == 0, v) for i, v in enumerate(values)], "model string, skipped boolean, s decimal(18,6)")
    counts = stats.value_counts(df, ["model", "skipped"], F.col("s"))
    out = stats.summary_from_counts(counts, ["model"], skip_col="skipped")
    kept = sorted(v for i, v in enumerate(values) if i % 7)
    r = out.first()
    n = len(kept)
    assert Decimal(r["median"]) == (kept[(n - 1) // 2] + kept[n // 2]) / 2
    assert (r["row_count"], r["skipped_row_count"]) == (n, 5001 - n)
    ranked = ranked_counts(counts.withColumn("k", F.when(F.col("skipped"), 0).otherwise(F.col("_n"))), ["model"], "_v", "k", ["model", "_v", "skipped"])
    assert ranked.select(F.spark_partition_id()).distinct().count() > 1
