"""Scalable ordinals / running sums against row_number and Python brute force."""

import random
import statistics
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditframe.operators import stats
from auditframe.operators.ordinals import with_group_ordinal, with_ordinal, with_running_sums


def test_ordinal_matches_row_number(spark):
    df = spark.range(0, 3000).select((F.col("id") * 7919 % 3000).alias("k"), (F.col("id") % 4).alias("g"))
    a = with_ordinal(df, ["g", "k"], "o")
    b = df.withColumn("r", F.row_number().over(Window.orderBy("g", "k")))
    assert a.join(b, ["g", "k"]).where("o != r").count() == 0
    c = with_group_ordinal(df, ["g"], ["k"], "o")
    d = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert c.join(d, ["g", "k"]).where("o != r").count() == 0


def test_running_sums_skewed_key(spark):
    rnd = random.Random(3)
    rows = [(0 if i < 1500 else rnd.randint(1, 50), i, int(rnd.random() < 0.2)) for i in range(2500)]
    df = spark.createDataFrame(rows, "src long, line long, flag int")
    out = {(r["src"], r["line"]): (r["ordinal"], r["run"])
           for r in with_running_sums(df, ["src", "line"], {"run": F.col("flag")}).collect()}
    total = 0
    for i, (s, l, f) in enumerate(sorted(rows), start=1):
        total += f
        assert out[(s, l)] == (i, total)


def test_summary_matches_python(spark):
    rnd = random.Random(11)
    vals = [Decimal(rnd.randint(-2000000, 2000000)).scaleb(-6) for _ in range(501)] + [Decimal("0.35")] * 4
    df = spark.createDataFrame([("g", str(v)) for v in vals], "g string, v string")
    got = stats.summary_stats(df, ["g"], F.col("v").cast("decimal(19,6)")).collect()[0]

    def text(d):
        t = format(d, "f")
        return (t.rstrip("0").rstrip(".") if "." in t else t) or "0"

    mean = (sum(vals) / len(vals)).quantize(Decimal("0.000001"), rounding=ROUND_HALF_UP)
    assert got["mean"] == text(mean)
    assert got["median"] == text(Decimal(statistics.median(vals)))
    assert (got["minimum"], got["maximum"]) == (text(min(vals)), text(max(vals)))
    assert got["distinct_count"] == len(set(vals))
    even = vals[:-1]
    assert len(even) % 2 == 0
    df2 = spark.createDataFrame([("h", str(v)) for v in even], "g string, v string")
    got2 = stats.summary_stats(df2, ["g"], F.col("v").cast("decimal(19,6)")).collect()[0]
    assert got2["median"] == text(Decimal(statistics.median(even)))


def test_lineage_scope(spark):
    import os

    from auditframe.session import cut_lineage, lineage_scope

    kept = cut_lineage(spark.range(5))
    with lineage_scope(spark):
        inner = cut_lineage(spark.range(7))
        path = inner.inputFiles()[0].removeprefix("file:").removeprefix("//").rsplit("/", 1)[0]
        assert inner.count() == 7 and os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 5
