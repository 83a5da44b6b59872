"""J1, J9, U7, U8."""

import pytest

from auditframe.operators import keys as K


def test_lookup_in_order(spark):
    samples = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "sample_id string, v int")
    req = spark.createDataFrame([("b", 1), ("a", 2)], "sample_id string, request_order int")
    assert [r["sample_id"] for r in K.lookup_in_order(samples, req).collect()] == ["b", "a"]
    with pytest.raises(ValueError, match="not found"):
        K.lookup_in_order(samples, spark.createDataFrame([("z", 1)], "sample_id string, request_order int"))


def _jobs(spark, build):
    """The result of ``build`` and the number of jobs it ran."""
    sc = spark.sparkContext
    sc.setJobGroup("checks-in-plan", "checks")
    try:
        out = build()
        return out, len(sc.statusTracker().getJobIdsForGroup("checks-in-plan"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_lookup_checked_by_its_run(spark):
    samples = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 4), (None, 5)], "sample_id string, v int")

    def lookup(*ids, of=samples):
        req = spark.createDataFrame([(x, -i) for i, x in enumerate(ids)], "sample_id string, request_order int")
        out, jobs = _jobs(spark, lambda: K.lookup_in_order(of, req, in_plan=True))
        assert jobs == 0 and out.columns == ["sample_id", "v", "request_order"]
        return out

    assert [tuple(r) for r in lookup("a", "b").collect()] == [("b", 2, -1), ("a", 1, 0)]
    assert [r["v"] for r in lookup("a", "b", "a").collect()] == [1, 2, 1]
    assert lookup().collect() == []
    for ids, text in ((("a", "z", "y"), "not found: y"), (("a", None), "not found: null"), (("a", "c"), "repeated sample ids in input: c")):
        for use in (lambda d: d.collect(), lambda d: d.count(), lambda d: d.select("v").where("v = 1").collect()):
            with pytest.raises(Exception, match=text):
                use(lookup(*ids))
    with pytest.raises(Exception, match="not found: a"):
        lookup("a", of=samples.where("v > 99")).collect()


def test_unique_checked_by_its_run(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "sample_id string, v int")
    out, jobs = _jobs(spark, lambda: K.require_unique(a, in_plan=True))
    assert jobs == 0 and sorted(r["v"] for r in out.collect()) == [1, 2, 3]
    assert K.require_unique(a.where("v > 9"), in_plan=True).collect() == []
    for twice, text in ((a.union(a.where("v = 2")), "duplicate sample_id: b"), (a.union(a.where("v = 3")), "duplicate sample_id: null")):
        bad = K.require_unique(twice, in_plan=True)
        with pytest.raises(Exception, match=text):
            bad.collect()
        with pytest.raises(ValueError, match=text):
            K.require_unique(twice)


def test_missing_unique_union(spark):
    a = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    b = spark.createDataFrame([("b",)], "sample_id string")
    assert [r[0] for r in K.missing_ids(a, b).collect()] == ["a"]
    with pytest.raises(ValueError):
        K.require_unique(a.unionByName(b))
    x = spark.createDataFrame([("1", "p")], "id string, p string")
    y = spark.createDataFrame([("2", "q")], "id string, q string")
    u = K.union_all_columns([x, y], extra=("similarity",))
    assert u.columns == ["id", "p", "q", "similarity"]
    assert sorted(tuple(r) for r in u.collect()) == [("1", "p", "", ""), ("2", "", "q", "")]


def test_checked_upsert(spark):
    import pytest

    from auditframe.plans.inference import checked_upsert

    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "sample_id string, comment string, position bigint")
    new = spark.createDataFrame([("b", "z", 1)], "sample_id string, comment string, version bigint")
    assert sorted(tuple(r) for r in checked_upsert(old, new).collect()) == [("a", "x", 1), ("b", "z", 2)]
    with pytest.raises(ValueError, match="duplicate"):
        checked_upsert(old.union(old), new)
    with pytest.raises(Exception, match="duplicate sample_id: a"):
        # the upsert numbers its new rows as it is built
        checked_upsert(old.union(old), new, in_plan=True).collect()
    with pytest.raises(ValueError, match="other columns"):
        checked_upsert(old, new.withColumnRenamed("comment", "text"))
