"""Fused quality rules against the check-by-check suite, and the labelling decision as a lazy relation."""

import itertools

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from surgekit.functions import exprs as X
from surgekit.operators import labels as L
from surgekit.operators import quality as Q


def _tables(spark):
    child = spark.createDataFrame([(1, 1, 5.0, "a"), (1, 1, -1.0, "b"), (2, 9, None, "z"), (None, None, 3.0, None),
                                   (None, 9, 4.0, "a"), (3, 2, 200.0, "a")] + [(50 + i, 9, 1.0, "a") for i in range(40)],
                                  "k int, owner long, x double, s string")
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    return child, parent


def test_rules_equal_the_suite(spark):
    child, parent = _tables(spark)
    rules = [Q.Rule("uk", "child", key=["k"]), Q.Rule("pair", "child", key=["k", "owner"]),
             Q.Rule("fk", "child", key=["owner"], parent=("parent", "id"), severity="warn"),
             Q.Rule("range", "child", Q.outside_range("x", 0, 100)), Q.Rule("s", "child", Q.outside_values("s", ["a", "b"])),
             Q.Rule("null", "child", F.col("x").isNull()), Q.Rule("parent_uk", "parent", key=["id"]),
             Q.Rule("off", "child", F.lit(True), enabled=False)]
    want = Q.run_suite([Q.Check("uk", Q.unique(child, ["k"])), Q.Check("pair", Q.unique(child, ["k", "owner"])),
                        Q.Check("fk", Q.relationships(child, "owner", parent, "id"), "warn"),
                        Q.Check("range", Q.accepted_range(child, "x", 0, 100)),
                        Q.Check("s", Q.accepted_values(child, "s", ["a", "b"])), Q.Check("null", Q.not_null(child, "x")),
                        Q.Check("parent_uk", Q.unique(parent, ["id"]))])
    got = Q.run_rules(rules, {"child": child, "parent": parent})
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert {r["check_name"]: r["failures"] for r in got.collect()}["fk"] == 42
    none = Q.run_rules(rules, {"child": child.where("false"), "parent": parent.where("false")}).collect()
    assert len(none) == 7 and all(r["status"] == "pass" for r in none)


def test_rules_told_wrongly(spark):
    child, _ = _tables(spark)
    for rule in (Q.Rule("a", "child"), Q.Rule("b", "child", F.lit(True), key=["k"]), Q.Rule("c", "nowhere", F.lit(True)),
                 Q.Rule("d", "child", key=["k", "owner"], parent=("child", "k"))):
        with pytest.raises(ValueError):
            Q.run_rules([rule], {"child": child})


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_suite_reads_each_relation_once(spark):
    import __spark_entry__ as E
    assert _scans(E.queries()["q10_quality_suite"](spark, SF_SMALL)) <= 11


def _walk(rows, strategy, thr0, vel):
    """The threshold walk told as the loop it is."""
    def label(r, s, t):
        return {"existing": r[2], "ratio": r[0] >= t, "combined": r[0] >= t or r[1] >= vel}[s]

    def rate(s, t):
        return 100.0 * sum(label(r, s, t) for r in rows) / len(rows)

    s = strategy if strategy != "auto" else ("existing" if 8 <= rate("existing", 0) <= 20 else "combined")
    t = thr0
    for _ in range(L.ADJUST_MAX_ITER):
        if s == "existing" or 5 <= rate(s, t) <= 30:
            break
        t = round(t + (-0.5 if rate(s, t) < 5 else 0.5), 1)
    return s, t


def test_labelling_decision_walks_like_a_loop(spark):
    low = [(0.2 * i, 0.0, i % 9 == 0) for i in range(12)]
    high = [(1.0 * i, 0.0, False) for i in range(30)]
    mixed = [(0.1 * i, 2.0 if i % 5 == 0 else 0.0, i % 2 == 0) for i in range(60)]
    for rows, strategy, thr0 in itertools.product((low, high, mixed), L.STRATEGIES, (3.0, 1.2)):
        d = spark.createDataFrame(rows, "view_ratio double, velocity_score double, is_potentially_viral boolean")
        got = tuple(L.labelling_decision(d, strategy, thr0).first())
        assert got == _walk(rows, strategy, thr0, 1.0), (len(rows), strategy, thr0)
    with pytest.raises(ValueError):
        L.labelling_decision(d, "guess")


def test_labels_start_no_job_while_planned(spark):
    from surgekit.operators import tables as TB
    from surgekit.plans.catalog import base
    from surgekit.sources import fixtures as fx
    b = base(spark, SF_SMALL)      # opening a table reads its footers in a job
    names = fx.table(spark, SF_SMALL, "customer").select("c_custkey", "c_name")
    texts = fx.table(spark, SF_SMALL, "supplier").select("s_suppkey", "s_name")
    sc = spark.sparkContext
    sc.setJobGroup("plan-only", "plans of labels and of the name search")
    try:
        labeled = L.viral_label(b["engagement"], b["channel_summary"])
        L.label_quality_report(labeled, b["enhanced"], b["engagement"])
        TB.first_containing(texts, names, "s_suppkey", "s_name", "c_custkey", "c_name")
        assert list(sc.statusTracker().getJobIdsForGroup("plan-only")) == []
        assert labeled.where("is_viral = 1").count() > 0
        assert list(sc.statusTracker().getJobIdsForGroup("plan-only")) != []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_value_texts(spark):
    rows = [("like_ratio", 0.1234), ("avg_views", 1500.0), ("avg_views", 2500.0), ("avg_views", 1250000.0), ("avg_views", 12.0),
            ("size_tier", 4.0), ("trend", 0.0), ("trend", 1.5), ("other", 2.0), (None, 1.0), ("other", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "f string, v double").select(X.feature_value_text("f", "v")).collect()]
    assert got == ["12.34%", "2K", "2K", "1.2M", "12.000", "10,000 subscribers", "N/A", "1.50x", "2.000", None, None]
