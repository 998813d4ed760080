"""Steps whose cost must not outgrow their input: the same results as the plain way on odd rows, and the shape of the plan."""

import datetime
import math
import random

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from surgekit import session
from surgekit.operators import ml as M
from surgekit.operators import ordering as O
from surgekit.operators import scoring as SC
from surgekit.operators import tables as TB
from surgekit.operators.quantiles import exact_quantiles, quantiles_long


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_time_split_as_by_position_and_without_sorting_whole_rows(spark):
    rng = random.Random(7)
    start = datetime.datetime(2001, 3, 1)
    for n, days in ((0, 1), (1, 1), (7, 3), (400, 9), (400, 1)):
        rows = [(None if rng.random() < 0.1 else start + datetime.timedelta(hours=rng.randrange(24 * days)),
                 None if rng.random() < 0.1 else rng.randrange(40), i) for i in range(n)]
        df = spark.createDataFrame(rows, "ts timestamp, key long, payload long")
        got = O.time_split(df, "ts", "key").collect()
        assert sorted(r["payload"] for r in got) == list(range(n))
        order = {"train": 0, "val": 1, "test": 2}
        ranked = sorted(((r["ts"] is not None, r["ts"] or start, r["key"] is not None, r["key"] or 0, order[r["split"]]) for r in got))
        cuts = int(n * 0.7), int(n * (0.7 + 0.15))
        assert [r[-1] for r in ranked] == [0 if i < cuts[0] else 1 if i < cuts[1] else 2 for i in range(n)]
    one = spark.createDataFrame([(start, 1, i) for i in range(100)], "ts timestamp, key long, payload long")  # all rows alike
    assert {r["split"]: r["count"] for r in O.time_split(one, "ts", "key").groupBy("split").count().collect()} == {"train": 70, "val": 15, "test": 15}
    apart = spark.createDataFrame([(start, i) for i in range(100)], "ts timestamp, key long")
    assert not any(x in _plan(O.time_split(apart, "ts", "key")) for x in ("Sort", "Window", "Join"))


def test_quantiles_of_a_frame_read_twice(spark):
    rng = random.Random(3)
    rows = [(g, v) for g in ("a", "b", None) for v in [rng.gauss(0, 10) for _ in range(200)] + [0.0] * 50 + [-0.0, 1e300, -1e300, math.inf, 5e-324, None, math.nan]]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.995}
    plain = {r["g"]: r for r in exact_quantiles(df, "v", probs, by=["g"], nparts=5, count_col="n").collect()}
    again = {r["g"]: r for r in exact_quantiles(df, "v", probs, by=["g"], nparts=5, count_col="n", reread=True).collect()}
    assert plain == again and len(again) == 3
    known = [v for g, v in rows if g == "a" and v is not None and not math.isnan(v)]
    assert again["a"]["n"] == len(known) and abs(again["a"]["p50"] - np.quantile(known, 0.5)) < 1e-12
    wide = spark.createDataFrame([(float(i), 7.0) for i in range(1000)], "a double, b double")
    got = {r["feature"]: r["m"] for r in quantiles_long(wide, ["a", "b"], {"m": 0.5}, reread=True).collect()}
    assert got == {"a": 499.5, "b": 7.0}


def test_explanations_of_a_wide_frame(spark):
    rows = [(1, 1.0, 5.0), (1, 9.0, None), (2, 5.0, 1.0), (None, 0.0, 9.0), (None, 4.0, 4.0), (3, None, math.nan)]
    wide = spark.createDataFrame(rows, "k long, a double, b double")
    stats = spark.createDataFrame([("a", 2.0, 8.0), ("b", 2.0, 8.0)], "feature string, p25 double, p75 double")
    texts = spark.createDataFrame([(f, x, f"{f} {x}") for f in "ab" for x in ("high", "low", "medium") if (f, x) != ("a", "medium")],
                                  "feature string, level string, description string")
    weights = spark.createDataFrame([("a", 0.1), ("b", 0.4)], "feature string, importance double")
    long = wide.select("k", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in "ab"])).alias("kv")).select("k", "kv.*")
    for w in (weights, None):
        want = SC.explanation_rows(long, stats, texts, "k", w, top=3)
        got = SC.explanation_rows(wide, stats, texts, "k", w, top=3, features=["a", "b"])
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_name_search_deals_names_out_and_keeps_ids_only(spark):
    ents = spark.createDataFrame([(3, "Anna"), (2, "Hannah"), (2, "Banna"), (None, "Anna"), (5, None), (9, "zz")], "cid long, name string")
    q = spark.createDataFrame([(1, "ANN"), (1, "ANN"), (2, "zz"), (3, "none"), (4, ""), (5, None)], "qid long, q string")
    found = TB.first_containing(q, ents, "qid", "q", "cid", "name")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, "Banna"), (1, 2, "Banna"), (2, 9, "zz"), (4, 2, "Banna")]
    assert "Repartition" in _plan(found) and "min(struct" not in _plan(found)


def test_fits_run_few_tasks_a_step(spark):
    df = spark.range(0, 1000, 1, 40)
    assert M.sized(df, 100_000).rdd.getNumPartitions() == 1
    assert M.sized(df, 5_400_000).rdd.getNumPartitions() == 14


def test_shuffles_begin_by_input_size(spark):
    try:
        session.size_shuffles(spark, 6 << 30)
        assert session.shuffle_tasks(spark) == 1536
        assert O.global_rank(spark.range(3), ["id"]).count() == 3
    finally:
        session.size_shuffles(spark, 1 << 20)
    assert session.shuffle_tasks(spark) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_matrix_is_joined_once(spark):
    from surgekit.plans.catalog_features import matrix
    from surgekit.plans.catalog_ml import split_matrix
    for df in (matrix(spark, SF_SMALL), split_matrix(spark, SF_SMALL)):
        assert "Join" not in _plan(df) and "Aggregate" not in _plan(df)
