"""Rows-only operators: ML properties (labels in {0,1}, probabilities in [0,1], row counts preserved,
percentile-rank boundaries), the model store, and streaming vs batch."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from surgekit.operators import boosting as B
from surgekit.operators import ml as M
from surgekit.operators import profiles as PR
from surgekit.plans.catalog import base
from surgekit.plans.catalog_features import matrix


def test_labels_binary_and_rows_preserved(spark):
    b = base(spark, SF_SMALL)
    m = matrix(spark, SF_SMALL)
    assert {r[0] for r in m.select("is_viral").distinct().collect()} <= {0, 1}
    n_label = E.queries()["c04_viral_label"](spark, SF_SMALL).count()
    assert m.count() == n_label
    z = E.queries()["c08_zscore_labels"](spark, SF_SMALL)
    assert z.count() == b["engagement"].count()


def test_gbt_probabilities_and_threshold(spark):
    s = E.queries()["m01_gbt_test_scores"](spark, SF_SMALL)
    r = s.agg(F.min("p_viral"), F.max("p_viral"), F.count("*")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0 and r[2] > 0
    thr = M.f1_optimal_threshold(s, "is_viral").first()
    assert 0.0 <= thr["optimal_threshold"] <= 1.0
    assert 0.1 <= thr["recall_threshold"] <= thr["precision_threshold"] <= 0.9


def test_percentile_rank_boundaries(spark):
    df = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 1.0, 3.0, 1e12)], "x double")
    c = F.lit
    got = [r[0] for r in df.select(PR.percentile_rank(F.col("x"), c(0.0), c(1.0), c(2.0), c(3.0), c(4.0))).collect()]
    assert got[0] <= 10 and got[-1] >= 90 and got[2] == 25.0 and got[3] == 75.0


def test_model_store_roundtrip(spark, tmp_path):
    feats = ["a", "b"]
    df = spark.createDataFrame([(float(i), float(i % 3), i % 2) for i in range(40)], "a double, b double, y int")
    model = M.gbt_pipeline(feats, "y", weight_col=None, maxIter=3, maxDepth=2).fit(df)
    root = str(tmp_path / "models")
    M.save_model(model, {"features": feats, "threshold": 0.6, "metrics": {"auc": 1.0}}, root, "v1")
    try:
        M.save_model(model, {}, root, "v1")
        raise AssertionError("overwrite must be refused")
    except FileExistsError:
        pass
    m2, cfg = M.load_model(root, "v1")
    assert cfg["features"] == feats and cfg["version"] == "v1"
    assert m2.transform(df).count() == 40
    assert [r["version"] for r in M.list_models(root).collect()] == ["v1"]
    assert not M.delete_model(root, "v1")
    assert M.delete_model(root, "v1", confirm=True)
    assert not os.path.exists(os.path.join(root, "v1"))


def test_stream_dedup_keeps_one_row_per_key(spark):
    d = E.queries()["st2_stream_dedup"](spark, SF_SMALL)
    n = d.count()
    k = d.select("user_id", "event_type").distinct().count()
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    assert n == k == ev.select("user_id", "event_type").distinct().count()


def _signals(rows):
    return {r[0]: (r["v7_views_at_poll"], r["e1_views_6h"], r["e2_views_24h"], r["e3_views_48h"]) for r in rows.collect()}


def test_streaming_signals_across_microbatches(spark, tmp_path):
    """Events landed as one file per day, latest day first (every poll of a later file is late): the signals must equal the
    batch aggregate, before and after a compaction, and after a replay of one batch."""
    from surgekit.operators import entity_features as EF
    from surgekit.streaming import streams as S
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    days = sorted((r[0] for r in ev.select(F.to_date("ts")).distinct().collect()), reverse=True)[-6:]
    log = str(tmp_path / "log")
    write = S.early_signal_batch_writer(log, "user_id", "ts")
    for i, d in enumerate(days):
        write(ev.where(F.to_date("ts") == F.lit(d)), i)
    write(ev.where(F.to_date("ts") == F.lit(days[2])), 2)
    some = ev.where(F.to_date("ts").isin(days))
    want = _signals(EF.early_signals(some, "user_id", "ts"))
    assert _signals(S.read_early_signals(spark, log)) == want
    assert S.compact_early_signals(spark, log) == len(days) - 1
    assert _signals(S.read_early_signals(spark, log)) == want


def test_high_water_mark_batches_can_be_replayed(spark, tmp_path):
    """Three batches, one replayed after a later one ran, one with a late record: output and marks are as after a single run."""
    from surgekit.streaming import streams as S
    marks, out = str(tmp_path / "marks"), str(tmp_path / "out")
    rows = [[(1, "2024-01-01"), (1, "2024-01-03"), (2, "2024-01-02")], [(1, "2024-01-02"), (1, "2024-01-04"), (3, "2024-01-01")],
            [(2, "2024-01-05"), (3, "2024-01-02")]]
    batches = [spark.createDataFrame(b, "k long, t string").select("k", F.to_timestamp("t").alias("ts")) for b in rows]
    write = S.hwm_batch_writer(marks, out, "k", "ts")
    for i in (0, 0, 1, 0, 1, 2, 2):
        write(batches[i], i)
    got = sorted((r["batch"], r["k"], str(r["ts"])[:10]) for r in spark.read.parquet(out).collect())
    assert got == [(0, 1, "2024-01-01"), (0, 1, "2024-01-03"), (0, 2, "2024-01-02"), (1, 1, "2024-01-04"), (1, 3, "2024-01-01"),
                   (2, 2, "2024-01-05"), (2, 3, "2024-01-02")]


def test_interrupted_save_is_never_seen(spark, tmp_path, monkeypatch):
    """A writer that stops between its writes leaves the published model as it was."""
    nodes = spark.createDataFrame([(0, 0, None, None, -1, -1, 0.5, 0.0, 1.0)], B.FOREST_SCHEMA)
    root = str(tmp_path / "models")
    M.save_model(nodes, {"threshold": 0.1}, root, "v1")

    def stop(*a):
        raise RuntimeError("crash")
    with monkeypatch.context() as m:
        m.setattr(M, "_publish", stop)
        for version in ("v1", "v2"):
            try:
                M.save_model(nodes, {"threshold": 0.9}, root, version, overwrite=True)
            except RuntimeError:
                pass
    assert [(r["version"], r["threshold"]) for r in M.list_models(root).collect()] == [("v1", 0.1)]
    M.save_model(nodes, {"threshold": 0.2}, root, "v1", overwrite=True)
    forest, cfg = M.load_model(root, "v1")
    assert cfg["threshold"] == 0.2 and forest.count() == 1
    assert [(r["version"], r["threshold"]) for r in M.list_models(root).collect()] == [("v1", 0.2)]


def test_clusters_keep_the_cheapest_start(spark):
    rows = [(float(10 * (i % 4) + (i * 7 % 3) / 10), float(5 * (i % 3))) for i in range(60)]
    d = spark.createDataFrame(rows, "a double, b double").coalesce(1)
    seeds, real = [], M.KMeans

    def counted(**kw):
        seeds.append((kw["k"], kw["seed"]))
        return real(**kw)
    M.KMeans = counted
    try:
        _, k, sil = M.fit_clusters(d, ["a", "b"], k_max=2)
    finally:
        M.KMeans = real
    assert k == 2 and -1 <= sil <= 1 and len(set(seeds)) == M.FINAL_STARTS
