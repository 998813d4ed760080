"""I/O contracts and writers, scoring arithmetic, control-table updates, entity matching and the
training orchestration on small inputs."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from surgekit.operators import control as C
from surgekit.operators import ml as M
from surgekit.operators import scoring as SC
from surgekit.operators import tables as TB
from surgekit.sources import envelopes as EV
from surgekit.sources import io as IO


def test_conform_seed_tolerant_csv_and_layers(spark, tmp_path):
    seed = tmp_path / "cats.csv"
    seed.write_text("category_id,category_name,description\n1,Film,movies\n10,Music,songs\n")
    s = IO.read_seed(spark, str(seed)).collect()
    assert [r["category_id"] for r in s] == ["1", "10"]
    part = tmp_path / "reg.csv"
    part.write_text("channel_id,channel_name\nA,x\nB,\n")
    contract = T.StructType([T.StructField("channel_id", T.StringType()), T.StructField("channel_name", T.StringType()),
                             T.StructField("priority", T.IntegerType()), T.StructField("is_active", T.BooleanType())])
    d = IO.read_tolerant_csv(spark, str(part), contract, {"priority": 1, "is_active": True, "channel_name": ""}).collect()
    assert [tuple(r) for r in d] == [("A", "x", 1, True), ("B", "", 1, True)]
    with pytest.raises(ValueError):
        IO.layer_path(str(tmp_path), "gold")
    df = spark.createDataFrame([(1, "2001-01-05"), (2, "2001-02-07")], "k long, d string").withColumn("d", F.col("d").cast("date"))
    out = IO.materialize_layer(df, str(tmp_path), "mart", "fact", partition_col="d", cluster_by=["k"])
    assert out.count() == 2 and os.path.isdir(tmp_path / "mart" / "fact")
    IO.store_failures(df.where("k = 2"), str(tmp_path), "unique_k")
    assert spark.read.parquet(str(tmp_path / "dq_failures" / "unique_k")).count() == 1
    res = spark.createDataFrame([("a", "FOUND", 1), ("b", "NOT_FOUND", 2)], "q string, status string, x long")
    IO.write_search_results(res, str(tmp_path / "search"), ["q", "status"])
    assert spark.read.option("header", True).csv(str(tmp_path / "search" / "found")).count() == 1


def test_envelopes_roundtrip_and_passthrough(spark, tmp_path):
    rv = EV.raw_videos(spark, SF_SMALL)
    EV.write_envelopes(rv, str(tmp_path / "raw_videos"))
    back = spark.read.parquet(str(tmp_path / "raw_videos"))
    assert back.count() == rv.count() and "ingest_date" in back.columns
    rv.select("id", "raw", "ingestion_time").write.json(str(tmp_path / "nd"))
    nd = EV.read_ndjson(spark, str(tmp_path / "nd"))
    assert nd.count() == rv.count()
    st = EV.stg_channels(EV.raw_channels(spark, SF_SMALL), passthrough_cols=[{"name": "raw", "alias": "raw_json"}])
    assert "raw_json" in st.columns
    bad = spark.createDataFrame([('{"a": {"b": 1}, "n": "x"}',)], "raw string")
    r = EV.extract_json(bad, "raw", {"obj": ("$.a", "value"), "sub": ("$.a", "query"), "n": ("$.n", "bigint")},
                        strict=False).first()
    assert r["obj"] is None and r["sub"] == '{"b":1}' and r["n"] is None


def test_scoring_arithmetic(spark):
    rows = [(1000, 200000.0, 0.3, "viral_within_7d", 6_000_000, 4.0, 3.0, 100.0),
            (10, 50.0, 0.9, "not_viral", 10, 0.2, 0.1, 1000.0)]
    df = spark.createDataFrame(rows, "view_count long, views_per_hour double, probability double, time_window string, "
                                     "abs long, vr double, gr double, owner_avg_views double")
    proj = SC.project_views()
    got = df.select(*[c.alias(n) for n, c in proj.items()],
                    SC.momentum(velocity_ratio="vr", growth="gr").alias("m"),
                    SC.absolute_boost(views="abs").alias("b"),
                    SC.prior_blend("probability", F.lit(None).cast("double")).alias("pb"),
                    SC.probability_label().alias("lab")).collect()
    v7 = int(1000 + 200000.0 * 24 * 7 * 1.3 * 0.7)
    assert got[0]["views_7d"] == v7
    assert got[0]["views_30d"] == int(v7 + 200000.0 * 24 * 23 * 1.3 * (0.7 * 0.3))
    assert got[0]["m"] == max(0, min(100, 50 + int((0.3 - 0.5) * 60) + 20 + 15))
    assert got[1]["m"] == 50 + int(0.4 * 60) - 15
    assert got[0]["b"] == 0.82 and got[1]["b"] == 0.9
    assert abs(got[1]["pb"] - (0.7 * 0.9 + 0.3 * 0.5)) < 1e-12
    assert [g["lab"] for g in got] == ["VERY LOW", "EXTREMELY HIGH"]
    lbl = spark.createDataFrame([(False, 0.5, "x"), (False, 0.1, "x"), (True, 0.7, "viral_within_7d"),
                                 (True, 0.7, "viral"), (True, 0.7, "other")], "w boolean, p double, t string")
    assert [r[0] for r in lbl.select(SC.prediction_label(F.col("w"), F.col("p"), F.col("t"))).collect()] == [
        "LOW VIRAL POTENTIAL", "NOT VIRAL", "VIRAL WITHIN 7 DAYS", "VIRAL WITHIN 30 DAYS", "VIRAL POTENTIAL"]
    w = spark.createDataFrame([(0, None, None, 0), (5, 3, 2, 10)], "days int, subs long, likes long, views long")
    assert [r[0] for r in w.select(SC.warnings(days="days", subs="subs", likes="likes", views="views")).collect()] == [
        ["new_item_under_24h", "hidden_subscribers", "hidden_likes", "no_views"], []]


def test_control_updates(spark):
    ctl = spark.createDataFrame(
        [(1, "a", 24, "pending", None, None, True, 1, "2001-01-01 00:00:00"),
         (2, "b", 12, "success", "2001-07-20 00:00:00", "2001-07-20 12:00:00", True, 3, "2001-01-01 00:00:00")],
        "channel_id long, channel_name string, crawl_frequency_hours int, crawl_status string, last_crawl_ts string, "
        "next_crawl_ts string, is_active boolean, priority int, updated_at string")
    ctl = ctl.select(*[F.col(c).cast("timestamp").alias(c) if c.endswith("_ts") or c == "updated_at" else F.col(c)
                       for c in ctl.columns])
    res = spark.createDataFrame([(1, "success"), (2, "failed")], "channel_id long, status string")
    out = {r["channel_id"]: r for r in C.apply_run_results(ctl, res, "2001-08-02").collect()}
    assert out[1]["crawl_status"] == "success" and str(out[1]["next_crawl_ts"]) == "2001-08-03 00:00:00"
    assert out[2]["crawl_status"] == "failed" and str(out[2]["next_crawl_ts"]) == "2001-08-02 01:00:00"
    assert str(out[2]["last_crawl_ts"]) == "2001-07-20 00:00:00"
    mode = {r["channel_id"]: r["crawl_mode"] for r in C.crawl_mode(ctl, "2001-08-02").collect()}
    assert mode == {1: "full", 2: "full"}
    assert [r["channel_id"] for r in C.due_queue(ctl, "2001-08-02").collect()] == [2]


def test_entity_match_semantics(spark):
    q = spark.createDataFrame([(1, "Foo"), (2, "bar"), (3, "zzz"), (4, "none")], "qid long, q string")
    c = spark.createDataFrame([(1, 10, "Foo Fans", 1), (1, 11, "foo", 2), (2, 20, "x", 1), (2, 21, "BARN", 2),
                               (3, 30, "first", 1), (3, 31, "second", 2)], "qid long, cid long, name string, rk int")
    r = {x["qid"]: (x["matched_id"], x["match_kind"], x["status"])
         for x in TB.entity_match(q, c, "qid", "q", "cid", "name", "rk").collect()}
    assert r == {1: (10, "matched", "FOUND"), 2: (21, "matched", "FOUND"), 3: (30, "first_result", "FOUND"),
                 4: (None, None, "NOT_FOUND")}


def test_classifier_choice_and_probabilities(spark):
    rows = [(float(i % 7), float(i % 5), int((i % 7) > 3), i) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, y int, k long")
    best, scores = M.choose_classifier(df, ["a", "b"], "y", "k", k=2)
    assert best in scores and set(scores) == {"random_forest", "logistic_regression", "linear_svm", "majority"}
    for algo in ("linear_svm", "logistic_regression"):
        p = M.classifier_probability(M.fit_classifier(df, ["a", "b"], "y", algo).transform(df))
        lo, hi = p.agg(F.min("p"), F.max("p")).first()
        assert 0.0 <= lo <= hi <= 1.0


def test_train_viral_model_end_to_end(spark, tmp_path):
    from surgekit.plans.training import train_viral_model
    cfg = train_viral_model(spark, SF_SMALL, str(tmp_path / "m"), "v1", n_trials=1)
    assert 0.0 <= cfg["threshold"] <= 1.0 and len(cfg["features"]) == 43
    assert set(cfg["metrics"]) >= {"roc_auc", "pr_auc", "f1", "precision", "recall"}
    model, loaded = M.load_model(str(tmp_path / "m"), "v1")
    assert loaded["threshold"] == cfg["threshold"]


def test_lookup_first_and_display_cleanup(spark):
    base_df = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    lk = spark.createDataFrame([(1, 30, 2), (1, 10, 1), (2, 5, 7)], "k long, dur long, t long")
    got = {r["k"]: r["dur"] for r in TB.lookup_first(base_df, lk, "k", ["dur"], ["t"]).collect()}
    assert got == {1: 10, 2: 5, 3: None}
    raw = spark.createDataFrame([("a", "10"), ("", "5"), (None, "7"), ("b", "x"), ("c", "3")], "id string, subs string")
    out = [(r["id"], r["subs"]) for r in IO.clean_for_display(raw, "id", ["subs"], "subs").collect()]
    assert out == [("a", 10), ("c", 3), ("b", 0)]


def test_every_customer_is_a_candidate(spark):
    names = ["Ann Lee", "Bo", None, "annex", "LEE"]
    ents = spark.createDataFrame(list(enumerate(names)), "cid long, name string")
    q = spark.createDataFrame([(1, "LEE"), (2, "an"), (3, "zz"), (4, None), (5, "ann lee, of a name too long"), (6, "")], "qid long, q string")
    got = {r["qid"]: r["cid"] for r in TB.first_containing(q, ents, "qid", "q", "cid", "name").collect()}
    assert got == {1: 0, 2: 0, 6: 0}
    assert TB.first_containing(q.where("qid = 4"), ents, "qid", "q", "cid", "name").count() == 0


def test_match_outside_the_key_window(spark, tmp_path):
    from surgekit.plans.catalog_misc import q_j12
    spark.createDataFrame([(3,), (4,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(15, "Customer#000000015"), (999, "Customer#000000017"), (20, "Customer#000000020")],
                          "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r["query_id"]: (r["matched_id"], r["match_kind"]) for r in q_j12(spark, str(tmp_path)).collect()}
    assert got == {3: (999, "matched"), 4: (20, "first_result")}
