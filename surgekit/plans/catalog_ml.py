"""Catalog entries for the ML operators. Model outputs have no SQL oracle (rows-only check), except the
chronological split (W03), which is plain SQL."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import features as FE
from ..operators import labels as L
from ..operators import ml as M
from ..operators import ordering as O
from ..operators.tables import attach_scalars
from ..session import materialize
from . import marts
from .catalog import owner_features, owner_labels, register, stored_items
from .catalog_features import FM_WITH, matrix
from .oracle import with_ctes
from .relations import planned, shared


def _split(spark, sf):
    return O.time_split(matrix(spark, sf), "published_at", "video_id")


@register("w03_time_split", FM_WITH + """
SELECT * EXCLUDE (pos, n), CASE WHEN pos < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
  WHEN pos < floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY published_at NULLS FIRST, video_id) - 1 AS pos, count(*) OVER () AS n FROM fm)""",
          ["duration_minutes", "subscriber_log", "channel_age_days", "upload_freq_per_day", "channel_avg_views_log",
           "channel_avg_like_rate", "channel_avg_cmt_rate", "duration_vs_channel", "total_videos_crawled",
           "avg_views_per_day_log", "like_rate_pct", "comment_rate_pct", "engagement_score", "view_vs_channel_avg",
           "like_rate_vs_channel", "comment_rate_vs_channel", "velocity_score"])
def q_w03(spark, sf):
    """W03 chronological 70/15/15 split by global rank (range-partitioned, no single-task window)."""
    return split_matrix(spark, sf)


KEY, LABEL = "video_id", "is_viral"


def split_matrix(spark, sf):
    """The written feature matrix with its chronological split, written as two pairs of (time, key) that rows are compared with."""
    return planned(spark, sf, "split-matrix", lambda: _split(spark, sf))


def feature_names(exclude_label_inputs: bool = False) -> list[str]:
    return [c for c in FE.FEATURE_COLS if not (exclude_label_inputs and c in FE.LABEL_INPUT_FEATURES)]


def _train_test(spark, sf, exclude_label_inputs: bool = False):
    s = split_matrix(spark, sf)
    train = M.with_class_weight(s.where(F.col("split") != "test"), LABEL)
    return feature_names(exclude_label_inputs), train, s.where(F.col("split") == "test")


def search_results(spark, sf, exclude_label_inputs: bool = False):
    """(map, auc, best_round, rounds_run) of all maps, searched once an application."""
    s = split_matrix(spark, sf)
    return shared(spark, sf, f"map-search-{exclude_label_inputs}", lambda: B.search(
        s.where(F.col("split") == "train"), s.where(F.col("split") == "val"), feature_names(exclude_label_inputs), LABEL, KEY))


def searched_forest(spark, sf, exclude_label_inputs: bool = False, splits: tuple[str, ...] = ("train", "val")):
    """The forest of the chosen map on the named splits, fitted once an application."""
    def build():
        best, _ = B.best_map(search_results(spark, sf, exclude_label_inputs))
        return B.fit_forest(split_matrix(spark, sf).where(F.col("split").isin(*splits)), feature_names(exclude_label_inputs), LABEL, KEY, best)
    return shared(spark, sf, f"forest-{'-'.join(splits)}-{exclude_label_inputs}", build)


def scored(spark, sf, split: str, exclude_label_inputs: bool = False, splits: tuple[str, ...] = ("train", "val")):
    rows = split_matrix(spark, sf).where(F.col("split") == split)
    return B.score(rows, searched_forest(spark, sf, exclude_label_inputs, splits), feature_names(exclude_label_inputs), [KEY, LABEL])


@register("m01_gbt_test_scores")
def q_m01(spark, sf):
    """M01 + M05: class-weighted boosting on train+val with the searched map, scores of the held-out latest 15 %."""
    return scored(spark, sf, "test").withColumn("prediction", (F.col("p_viral") >= 0.5).cast("double"))


@register("m02_map_search")
def q_m02(spark, sf):
    """The 50 maps with their validation AUC, best round and rounds until early stopping."""
    maps = spark.createDataFrame([(i, p.rounds, p.depth, p.rate, p.subsample, p.colsample, float(p.least_child), p.gamma, p.alpha, p.reg_lambda)
                                  for i, p in enumerate(B.random_maps())],
                                 "map long, rounds int, depth int, rate double, subsample double, colsample double, least_child double, "
                                 "gamma double, alpha double, reg_lambda double")
    return search_results(spark, sf).join(maps, "map")


@register("m03_evaluation_report")
def q_m03(spark, sf):
    """Test metrics at 0.5 and the F1-optimal threshold (chosen on validation), with and without the label-input
    features."""
    out = None
    for excl in (False, True):
        thr = M.f1_optimal_threshold(scored(spark, sf, "val", excl, ("train",)), LABEL)
        r = attach_scalars(M.binary_metrics(materialize(scored(spark, sf, "test", excl)), LABEL, threshold=0.5), thr).withColumn(
            "exclude_label_inputs", F.lit(excl))
        out = r if out is None else out.unionByName(r)
    return out


@register("t08_feature_importances")
def q_t08(spark, sf):
    """T08 / M10 top-20 feature importances: average gain of the searched forest's splits."""
    return B.importances(searched_forest(spark, sf), feature_names(), 20)


@register("m06_occlusion_drivers")
def q_m06_occlusion(spark, sf):
    """M06 / T07 for the searched forest: how much the probability falls where a feature is replaced by its training median; top-5
    drivers and the most negative one of every test row."""
    feats = feature_names()
    train = split_matrix(spark, sf).where(F.col("split") != "test")
    medians = {r["feature"]: r["median"] for r in FE.fit_medians(train, feats, reread=True).collect()}  # a row a feature
    test = split_matrix(spark, sf).where(F.col("split") == "test")
    return B.occlusion(test, searched_forest(spark, sf), feats, [medians[c] for c in feats], KEY)


@register("m04_training_run")
def q_m04(spark, sf):
    """The whole training run, its model and configuration saved to the shared folder; the metrics row of the run."""
    import os
    import uuid

    from ..session import checkpoint_dir
    from .training import train_viral_model
    root = os.path.join(checkpoint_dir(spark), "models", f"items-{uuid.uuid4().hex[:10]}")
    c = train_viral_model(spark, sf, root, "v1")
    m = c["metrics"]
    return spark.createDataFrame(
        [(c["label_strategy"], len(c["features"]), c["params"]["rounds"], c["params"]["depth"], c["validation_auc"], c["threshold"],
          *(float(m[k]) for k in ("roc_auc", "pr_auc", "precision", "recall", "f1", "weighted_f1")))],
        "label_strategy string, n_features int, rounds int, depth int, validation_auc double, threshold double, roc_auc double, "
        "pr_auc double, precision double, recall double, f1 double, weighted_f1 double")


@register("m06_linear_drivers")
def q_m06(spark, sf):
    """M06 / T07 exact linear contributions, top-5 drivers and the most negative driver per row."""
    feats, train, test = _train_test(spark, sf)
    va = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")
    model = Pipeline(stages=[va, LogisticRegression(labelCol="is_viral", weightCol="weight", maxIter=50)]).fit(train)
    means = train.agg(*[F.avg(c).alias(c) for c in feats]).first().asDict()
    return M.linear_contributions(test, model, feats, means, "video_id")


def _owner_frame(spark, sf):
    return owner_features(spark, sf).join(owner_labels(spark, sf), "channel_id", "left")


_CLUSTER_FEATS = ["f9_sub_tier", "f6_avg_views", "f2_loyalty", "f3_depth"]


@register("m07_owner_clusters")
def q_m07(spark, sf):
    """M07 + M08: standardised k-means (k by best silhouette in 2..7), cluster id and distance per owner."""
    o = _owner_frame(spark, sf).withColumn("f6_avg_views", F.log1p("f6_avg_views"))
    model, k, sil = M.fit_clusters(o, _CLUSTER_FEATS)
    return M.assign_clusters(model, o).withColumn("k", F.lit(k)).withColumn("silhouette", F.lit(sil))


@register("m11_item_classifier")
def q_m11(spark, sf):
    """The item model chosen by class balance and size, its out-of-fold F1 over stratified folds against the majority
    baseline."""
    from .training import item_frame, item_training
    d, feats = item_frame(spark, sf)
    kind, k, n, positives, oof = item_training(spark, sf)
    m = M.binary_metrics(oof, LABEL, "p").select("precision", "recall", F.col("f1").alias("cv_f1"), "roc_auc")
    base_f1 = M.majority_f1(n, positives)
    return m.select(F.lit(kind).alias("kind"), F.lit(k).alias("folds"), F.lit(n).alias("n_rows"), F.lit(positives / n).alias("viral_rate"),
                    F.lit(len(feats)).alias("n_features"), "*", F.lit(base_f1).alias("baseline_f1"), (F.col("cv_f1") > base_f1).alias("beat_baseline"))


@register("m12_window_classifier")
def q_m12(spark, sf):
    """The time-window model's out-of-fold confusion as precision, recall and F1 a class, and their weighted F1."""
    from .training import window_out_of_fold
    return M.class_metrics(M.confusion(window_out_of_fold(spark, sf), "time_window_label", "window_pred"))


_Z_SQL = """
SELECT * EXCLUDE (tp, called), tp / support AS recall, coalesce(tp / nullif(called, 0), 0.0) AS precision, 2.0 * tp / (support + called) AS f1,
  sum(2.0 * tp / (support + called) * support) OVER () / sum(support) OVER () AS weighted_f1
FROM (SELECT l.label, CAST(sum(n) AS BIGINT) AS support, sum(CASE WHEN label = predicted THEN n ELSE 0 END) * 1.0 AS tp,
        coalesce((SELECT sum(n) FROM pairs q WHERE q.predicted = l.label), 0) AS called FROM pairs l GROUP BY l.label)"""


@register("m12_metrics_given_predictions", with_ctes("items", extra="""
g AS (SELECT CASE CAST(view_count % 5 AS INTEGER) WHEN 0 THEN 'viral_within_7d' WHEN 1 THEN 'viral_within_30d' ELSE 'not_viral' END AS label,
             CASE CAST(view_count % 7 AS INTEGER) WHEN 0 THEN 'viral_within_7d' WHEN 1 THEN 'viral_within_30d' ELSE 'not_viral' END AS predicted
      FROM items),
pairs AS (SELECT label, predicted, count(*) AS n FROM g GROUP BY label, predicted)""") + _Z_SQL, ["recall", "precision", "f1", "weighted_f1"])
def q_m12_given(spark, sf):
    """M12 confusion, per-class and weighted F1 over given predictions (taken from the items' view counts)."""
    from ..sources import fixtures as fx
    v = F.col("view_count")

    def window(m: int):
        return F.when(v % m == 0, "viral_within_7d").when(v % m == 1, "viral_within_30d").otherwise("not_viral")
    d = fx.items(spark, sf).select(window(5).alias("label"), window(7).alias("predicted"))
    return M.class_metrics(M.confusion(d, "label", "predicted"))


@register("m13_two_stage_prediction")
def q_m13(spark, sf):
    """The searched forest, balanced multinomial LR on the z-score time-window label, time window only where
    P(viral) > 0.6."""
    z = L.zscore_labels(marts.engagement(stored_items(spark, sf)), "2001-08-02").select("video_id", "time_window_label")
    feats, train, test = _train_test(spark, sf)
    tr2 = shared(spark, sf, "window-training", lambda: train.join(z, "video_id"))  # read by every pass of the fit
    tr2 = M.with_balanced_weight(tr2, "time_window_label", "w2")
    idx = StringIndexer(inputCol="time_window_label", outputCol="_y", stringOrderType="alphabetAsc")
    va = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")
    b2 = Pipeline(stages=[idx, va, LogisticRegression(labelCol="_y", weightCol="w2", family="multinomial",
                                                       maxIter=50)]).fit(tr2)
    labels = b2.stages[0].labels
    s1 = scored(spark, sf, "test").select("video_id", "p_viral")
    s2 = b2.stages[-1].transform(b2.stages[1].transform(test)).select(
        "video_id", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
        .alias("window_pred"))
    return M.two_stage_predict(s1.join(s2, "video_id"))


@register("m18_item_report")
def q_m18_items(spark, sf):
    """M17 + M18 for items: probability and window of the trained item models, boost, pace, projection, confidence, explanation
    factors and warnings as one JSON report an item."""
    from .training import item_report
    return item_report(spark, sf)


@register("m18_owner_report")
def q_m18(spark, sf):
    """M17 + M18: owner system training (clusters, within-cluster labels, classifier choice, stats, saved
    components) and the per-owner report JSON with prior-blended probability and tier."""
    import os
    import uuid

    from ..session import checkpoint_dir
    from .training import owner_report, train_owner_system
    root = os.path.join(checkpoint_dir(spark), "models", f"owner-{uuid.uuid4().hex[:10]}")
    info = train_owner_system(spark, sf, root, "v1")
    return owner_report(spark, sf, f"{root}/v1", info["cluster_stats"])
