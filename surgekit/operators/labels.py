"""Labelling operators (C04, C05, C07, C08, W02, W04) and the label quality checks.

All are relational: per-group statistics are hash aggregates joined back on the group key (AQE splits a
skewed group on the streamed side), and data-dependent choices (strategy, threshold walk) are made from
one small aggregate row, never from collected table rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles_long
from .tables import attach_scalars

# fixed rule values of the labelling strategies
AUTO_EXISTING_RANGE = (8.0, 20.0)     # auto picks 'existing' when its rate (in %) lies here
ADJUST_RANGE = (5.0, 30.0)            # threshold walk keeps the rate (in %) inside this range
ADJUST_STEP = 0.5
ADJUST_MAX_ITER = 5
STRATEGIES = ("auto", "existing", "ratio", "combined")


def label_inputs(engagement: DataFrame, summary: DataFrame, min_days: int = 7) -> DataFrame:
    """Eligible items with view_ratio and velocity_score (J06 join with defaults)."""
    ch = summary.select(F.col("channel_id").alias("_cid"), F.col("avg_views_per_video").alias("_avg"))
    d = engagement.where(F.col("days_since_published") >= min_days)
    d = d.join(ch, d["channel_id"] == ch["_cid"], "left").drop("_cid")
    avg = F.greatest(F.coalesce(F.col("_avg"), F.lit(1.0)), F.lit(1.0))
    subs = F.greatest(F.coalesce(F.col("channel_subscribers").cast("double"), F.lit(1.0)), F.lit(1.0))
    return (d.withColumn("view_ratio", F.col("view_count") / avg)
             .withColumn("velocity_score", F.coalesce(F.col("avg_views_per_day") / (subs * 0.01), F.lit(0.0)))
             .drop("_avg"))


def threshold_grid(thr0: float) -> list[float]:
    """Every threshold the ±step walk can reach in ADJUST_MAX_ITER steps, in ascending order; the middle one is ``thr0``."""
    return [thr0 if j == 0 else round(thr0 + ADJUST_STEP * j, 1) for j in range(-ADJUST_MAX_ITER, ADJUST_MAX_ITER + 1)]


def _existing() -> F.Column:
    return F.coalesce(F.col("is_potentially_viral"), F.lit(False))


def _combined(ratio: F.Column, vel_thr: float) -> F.Column:
    return ratio | (F.col("velocity_score") >= vel_thr)


def labelling_decision(d: DataFrame, strategy: str = "auto", view_ratio_threshold: float = 3.0,
                       velocity_threshold: float = 1.0) -> DataFrame:
    """C04 auto strategy + C05 threshold walk as a one-row relation (label_strategy, view_ratio_threshold).

    One aggregate gives the positive rate of every threshold of the grid; the walk is a fold over that row, moving one place
    down the grid while the rate is too low and one up while it is too high. Nothing runs while the plan is built. Without
    rows, or where no rate is known, the walk stays and ``auto`` resolves to 'combined'."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy={strategy!r} is invalid; choose from {STRATEGIES}")
    grid = threshold_grid(view_ratio_threshold)
    # the three inputs come out of a one-element explode so the 2*|grid|+1 aggregates reference columns
    # instead of each inlining the full ratio expressions (keeps the aggregate inside whole-stage codegen)
    n = d.select(F.explode(F.array(F.struct(
        F.col("view_ratio").alias("view_ratio"), F.col("velocity_score").alias("velocity_score"),
        _existing().alias("is_potentially_viral")))).alias("_r")).select("_r.*")

    def rate(positive):
        return F.avg(positive.cast("int").cast("double")) * 100

    over = [F.col("view_ratio") >= t for t in grid]
    rates = n.agg(rate(F.col("is_potentially_viral")).alias("_existing"),
                  F.array(*[rate(c) for c in over]).alias("_ratio"),
                  F.array(*[rate(_combined(c, velocity_threshold)) for c in over]).alias("_combined"))
    if strategy == "auto":
        resolved = F.when(F.col("_existing").between(*AUTO_EXISTING_RANGE), F.lit("existing")).otherwise(F.lit("combined"))
    else:
        resolved = F.lit(strategy)
    rates = rates.select(resolved.alias("label_strategy"), "_ratio", "_combined")
    rates = rates.select("label_strategy", F.when(F.col("label_strategy") == "ratio", F.col("_ratio"))
                         .when(F.col("label_strategy") == "combined", F.col("_combined")).alias("_rates"))

    def step(at, _):
        r = F.get(F.col("_rates"), at)
        return at + F.when(r < ADJUST_RANGE[0], -1).when(r > ADJUST_RANGE[1], 1).otherwise(0)

    place = F.aggregate(F.sequence(F.lit(1), F.lit(ADJUST_MAX_ITER)), F.lit(ADJUST_MAX_ITER), step)
    return rates.select("label_strategy", F.get(F.array(*[F.lit(float(t)) for t in grid]), place)
                        .alias("view_ratio_threshold"))


def decided_label(velocity_threshold: float = 1.0) -> F.Column:
    """The 0/1 label of a row that carries the decision's columns."""
    ratio = F.col("view_ratio") >= F.col("view_ratio_threshold")
    return F.when(F.col("label_strategy") == "existing", _existing()).when(F.col("label_strategy") == "ratio", ratio) \
        .otherwise(_combined(ratio, velocity_threshold)).cast("int")


def viral_label(engagement: DataFrame, summary: DataFrame, strategy: str = "auto",
                view_ratio_threshold: float = 3.0, velocity_threshold: float = 1.0,
                min_days_published: int = 7) -> DataFrame:
    """C04 + C05: binary label per eligible item; no eligible item gives no rows."""
    d = label_inputs(engagement, summary, min_days_published)
    d = attach_scalars(d, labelling_decision(d, strategy, view_ratio_threshold, velocity_threshold))
    return d.select("video_id", "channel_id", "view_count", "days_since_published", "view_ratio", "velocity_score",
                    decided_label(velocity_threshold).alias("is_viral"), "label_strategy", "view_ratio_threshold")


# --- label quality (A05–A08, A13) ---------------------------------------------------------

def group_rate_profile(labeled: DataFrame, key: str = "channel_id", label: str = "is_viral") -> DataFrame:
    """Per-group positives, count and rate (%)."""
    return labeled.groupBy(key).agg(F.sum(label).alias("viral_videos"), F.count(F.lit(1)).alias("total_videos")) \
        .withColumn("viral_rate", F.col("viral_videos") / F.col("total_videos") * 100)


def group_rate_summary(profile: DataFrame) -> DataFrame:
    """Number of groups at 0 % and at 100 %."""
    return profile.agg(F.count(F.lit(1)).alias("n_groups"),
                       F.sum((F.col("viral_rate") == 0).cast("int")).alias("zero_rate_groups"),
                       F.sum((F.col("viral_rate") == 100).cast("int")).alias("full_rate_groups"))


def monthly_rate_profile(labeled: DataFrame, items: DataFrame, ts: str = "published_at",
                         label: str = "is_viral", drift_pts: float = 15.0) -> DataFrame:
    """Rate per year-month with a drift flag vs the overall rate (one-row scalar cross-joined)."""
    j = labeled.select("video_id", label).join(items.select("video_id", ts), "video_id", "left")
    overall = labeled.agg((F.avg(label) * 100).alias("_overall"))
    m = j.groupBy(F.date_format(ts, "yyyy-MM").alias("year_month")).agg(
        (F.avg(label) * 100).alias("viral_rate_pct"), F.count(F.lit(1)).alias("n_videos"))
    return (attach_scalars(m, overall)
             .withColumn("drift_flag", F.abs(F.col("viral_rate_pct") - F.col("_overall")) > drift_pts)
             .withColumnRenamed("_overall", "overall_rate_pct"))


def category_rate_profile(labeled: DataFrame, items: DataFrame, cat: str = "video_length_category",
                          label: str = "is_viral", focus: str = "shorts", gap: float = 10.0) -> DataFrame:
    """Rate per category + the focus category's gap to the mean rate of the other categories."""
    j = labeled.select("video_id", label).join(items.select("video_id", cat), "video_id", "left")
    c = j.groupBy(cat).agg((F.avg(label) * 100).alias("viral_rate_pct"), F.count(F.lit(1)).alias("n_videos"))
    # conditional aggregate instead of a filter: a filter on the category would be pushed below the
    # grouping into the item scan and re-evaluate the category's derivation there
    others = c.agg(F.avg(F.when(F.col(cat) != focus, F.col("viral_rate_pct"))).alias("_others"))
    return (attach_scalars(c, others)
             .withColumn("focus_gap", F.when(F.col(cat) == focus, F.abs(F.col("viral_rate_pct") - F.col("_others"))))
             .withColumn("gap_flag", F.coalesce(F.col("focus_gap") > gap, F.lit(False)))
             .drop("_others"))


def leak_correlations(labeled: DataFrame, engagement: DataFrame, label: str = "is_viral",
                      limit: float = 0.7) -> DataFrame:
    """Pearson r of the label vs candidate leak columns, flagged when |r| > limit."""
    from ..functions.exprs import level_code
    j = labeled.select("video_id", label).join(
        engagement.select("video_id", "is_potentially_viral", "engagement_level"), "video_id", "left")
    from ..functions.exprs import safe_corr
    r = j.agg(safe_corr(F.col(label), F.col("is_potentially_viral").cast("int")).alias("is_potentially_viral"),
              safe_corr(F.col(label), level_code("engagement_level")).alias("engagement_level"))
    long = r.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr"))
                                        for c in ("is_potentially_viral", "engagement_level")])).alias("kv")) \
        .select("kv.*")
    return long.withColumn("leak_flag", F.coalesce(F.abs("corr") > limit, F.lit(False)))


def label_stats(labeled: DataFrame) -> DataFrame:
    """Totals, rate, smallest view_ratio among positives, youngest age."""
    return labeled.agg(
        F.count(F.lit(1)).alias("total_videos"),
        F.sum("is_viral").alias("viral_count"),
        F.round(F.sum("is_viral") / F.count(F.lit(1)) * 100, 2).alias("viral_rate"),
        F.max("label_strategy").alias("strategy"),
        F.round(F.coalesce(F.min(F.when(F.col("is_viral") == 1, F.col("view_ratio"))), F.lit(0.0)), 2).alias("threshold"),
        F.min("days_since_published").alias("min_days"))


# --- owner labels (C07, W04) and item z-score labels (C08, W02) ---------------------------

OWNER_RULE = {"efficiency_ratio": 0.75, "loyalty_ratio": 0.50, "avg_views_per_video": 0.75}
MIN_GROUP_SIZE = 5


def owner_ratios(summary: DataFrame) -> DataFrame:
    subs = F.greatest(F.coalesce(F.col("subscriber_count").cast("double"), F.lit(1.0)), F.lit(1.0))
    tv = F.greatest(F.coalesce(F.col("total_views").cast("double"), F.lit(0.0)), F.lit(1.0))
    lk = F.coalesce(F.col("total_likes").cast("double"), F.lit(0.0))
    cm = F.coalesce(F.col("total_comments").cast("double"), F.lit(0.0))
    n = F.greatest(F.coalesce(F.col("total_videos_crawled").cast("double"), F.lit(1.0)), F.lit(1.0))
    return summary.select("*", (tv / subs).alias("efficiency_ratio"), (lk / tv).alias("loyalty_ratio"),
                          (cm / tv).alias("depth_ratio"), (tv / n).alias("owner_avg_views"))


def owner_labels(summary: DataFrame, group_col: str | None = None, min_conditions: int = 2,
                 rule: dict[str, float] | None = None) -> DataFrame:
    """``is_viral_owner`` when at least ``min_conditions`` of the ratios exceed their quantile
    thresholds; thresholds are global, or per ``group_col`` with a global fallback for groups < 5 (W04)."""
    rule = rule or OWNER_RULE
    d = owner_ratios(summary).drop("avg_views_per_video").withColumnRenamed("owner_avg_views", "avg_views_per_video")
    feats = list(rule)
    # all features and probabilities in one range pass: unpivot (feature, value), quantiles per feature
    ps = sorted(set(rule.values()))
    pname = {p: f"_q{i}" for i, p in enumerate(ps)}
    probs = {pname[p]: p for p in ps}

    def pick(prefix):
        return [F.max(F.when(F.col("feature") == f, F.col(pname[rule[f]]))).alias(f"{prefix}{f}") for f in feats]

    glob = quantiles_long(d, feats, probs).agg(*pick("_g_"))   # global aggregate: one row
    d = attach_scalars(d, glob)
    if group_col:
        per = quantiles_long(d, feats, probs, by=[group_col]).groupBy(group_col).agg(*pick("_w_"))
        sizes = d.groupBy(group_col).agg(F.count(F.lit(1)).alias("_gn"))
        d = d.join(sizes, group_col, "left").join(per, group_col, "left")
        thr = {f: F.when(F.col("_gn") >= MIN_GROUP_SIZE, F.col(f"_w_{f}")).otherwise(F.col(f"_g_{f}")) for f in feats}
    else:
        thr = {f: F.col(f"_g_{f}") for f in feats}
    met = sum(F.coalesce((F.col(f) > thr[f]).cast("int"), F.lit(0)) for f in feats)
    out = d.select(*[c for c in d.columns if not c.startswith("_")],
                   *[thr[f].alias(f"{f}_threshold") for f in feats],
                   met.alias("conditions_met"), (met >= min_conditions).cast("int").alias("is_viral_owner"))
    return out


def zscore_labels(engagement: DataFrame, as_of: str, key: str = "channel_id", value: str = "view_count",
                  threshold: float = 1.5, fast: float = 3.0, slow: float = 1.5) -> DataFrame:
    """Group z-score label and time-window label.

    Group mean / sample std come from a hash aggregate joined back on the key (std NULL -> 1, floor 1;
    items without a group use the global mean)."""
    stats = engagement.groupBy(key).agg(F.avg(value).alias("_avg"), F.stddev_samp(value).alias("_std"))
    glob = engagement.agg(F.avg(value).alias("_gavg"))
    d = attach_scalars(engagement.join(stats, key, "left"), glob)
    avg = F.when(F.col(key).isNull(), F.col("_gavg")).otherwise(F.coalesce(F.col("_avg"), F.col("_gavg")))
    std = F.greatest(F.coalesce(F.when(F.col(key).isNotNull(), F.col("_std")), F.lit(1.0)), F.lit(1.0))
    d = d.withColumn("channel_avg_views", avg).withColumn("channel_std_views", std)
    score = F.coalesce((F.col(value) - F.col("channel_avg_views")) / F.col("channel_std_views"), F.lit(0.0))
    age = F.greatest((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp")))
                     / F.lit(86400e6), F.lit(0.1))
    vpd = F.col(value) / age
    daily = F.col("channel_avg_views") / 30
    is_fast = F.coalesce(vpd > daily * fast, F.lit(False))
    is_slow = F.coalesce(vpd > daily * slow, F.lit(False)) & ~is_fast
    return d.select(
        *[c for c in engagement.columns], "channel_avg_views", "channel_std_views",
        score.alias("relative_score"), (score > threshold).cast("int").alias("is_viral"),
        age.alias("video_age_days"), vpd.alias("views_per_day"), daily.alias("channel_daily_avg"),
        F.when(is_fast, F.lit("viral_within_7d")).when(is_slow, F.lit("viral_within_30d"))
         .otherwise(F.lit("not_viral")).alias("time_window_label"))


def top_bottom_groups(profile: DataFrame, key: str = "channel_id", n: int = 5) -> DataFrame:
    """Top and bottom n groups by rate (key as tie-break)."""
    top = profile.orderBy(F.desc("viral_rate"), F.asc(key)).limit(n).withColumn("side", F.lit("top"))
    bot = profile.orderBy(F.asc("viral_rate"), F.asc(key)).limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(bot)


# fixed values: shares of positive rows outside of which a label counts as unbalanced
BALANCED_FROM, BALANCED_TO = 20.0, 80.0


def label_distribution(df: DataFrame, label: str, negative="not_viral") -> DataFrame:
    """Count and share per label value, and the balance warning (< 20 % or > 80 % of rows with another value than
    ``negative``)."""
    total = df.agg(F.count(F.lit(1)).alias("_t"), F.sum((F.col(label) != negative).cast("int")).alias("_p"))
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    positive = F.col("_p") / F.col("_t") * 100
    return (attach_scalars(c, total).withColumn("pct", F.col("n") / F.col("_t") * 100)
            .withColumn("balance_warning", ~positive.between(BALANCED_FROM, BALANCED_TO)).drop("_t", "_p"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n_neg / n_pos (positive weight) and balanced weights n / (k * n_c)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = (c.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"),
                            F.sum(F.when(F.col(label) == 0, F.col("n"))).alias("_neg"),
                            F.sum(F.when(F.col(label) == 1, F.col("n"))).alias("_pos")))
    return attach_scalars(c, tot).select(
        label, "n", (F.col("_t") / (F.col("_k") * F.col("n"))).alias("balanced_weight"),
        F.try_divide(F.col("_neg").cast("double"), F.col("_pos").cast("double")).alias("scale_pos_weight"))



def label_quality_report(labeled: DataFrame, items: DataFrame, engagement: DataFrame) -> DataFrame:
    """The label checks as rows (check, status PASS / WARN, value): overall rate in [5, 30] %,
    owners at 100 % and at 0 %, months drifting > 15 points, leakage |r| > 0.7."""
    overall = labeled.agg((F.avg("is_viral") * 100).alias("v"))
    prof = group_rate_summary(group_rate_profile(labeled))
    monthly = monthly_rate_profile(labeled, items).agg(F.sum(F.col("drift_flag").cast("int")).alias("v"))
    leak = leak_correlations(labeled, engagement).agg(F.sum(F.col("leak_flag").cast("int")).alias("v"))
    rows = [
        overall.select(F.lit("overall_rate").alias("check_name"), F.col("v").cast("double").alias("value"),
                       F.when(F.col("v").between(5.0, 30.0), F.lit("PASS")).otherwise(F.lit("WARN")).alias("status")),
        prof.select(F.lit("owners_at_100pct").alias("check_name"), F.col("full_rate_groups").cast("double").alias("value"),
                    F.when(F.col("full_rate_groups") == 0, F.lit("PASS")).otherwise(F.lit("WARN")).alias("status")),
        prof.select(F.lit("owners_at_0pct").alias("check_name"), F.col("zero_rate_groups").cast("double").alias("value"),
                    F.when(F.col("zero_rate_groups") == 0, F.lit("PASS")).otherwise(F.lit("WARN")).alias("status")),
        monthly.select(F.lit("seasonal_drift_months").alias("check_name"), F.col("v").cast("double").alias("value"),
                       F.when(F.coalesce(F.col("v"), F.lit(0)) == 0, F.lit("PASS")).otherwise(F.lit("WARN")).alias("status")),
        leak.select(F.lit("leakage_columns").alias("check_name"), F.col("v").cast("double").alias("value"),
                    F.when(F.coalesce(F.col("v"), F.lit(0)) == 0, F.lit("PASS")).otherwise(F.lit("WARN")).alias("status")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
