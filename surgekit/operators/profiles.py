"""Distribution profiles and group statistics.

Quantiles are exact and distributed (``quantiles.exact_quantiles``); everything else is one aggregate
pass with partial aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, quantiles_long
from .tables import attach_scalars

PROFILE_PROBS = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}
RATIO_THRESHOLDS = (2.0, 3.0, 5.0)
TARGET_RATE = 14.0   # fixed: the strategy recommendation aims at a 14 % positive rate
HIST_BINS = 60
MIN_STATS_GROUP = 3  # fixed: per-group percentiles only for groups of at least 3 rows
# fixed tier names, assigned by descending median subscriber tier; the last repeats beyond its rank
TIER_NAMES = ("Mega Channels (100M+ sub)", "Large Channels (1M–100M sub)", "Growing Channels (100K–1M sub)",
              "Niche Channels (<100K sub)", "Micro Channels")


def percentile_profile(df: DataFrame, col: str, probs: Mapping[str, float] = PROFILE_PROBS) -> DataFrame:
    """Exact percentiles plus min / max / mean / sample std of one column (one row)."""
    q = exact_quantiles(df, col, probs)
    s = df.agg(F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"),
               F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"))
    return attach_scalars(q, s)


def share_above(d: DataFrame, ratio_col: str = "view_ratio", velocity_col: str = "velocity_score",
                thresholds: Sequence[float] = RATIO_THRESHOLDS) -> DataFrame:
    """A10: share (%) of rows with ratio >= each threshold and with velocity >= 1 (velocity NULLs skipped)."""
    aggs = [(F.avg((F.col(ratio_col) >= t).cast("double")) * 100).alias(f"pct_ratio_ge_{int(t)}x")
            for t in thresholds]
    v = F.col(velocity_col)
    aggs.append((F.avg(F.when(v.isNotNull() & ~F.isnan(v), (v >= 1.0).cast("double"))) * 100).alias("pct_velocity_ge_1"))
    return d.agg(*aggs)


def strategy_recommendation(d: DataFrame, ratio_thr: float = 3.0, vel_thr: float = 1.0) -> DataFrame:
    """Rates of the three label strategies and the one nearest to the target rate
    (ties resolved in the order existing, ratio, combined)."""
    rates = d.agg(
        (F.avg(F.coalesce(F.col("is_potentially_viral"), F.lit(False)).cast("double")) * 100).alias("rate_existing"),
        (F.avg((F.col("view_ratio") >= ratio_thr).cast("double")) * 100).alias("rate_ratio"),
        (F.avg(((F.col("view_ratio") >= ratio_thr) | F.coalesce(F.col("velocity_score") >= vel_thr, F.lit(False)))
               .cast("double")) * 100).alias("rate_combined"))
    da, db, dc = [F.abs(F.col(c) - TARGET_RATE) for c in ("rate_existing", "rate_ratio", "rate_combined")]
    best = (F.when((da <= db) & (da <= dc), F.lit("existing")).when(db <= dc, F.lit("ratio"))
            .otherwise(F.lit("combined")))
    return rates.withColumn("recommended", best)


def log_histogram(df: DataFrame, col: str, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width histogram of log1p(col) over [min, max] (last bin closed), non-empty bins only."""
    x = F.log1p(F.col(col).cast("double"))
    d = df.select(x.alias("_x")).where(F.col("_x").isNotNull())
    r = d.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    j = attach_scalars(d, r)
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)))
    return (j.groupBy(b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
        .select("bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_start"),
                (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_end"), "n")
        .withColumnRenamed("n", "n_rows"))


def load_summary(tables: Mapping[str, DataFrame], key: str = "channel_id", flag_table: str = "engagement",
                 flag: str = "is_potentially_viral") -> DataFrame:
    """Row counts per relation, distinct owners, share of flagged rows."""
    out = None
    for name, df in tables.items():
        r = df.agg(F.count(F.lit(1)).alias("n_rows"))
        r = r.select(*[F.col("n_rows").alias(f"{name}_rows")])
        out = r if out is None else attach_scalars(out, r)
    e = tables[flag_table].agg(F.count_distinct(key).alias("distinct_owners"),
                               (F.avg(F.col(flag).cast("double")) * 100).alias("flag_rate_pct"))
    return attach_scalars(out, e)


def group_stats(df: DataFrame, group: str, features: Sequence[str], label: str | None = None,
                min_n: int = MIN_STATS_GROUP, reread: bool = False) -> DataFrame:
    """Per group count, positive rate, and min / p25 / median / p75 / max per feature; percentiles
    only for groups with at least ``min_n`` rows (medians always). ``reread``: the frame is a written table, cheap to read twice."""
    base = df.groupBy(group).agg(F.count(F.lit(1)).alias("count"),
                                 *([F.avg(F.col(label).cast("double")).alias("viral_rate")] if label else []),
                                 *[F.min(f).cast("double").alias(f"min_{f}") for f in features],
                                 *[F.max(f).cast("double").alias(f"max_{f}") for f in features])
    q = quantiles_long(df, features, {"p25": 0.25, "p50": 0.50, "p75": 0.75}, by=[group], reread=reread)
    wide = q.groupBy(group).agg(*[F.max(F.when(F.col("feature") == f, F.col(p))).alias(f"{p}_{f}")
                                 for f in features for p in ("p25", "p50", "p75")])
    j = base.join(wide, group, "left")
    small = F.col("count") < min_n
    cols = [group, "count"] + (["viral_rate"] if label else [])
    for f in features:
        cols.append(F.col(f"p50_{f}").alias(f"median_{f}"))
        for p in ("min", "p25", "p50", "p75", "max"):
            cols.append(F.when(small, F.lit(None).cast("double")).otherwise(F.col(f"{p}_{f}")).alias(f"{p}_{f}"))
    return j.select(*cols)


def rank_tiers(stats: DataFrame, group: str, median_col: str, names: Sequence[str] = TIER_NAMES) -> DataFrame:
    """Rank groups by median desc (group key as tie-break) and name them, capped at the last name.
    The window runs over the per-group stats table (one row per group)."""
    w = Window.orderBy(F.desc_nulls_last(median_col), F.asc(group))
    rank = F.row_number().over(w) - 1
    arr = F.array(*[F.lit(n) for n in names])
    return stats.select("*", rank.alias("tier_rank"),
                        F.element_at(arr, (F.least(rank, F.lit(len(names) - 1)) + 1).cast("int")).alias("tier_name"))


def percentile_rank(value: Column, lo: Column, p25: Column, p50: Column, p75: Column, hi: Column) -> Column:
    """Piecewise-linear rank 0..100 from (min, p25, p50, p75, max); 50 when stats are missing."""
    pts = [(lo, 0.0), (p25, 25.0), (p50, 50.0), (p75, 75.0), (hi, 100.0)]
    missing = lo.isNull() | p25.isNull() | p50.isNull() | p75.isNull() | hi.isNull()
    expr = F.when(missing, F.lit(50.0)).when(value <= lo, F.lit(0.0)).when(value >= hi, F.lit(100.0))
    for (a, pa), (b, pb) in zip(pts, pts[1:]):
        expr = expr.when((value >= a) & (value <= b),
                         F.when(a == b, F.lit(pa)).otherwise(F.lit(pa) + (value - a) / (b - a) * (pb - pa)))
    return expr.otherwise(F.lit(50.0))


def minmax_percentile(value: Column, lo: Column, hi: Column) -> Column:
    """(v - min) / (max - min) * 100 clipped to 0..100; 50 when the range is empty."""
    return F.when(hi > lo, F.least(F.greatest((value - lo) / (hi - lo) * 100, F.lit(0.0)), F.lit(100.0))) \
        .otherwise(F.lit(50.0))


def owner_kpis(items: DataFrame, key: str = "channel_id", title: str = "title") -> DataFrame:
    """Integer avg views per item, mean engagement rate, ratio-of-sums like / comment rate and
    the best item by engagement rate (``max_by``, partial-aggregated)."""
    v, lk, cm = F.col("view_count"), F.col("like_count"), F.col("comment_count")
    rate = F.when(v == 0, F.lit(0.0)).otherwise((lk + cm) / v * 100)
    d = items.select(key, title, "video_id", v.alias("v"), lk.alias("l"), cm.alias("c"), rate.alias("r"))
    g = d.groupBy(key).agg(F.sum("v").alias("_v"), F.sum("l").alias("_l"), F.sum("c").alias("_c"),
                           F.count(F.lit(1)).alias("n_items"), F.avg("r").alias("avg_engagement_rate"),
                           F.max_by(F.col(title), F.struct("r", F.col("video_id"))).alias("best_title"))
    return g.select(key, "n_items", F.floor(F.col("_v") / F.col("n_items")).cast("bigint").alias("avg_views"),
                    "avg_engagement_rate",
                    F.when(F.col("_v") > 0, F.col("_l") / F.col("_v") * 100).otherwise(F.lit(0.0)).alias("like_rate"),
                    F.when(F.col("_v") > 0, F.col("_c") / F.col("_v") * 100).otherwise(F.lit(0.0)).alias("comment_rate"),
                    "best_title")


def simplify_classes(df: DataFrame, label: str, min_rows: int = 3, positive: str = "viral",
                     negative: str = "not_viral") -> DataFrame:
    """When the rarest class has fewer than ``min_rows`` rows, collapse the multi-class label to
    two classes (every class except ``negative`` becomes ``positive``)."""
    rare = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("_min"))
    j = attach_scalars(df, rare)
    return j.withColumn(label, F.when((F.col("_min") < min_rows) & (F.col(label) != negative), F.lit(positive))
                        .otherwise(F.col(label))).drop("_min")


def pivot_shares(df: DataFrame, keys: Sequence[str], pivot_col: str, values: Sequence[str], measure: str,
                 prefix: str = "") -> DataFrame:
    """Long share table -> one column per listed value (explicit value list: no extra job); what other values hold,
    null included, is summed in ``<prefix>other``, so nothing vanishes."""
    known = F.coalesce(F.col(pivot_col).isin(*values), F.lit(False))
    p = (df.withColumn("_pivot", F.when(known, F.col(pivot_col).cast("string")).otherwise(F.lit("_other")))
         .groupBy(*keys).pivot("_pivot", [*map(str, values), "_other"]).agg(F.sum(measure)))
    return p.select(*keys, *[F.col(str(v)).alias(f"{prefix}{v}") for v in values], F.col("_other").alias(f"{prefix}other"))
