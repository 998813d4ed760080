"""Data-quality checks (Q01–Q12): every check returns its failing rows; ``run_suite`` turns a list of
checks into one summary row per check (failures counted by one aggregate each, unioned). ``run_rules`` does the same for checks
declared on named relations, reading each relation once for all its rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import attach_scalars

STALE_HOURS = 48          # fixed freshness threshold
FORMULA_TOLERANCE = 0.001  # fixed self-check tolerance


def unique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q01: keys (non-null) that occur more than once, with their count."""
    cols = list(cols)
    nn = None
    for c in cols:
        cond = F.col(c).isNotNull()
        nn = cond if nn is None else nn & cond
    return df.where(nn).groupBy(*cols).agg(F.count(F.lit(1)).alias("n_records")).where(F.col("n_records") > 1)


def not_null(df: DataFrame, col: str) -> DataFrame:
    """Q02."""
    return df.where(F.col(col).isNull())


def relationships(child: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Q03: child rows whose non-null key has no parent (anti-join)."""
    p = parent.select(F.col(parent_col).alias(col)).distinct()
    return child.where(F.col(col).isNotNull()).join(p, col, "left_anti")


def outside_values(col: str, values: Iterable, where: Column | None = None) -> Column:
    bad = F.col(col).isNotNull() & ~F.col(col).isin(list(values))
    return bad if where is None else where & bad


def outside_range(col: str, min_value=None, max_value=None, inclusive: bool = True) -> Column:
    c = F.col(col)
    bad = F.lit(False)
    if min_value is not None:
        bad = bad | ((c < min_value) if inclusive else (c <= min_value))
    if max_value is not None:
        bad = bad | ((c > max_value) if inclusive else (c >= max_value))
    return bad


def any_negative(cols: Sequence[str]) -> Column:
    bad = None
    for c in cols:
        cond = F.col(c) < 0
        bad = cond if bad is None else bad | cond
    return bad


def invalid_rates(rates: Sequence[str] = ("like_rate_pct", "comment_rate_pct"), score: str = "engagement_score") -> Column:
    bad = F.col(score) < 0
    for r in rates:
        bad = bad | (F.col(r) > 100) | (F.col(r) < 0)
    return bad


def accepted_values(df: DataFrame, col: str, values: Iterable, where: Column | None = None) -> DataFrame:
    """Q04: non-null values outside the accepted list (optionally on a subset)."""
    return df.where(outside_values(col, values, where))


def accepted_range(df: DataFrame, col: str, min_value=None, max_value=None, inclusive: bool = True,
                   where: Column | None = None) -> DataFrame:
    """Q05: values outside [min, max] (or the open interval when not inclusive)."""
    d = df if where is None else df.where(where)
    return d.where(outside_range(col, min_value, max_value, inclusive))


def non_negative(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Q06: rows where any statistic is negative."""
    return df.where(any_negative(cols)).select(key, *cols)


def valid_rates(df: DataFrame, key: str = "video_id", rates: Sequence[str] = ("like_rate_pct", "comment_rate_pct"),
                score: str = "engagement_score") -> DataFrame:
    """Q07: rates outside [0, 100] or a negative score."""
    return df.where(invalid_rates(rates, score)).select(key, *rates, score)


def _age_hours(as_of, ts: str) -> Column:
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    return (F.unix_micros(now) - F.unix_micros(F.col(ts))) / F.lit(3600e6)


def stale(as_of, ts: str = "last_crawl_ts", hours: int = STALE_HOURS) -> Column:
    return F.col(ts).isNull() | (_age_hours(as_of, ts) > hours)


def freshness(control: DataFrame, as_of, ts: str = "last_crawl_ts", hours: int = STALE_HOURS) -> DataFrame:
    """Q09: stale entities (never run counts stale) with age in hours."""
    age = _age_hours(as_of, ts)
    return control.select("channel_id", "channel_name", age.alias("hours_old")).where(
        F.col("hours_old").isNull() | (F.col("hours_old") > hours))


def freshness_summary(control: DataFrame, as_of, ts: str = "last_crawl_ts", hours: int = STALE_HOURS) -> DataFrame:
    """Q09: total / fresh / stale counts and status."""
    old = stale(as_of, ts, hours).cast("int")
    g = control.agg(F.count(F.lit(1)).alias("total_channels"), F.sum(1 - old).alias("fresh_channels"),
                    F.sum(old).alias("stale_channels"))
    return g.withColumn("status", F.when(F.col("stale_channels") > 0, F.lit("warning")).otherwise(F.lit("ok")))


def _formula_rates() -> tuple[Column, Column]:
    v, lk, cm = F.col("view_count"), F.col("like_count"), F.col("comment_count")
    return (F.when(v == 0, F.lit(0.0)).otherwise((lk + cm) / v * 100),
            (lk + cm) / F.when(v > 0, v).otherwise(F.lit(1)) * 100)


def formula_differs(tol: float = FORMULA_TOLERANCE) -> Column:
    rate, manual = _formula_rates()
    return F.abs(rate - manual) > tol


def formula_self_check(df: DataFrame, key: str = "video_id", tol: float = FORMULA_TOLERANCE) -> DataFrame:
    """Q11: engagement rate (likes+comments)/views*100 (0 without views) recomputed with views->1 and
    compared within ``tol``."""
    rate, manual = _formula_rates()
    return df.select(key, rate.alias("engagement_rate"), manual.alias("manual_rate")).where(
        F.abs(F.col("engagement_rate") - F.col("manual_rate")) > tol)


def join_drift(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Q12: rows before and after an inner join on ``keys``, and the delta. The joined rows are counted, not made: counts per
    key on either side are multiplied, so a hot key costs one row."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    before = a.agg(F.coalesce(F.sum("_l"), F.lit(0)).alias("n_before"))
    after = a.join(b, keys).agg(F.coalesce(F.sum(F.col("_l") * F.col("_r")), F.lit(0)).alias("n_after"))
    return attach_scalars(before, after).withColumn("delta", F.col("n_after") - F.col("n_before")) \
        .withColumn("drift", F.col("delta") != 0)


@dataclass
class Check:
    name: str
    failures: DataFrame
    severity: str = "error"
    enabled: bool = True


def run_suite(checks: Sequence[Check]) -> DataFrame:
    """Q08 / Q10: one row per enabled check: name, severity, failing rows, status (pass / fail / warn)."""
    out = None
    for ch in checks:
        if not ch.enabled:
            continue
        r = ch.failures.agg(F.count(F.lit(1)).alias("failures")).select(
            F.lit(ch.name).alias("check_name"), F.lit(ch.severity).alias("severity"), "failures")
        out = r if out is None else out.unionByName(r)
    return out.withColumn("status", _status())


def _status() -> Column:
    return F.when(F.col("failures") == 0, F.lit("pass")).when(F.col("severity") == "warn", F.lit("warn")) \
        .otherwise(F.lit("fail"))


@dataclass
class Rule:
    """A check on a named relation, told by one of: ``failing`` (a predicate true on failing rows), ``key`` (columns whose
    non-null values must not repeat; every repeated key is one failure), ``parent`` ((relation, column): every row whose
    non-null ``key`` is not among that column's values is one failure; the key is then one column)."""
    name: str
    relation: str
    failing: Column | None = None
    key: Sequence[str] = ()
    parent: tuple[str, str] | None = None
    severity: str = "error"
    enabled: bool = True


def _relation_failures(rules: Sequence[Rule], relations: dict[str, DataFrame]) -> DataFrame:
    """(check_name, failures) of the rules of one relation, which is read once.

    Each row gives one entry a keyed rule (its number and the key as text) and, if there are row rules, one entry with their
    verdicts; entries are counted by (rule, key), so a hot key or a whole table's verdicts collapse in the map tasks. Values of a
    parent column join as entries of their own and mark their key as known."""
    df = relations[rules[0].relation]
    plain, keyed = [r for r in rules if r.failing is not None], [r for r in rules if r.failing is None]
    flags = [f"_f{i}" for i in range(len(plain))]
    verdicts = [F.coalesce(r.failing, F.lit(False)).cast("long").alias(f) for r, f in zip(plain, flags)]
    named = [F.struct(F.lit(r.name).alias("check_name"), F.coalesce(F.col(f), F.lit(0).cast("long")).alias("failures"))
             for r, f in zip(plain, flags)]
    if not keyed:
        return df.select(*verdicts).agg(*[F.sum(f).alias(f) for f in flags]) \
            .select(F.explode(F.array(*named)).alias("_r")).select("_r.*")

    def entry(rule, key, rows, known, values):
        return F.struct(F.lit(rule).alias("_rule"), key.alias("_key"), F.lit(rows).cast("long").alias("_rows"),
                        F.lit(known).alias("_known"), *[v.alias(f) for v, f in zip(values, flags)])

    def text(cols):
        parts = [F.col(c).cast("string") for c in cols]
        return F.when(F.array_contains(F.transform(F.array(*parts), lambda x: x.isNull()), True), None).otherwise(F.array(*parts))

    zero = [F.lit(0).cast("long")] * len(flags)
    key_columns = sorted({c for r in keyed for c in r.key})
    entries = [entry(i, text(r.key), 1, False, zero) for i, r in enumerate(keyed)]
    if plain:
        entries.append(entry(-1, F.array(F.lit("")), 0, False, [F.col(f) for f in flags]))
    long = df.select(*key_columns, *verdicts).select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")
    for i, r in enumerate(keyed):
        if r.parent is not None:
            long = long.unionByName(relations[r.parent[0]].select(
                entry(i, text([r.parent[1]]), 0, True, zero).alias("_e")).select("_e.*"))
    counts = long.where(F.col("_key").isNotNull()).groupBy("_rule", "_key").agg(
        F.sum("_rows").alias("_rows"), F.max("_known").alias("_known"), *[F.sum(f).alias(f) for f in flags])
    sums = []
    for i, r in enumerate(keyed):
        if r.parent is None:
            bad = F.when((F.col("_rule") == i) & (F.col("_rows") > 1), 1)
        else:
            bad = F.when((F.col("_rule") == i) & ~F.col("_known"), F.col("_rows"))
        sums.append(F.sum(bad.cast("long")).alias(f"_k{i}"))
    row = counts.agg(*sums, *[F.sum(f).alias(f) for f in flags])
    named += [F.struct(F.lit(r.name).alias("check_name"), F.coalesce(F.col(f"_k{i}"), F.lit(0).cast("long")).alias("failures"))
              for i, r in enumerate(keyed)]
    return row.select(F.explode(F.array(*named)).alias("_r")).select("_r.*")


def run_rules(rules: Sequence[Rule], relations: dict[str, DataFrame]) -> DataFrame:
    """Q10: one row per enabled rule (check_name, severity, failures, status), each relation read once for all its rules.

    Nulls never fail a rule but one that asks for them; an empty relation passes; keys are compared by their text, so a parent's
    key may be of another integer type. A rule on an unknown relation, or told in none or two ways, is an error."""
    live = [r for r in rules if r.enabled]
    for r in live:
        if (r.failing is None) == (not r.key) or (r.parent is not None and len(r.key) != 1):
            raise ValueError(f"rule {r.name!r} needs either a predicate or key columns (one, with a parent)")
        for name in [r.relation] + ([r.parent[0]] if r.parent else []):
            if name not in relations:
                raise ValueError(f"rule {r.name!r} names the unknown relation {name!r}")
    if not live:
        raise ValueError("no enabled rule")
    out = None
    for name in dict.fromkeys(r.relation for r in live):
        part = _relation_failures([r for r in live if r.relation == name], relations)
        out = part if out is None else out.unionByName(part)
    severity = F.create_map(*[F.lit(x) for r in live for x in (r.name, r.severity)])
    return out.select("check_name", severity[F.col("check_name")].alias("severity"), "failures").withColumn("status", _status())


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table with status ok / empty."""
    out = None
    for name, df in tables.items():
        r = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = r if out is None else out.unionByName(r)
    return out.withColumn("status", F.when(F.col("row_count") > 0, F.lit("ok")).otherwise(F.lit("empty")))
