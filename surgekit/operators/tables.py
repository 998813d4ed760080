"""Generic table operators: dedup (W01), skip-if-exists ingest (S04), key predicates (P14/J07/J08),
version diff (U01), reconciliation (J09), unions (U02/U03), top-k (T*), upsert (I01/I02/I04).

Skew rules applied here:
* "keep latest / first per key" is an aggregate (``max_by`` / ``min_by`` over a struct ordering), not
  a window: partial aggregation collapses a hot key inside every map task before the shuffle.
* per-group top-k runs in two rounds: top-k inside (group, input partition), then top-k of the at most
  k x partitions survivors per group, so no task ever sorts a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Append the columns of a one-row relation (a global aggregate) to every row.

    Planned as a scalar subquery: evaluated once, inlined as a value into the projection — no join and
    no broadcast of anything but one row. More than one row is a runtime error (the bound is enforced),
    an empty relation gives NULLs."""
    sc = scalars.select(F.struct(*[F.col(c) for c in scalars.columns]).alias("_s")).scalar()
    return df.select("*", *[sc[c].alias(c) for c in scalars.columns])


def _ordering(order_cols: Sequence[str | Column]) -> Column:
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_cols])


def keep_latest(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], latest: bool = True) -> DataFrame:
    """W01 (+ P09: no helper rank column is left behind): one row per key, the one with the greatest
    (``latest``) or smallest ordering tuple.

    Equivalent to ``row_number() over (partition by keys order by order_cols desc) = 1`` when the
    ordering tuple is unique per key (pass a tie-break column last).
    """
    keys = list(keys)
    payload = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    pick = F.max_by if latest else F.min_by
    return (df.groupBy(*keys).agg(pick(payload, _ordering(order_cols)).alias("_r"))
              .select(*keys, "_r.*"))


def skip_if_exists(incoming: DataFrame, target: DataFrame, keys: Sequence[str],
                   order_cols: Sequence[str] | None = None, keep: str = "first") -> DataFrame:
    """Rows of ``incoming`` whose key is not in ``target``; duplicates inside the batch are
    collapsed to the first (or latest) row per key. Never fails open: the anti-join is part of the plan."""
    keys = list(keys)
    inc = incoming
    if order_cols:
        inc = keep_latest(incoming, keys, order_cols, latest=(keep == "latest"))
    existing = target.select(*keys).distinct()
    return inc.join(existing, keys, "left_anti")


def existing_keys(candidates: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidate keys that exist in the target (semi-join)."""
    return candidates.select(*keys).distinct().join(target.select(*keys), list(keys), "left_semi")


def symmetric_diff(a: DataFrame, b: DataFrame, tag_col: str = "diff_source",
                   a_tag: str = "a_minus_b", b_tag: str = "b_minus_a") -> DataFrame:
    """(a EXCEPT DISTINCT b) tagged ∪ (b EXCEPT DISTINCT a) tagged. Columns must align by name."""
    b = b.select(*a.columns)
    return (a.subtract(b).withColumn(tag_col, F.lit(a_tag))
            .unionByName(b.subtract(a).withColumn(tag_col, F.lit(b_tag))))


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], measures: Sequence[str],
              mode: str = "any") -> DataFrame:
    """Full outer join on keys; report rows where measures differ (null-safe).

    mode ``any``: a row is reported when any measure differs or the row is one-sided.
    mode ``all``: faithful to the reference, every measure must differ with plain ``<>`` (so one-sided
    rows, whose comparisons are NULL, vanish).
    """
    keys = list(keys)
    aa = a.select(*keys, *[F.col(m).alias(f"a_{m}") for m in measures])
    bb = b.select(*keys, *[F.col(m).alias(f"b_{m}") for m in measures])
    j = aa.join(bb, keys, "full_outer")
    if mode == "all":
        cond = None
        for m in measures:
            c = F.col(f"a_{m}") != F.col(f"b_{m}")
            cond = c if cond is None else cond & c
        cond = F.coalesce(cond, F.lit(False))
    else:
        cond = None
        for m in measures:
            c = ~F.col(f"a_{m}").eqNullSafe(F.col(f"b_{m}"))
            cond = c if cond is None else cond | c
    flags = [(~F.col(f"a_{m}").eqNullSafe(F.col(f"b_{m}"))).alias(f"diff_{m}") for m in measures]
    return j.where(cond).select("*", *flags)


def union_relations(frames: dict[str, DataFrame], source_col: str = "source_relation") -> DataFrame:
    """unionByName with missing columns allowed, tagging each row with its relation name."""
    out = None
    for name, df in frames.items():
        t = df.withColumn(source_col, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def top_k(df: DataFrame, order_cols: Sequence[Column], k: int) -> DataFrame:
    """T*: global top-k; planned as TakeOrderedAndProject (k rows per task, merged on the driver)."""
    return df.orderBy(*order_cols).limit(k)


def top_k_per_group(df: DataFrame, keys: Sequence[str], order_cols: Sequence[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """The first k rows per group in ``order_cols`` order (order must be unique per group).

    Round 1 ranks inside (group, input partition), bounded by the partition size; round 2 ranks the
    at most k x partitions survivors of every group.
    """
    keys = list(keys)
    pid = F.spark_partition_id()
    d = df.withColumn("_pid", pid)
    w1 = Window.partitionBy(*keys, "_pid").orderBy(*order_cols)
    d = d.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_pid")
    w2 = Window.partitionBy(*keys).orderBy(*order_cols)
    return d.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


def unique_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself, one row per key; a key that repeats fails the query when it runs."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.lit(0).alias("_"), *rest)).alias("_row"))
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit(f"several rows for one key {keys}")))
    return one.withColumn("_row", checked).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update_cols: Sequence[str] | None = None,
           order_cols: Sequence[str] | None = None, updated_at: Column | None = None,
           updated_col: str = "updated_at") -> DataFrame:
    """Insert-or-update by key.

    Rows of the target without a match are kept; matched rows take ``update_cols`` from the source
    (all non-key source columns by default) and get ``updated_at``; new keys are inserted. The source is
    deduplicated per key first (latest by ``order_cols``); without ``order_cols`` a repeated source key is an error, since
    nothing says which row counts.
    """
    keys = list(keys)
    src = keep_latest(source, keys, order_cols) if order_cols else unique_by(source, keys)
    cols = list(update_cols) if update_cols is not None else [c for c in src.columns if c not in keys]
    s = src.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in cols]).withColumn("_hit", F.lit(True))
    j = target.join(s, keys, "full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in cols:
            out.append(F.when(F.col("_hit"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c))
        elif c == updated_col and updated_at is not None:
            out.append(F.when(F.col("_hit"), updated_at).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def additive_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """``used = used + new`` per key (union then sum: partial aggregation, no join)."""
    keys = list(keys)
    u = target.select(*keys, *measures).unionByName(source.select(*keys, *measures))
    return u.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def delete_keys(df: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Remove keys (apply to every table that references them)."""
    return df.join(doomed.select(*keys).distinct(), list(keys), "left_anti")


def entity_match(queries: DataFrame, candidates: DataFrame, qkey: str, qtext: str, cid: str, cname: str,
                 rank: str) -> DataFrame:
    """Per query the first candidate (by rank) whose name equals or contains the query text
    (case-insensitive), else the first candidate; NOT_FOUND without candidates.

    Candidates arrive as a ranked list per query (equi-join on the query key, the list size is whatever the
    search returned); picking is a ``min_by`` aggregate, so no window and no all-pairs join."""
    c = candidates.select(F.col(qkey).alias("_qk"), cid, cname, rank)
    j = queries.join(c, queries[qkey] == c["_qk"], "left")
    q, n = F.lower(F.col(qtext)), F.lower(F.col(cname))
    hit = (n == q) | n.contains(q)
    g = j.groupBy(qkey, qtext).agg(
        F.min_by(F.struct(F.col(cid).alias("id"), F.col(cname).alias("name")), F.when(hit, F.col(rank))).alias("_m"),
        F.min_by(F.struct(F.col(cid).alias("id"), F.col(cname).alias("name")), F.col(rank)).alias("_f"),
        F.count(F.col(cid)).alias("n_candidates"))
    pick = F.coalesce(F.col("_m"), F.col("_f"))
    return g.select(qkey, qtext, pick["id"].alias("matched_id"), pick["name"].alias("matched_name"),
                    F.when(F.col("_m").isNotNull(), F.lit("matched")).when(F.col("_f").isNotNull(), F.lit("first_result"))
                    .alias("match_kind"),
                    F.when(F.col("n_candidates") > 0, F.lit("FOUND")).otherwise(F.lit("NOT_FOUND")).alias("status"))


def first_containing(queries: DataFrame, entities: DataFrame, qkey: str, qtext: str, cid: str, cname: str) -> DataFrame:
    """Per query the entity of least id, among all of them, whose name equals or contains the query text
    (case-insensitive); queries without one are left out.

    A name holds a text if one of its substrings of that length equals it, so the search is an equi-join on substrings of the
    lengths that query texts have (a one-row relation: no length above the longest name matters, and nothing runs while the
    plan is built). A name becomes many substrings, so names are dealt out before they are cut, and only substrings that are query texts go
    on. Each of those keeps its least entity's id before the shuffle, so that a substring common to all names is one row a task, and
    takes its name from the entities at last."""
    from ..session import shuffle_tasks
    text = F.lower(F.col(qtext))
    low = entities.where(F.col(cid).isNotNull()).select(cid, cname, F.lower(F.col(cname)).alias("_low"))
    dealt = low.select(F.col(cid).alias("_id"), "_low").repartition(shuffle_tasks(queries.sparkSession))
    longest = low.agg(F.max(F.length("_low")).alias("_longest"))
    sizes = attach_scalars(queries.select(F.length(text).alias("_n")), longest).where(F.col("_n") <= F.col("_longest")) \
        .agg(F.collect_set("_n").alias("_sizes"))
    cut = attach_scalars(dealt, sizes).select("_id", "_low", F.explode(F.filter("_sizes", lambda n: n <= F.length("_low"))).alias("_n"))
    cut = cut.select("_id", "_low", "_n", F.explode(F.sequence(F.lit(1), F.length("_low") - F.col("_n") + 1)).alias("_at"))
    wanted = queries.select(text.alias("_key")).distinct()
    keys = cut.select(F.expr("substring(_low, _at, _n)").alias("_key"), "_id").join(wanted, "_key", "left_semi").groupBy("_key").agg(
        F.min("_id").alias("_id"))
    # of several entities with that id, the least name that holds the text
    named = keys.join(low, F.col("_id") == F.col(cid)).where(F.contains("_low", "_key")).groupBy("_key", "_id").agg(F.min(cname).alias("_name"))
    return queries.select(F.col(qkey), text.alias("_key")).join(named, "_key").select(
        qkey, F.col("_id").alias(cid), F.col("_name").alias(cname))


def upsert_plan(candidates: DataFrame, existing: DataFrame, key: str, update_existing: bool = True) -> DataFrame:
    """Classify candidates against existing keys: no key -> failed, existing -> updated / skipped,
    new -> added (semi-join flag, then one aggregate per action)."""
    ex = existing.select(key).distinct().withColumn("_exists", F.lit(True))
    j = candidates.join(ex, key, "left")
    act = (F.when(F.col(key).isNull(), F.lit("failed"))
           .when(F.col("_exists"), F.lit("updated" if update_existing else "skipped"))
           .otherwise(F.lit("added")))
    return j.withColumn("action", act).drop("_exists")


def lookup_first(df: DataFrame, lookup: DataFrame, key: str, cols: Sequence[str],
                 order_cols: Sequence[str]) -> DataFrame:
    """Left join of a lookup deduplicated to its first row per key (``drop_duplicates`` then merge,
    with an explicit order so the kept row is deterministic)."""
    first = keep_latest(lookup.select(key, *cols, *[c for c in order_cols if c not in cols and c != key]),
                        [key], order_cols, latest=False)
    return df.join(first.select(key, *cols), key, "left")
