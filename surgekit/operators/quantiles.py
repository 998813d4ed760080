"""Exact quantiles (linear interpolation, numpy / DuckDB ``quantile_cont`` semantics) that never
collect a group or a value into one task.

``percentile`` in Spark keeps a value->count map per group and merges it in one task, so a hot group
(a third of all rows) would sit in one executor. Here the rank of every distinct value is derived instead:

1. rows are counted per (group, value) with a map-side combine: a value that holds most rows (zeros, flags) becomes one
   row with a count;
2. ``repartitionByRange(group..., value)`` spreads the distinct pairs, hot groups included, over contiguous ranges;
   the range-partitioned copy is checkpointed (shared checkpoint folder), so both branches below see the same ranges;
3. a small aggregate gives per (partition, group) chunk its row count, and a window over that small table
   (<= partitions x groups rows) gives chunk offsets and group sizes; running counts inside a chunk then give each value
   the interval of ranks that it covers;
4. the values whose intervals hold the (at most 2 per probability) needed ranks interpolate in a final aggregate.

``reread``: the frame is cheap to read twice (a written table). Then a first pass counts values by narrow buckets of their size
(BUCKETS a doubling), and only the values of the buckets that hold needed ranks go through the steps above.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets of a doubling of the values, and the number of wanted buckets up to which they are broadcast.
BUCKETS, FEW_BUCKETS = 256, 100_000


def _bucket(v: Column) -> Column:
    """A number that never falls as ``v`` rises: the sign and the rounded logarithm of the size."""
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(2000.0)) * BUCKETS) + (1 << 20)
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("long")


def _ranks(n: Column, p: float, between: bool) -> tuple[Column, Column, Column]:
    """The ranks from 0 whose values a quantile lies between, and its way from one to the other."""
    if between:
        h = (n - 1) * F.lit(float(p))
        return F.floor(h), F.ceil(h), h - F.floor(h)
    r = F.least(F.floor(n * F.lit(float(p))), n - 1)
    return r, r, F.lit(0.0)


def _holds_needed(start: Column, count: Column, n: Column, probs: Mapping[str, float], between: bool) -> Column:
    needed = [r for p in probs.values() for r in _ranks(n, p, between)[:2 if between else 1]]
    return reduce(or_, [(r >= start) & (r < start + count) for r in needed])


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (),
                    nparts: int | None = None, count_col: str | None = None, reread: bool = False, between: bool = True) -> DataFrame:
    """One row per group: ``by`` columns + one DOUBLE column per entry of ``probs``.

    NULL and NaN values are ignored (``dropna`` semantics). Groups with no values are absent. Without ``between`` a quantile is the value
    of rank floor(n p) from 0, at most the last.
    """
    by = list(by)
    gcols = by or ["_g"]
    d = df.select(*[F.col(c) for c in by], F.col(value).cast("double").alias("_v"))
    if not by:
        d = d.withColumn("_g", F.lit(0))
    d = d.where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_v", F.col("_v") + F.lit(0.0))  # -0.0 is 0.0
    from ..session import materialize
    groups = gcols
    if reread:
        d = d.withColumn("_b", _bucket(F.col("_v")))
        w = Window.partitionBy(*groups)
        sums = d.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_c"))
        sums = sums.withColumn("_lo", F.sum("_c").over(w.orderBy("_b")) - F.col("_c")).withColumn("_total", F.sum("_c").over(w))
        gcols = [*groups, "_b"]
        wanted = materialize(sums.where(_holds_needed(F.col("_lo"), F.col("_c"), F.col("_total"), probs, between)).select(
            *(F.col(c).alias(f"_w{i}") for i, c in enumerate(gcols)), "_lo", "_total"))
        few = F.broadcast(wanted) if wanted.count() <= FEW_BUCKETS else wanted
        is_wanted = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(gcols)])
        d = d.join(few.drop("_lo", "_total"), is_wanted, "left_semi")
    counted = d.groupBy(*gcols, "_v").agg(F.count(F.lit(1)).alias("_k"))
    ranged = (counted.repartitionByRange(nparts, *gcols, "_v") if nparts else counted.repartitionByRange(*gcols, "_v"))
    r = materialize(ranged.withColumn("_pid", F.spark_partition_id()))
    chunks = r.groupBy("_pid", *gcols).agg(F.sum("_k").alias("_c"))
    wg = Window.partitionBy(*gcols)
    chunks = (chunks.withColumn("_off", F.sum("_c").over(wg.orderBy("_pid")) - F.col("_c"))
              .withColumn("_n", F.sum("_c").over(wg)))
    if reread:  # ranks in the whole group instead of the bucket
        chunks = chunks.join(few, is_wanted).withColumn("_off", F.col("_off") + F.col("_lo")).withColumn("_n", F.col("_total"))
    chunks = (chunks
              .select(F.col("_pid").alias("_p"), "_off", "_n", *(F.col(c).alias(f"_g{i}") for i, c in enumerate(gcols))))
    inside = Window.partitionBy("_pid", *gcols).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    # null-safe on the group, whose key may be null
    on = F.col("_pid") == F.col("_p")
    for i, c in enumerate(gcols):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    t = (r.withColumn("_to", F.sum("_k").over(inside)).join(chunks, on)
         .select(*gcols, "_v", (F.col("_off") + F.col("_to") - F.col("_k")).alias("_from"),
                 (F.col("_off") + F.col("_to")).alias("_to"), "_n"))
    aggs = []
    for nm in probs:
        below, above, way = _ranks(F.col("_n"), probs[nm], between)

        def at(rank):
            return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_to")), F.col("_v")))
        lo = at(below)
        aggs.append((lo + F.max(way) * (at(above) - lo) if between else lo).alias(nm))
    out = t.groupBy(*groups).agg(*aggs, F.max("_n").alias("_n"))
    out = out.withColumnRenamed("_n", count_col) if count_col else out.drop("_n")
    return out.drop("_g") if not by else out


def quantiles_long(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float],
                   by: Sequence[str] = (), nparts: int | None = None, reread: bool = False,
                   between: bool = True) -> DataFrame:
    """Quantiles of several columns at once: unpivot to (feature, value) and group by feature too."""
    by = list(by)
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))
        .alias("_kv")).select(*by, "_kv.feature", "_kv.value")
    return exact_quantiles(long, "value", probs, by=[*by, "feature"], nparts=nparts, reread=reread, between=between)
