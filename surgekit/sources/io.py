"""Readers, writers and contracts.

Everything takes paths / table names as arguments; the cluster decides where they live.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed: the category seed's declared types
CATEGORY_SCHEMA = T.StructType([T.StructField("category_id", T.StringType()),
                                T.StructField("category_name", T.StringType()),
                                T.StructField("description", T.StringType())])

LAYERS = ("staging", "intermediate", "mart", "dq_failures")


def conform(df: DataFrame, contract: T.StructType, defaults: Mapping[str, object] | None = None,
            strict: bool = False) -> DataFrame:
    """Project to a typed contract: missing columns become typed NULL (or the given
    default), present ones are cast (TRY_CAST unless ``strict``), extra columns are dropped, order fixed."""
    defaults = defaults or {}
    have = set(df.columns)
    cols = []
    for f in contract.fields:
        if f.name in have:
            c = F.col(f.name).cast(f.dataType) if strict else F.col(f.name).try_cast(f.dataType)
            if f.name in defaults:
                c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        else:
            c = F.lit(defaults.get(f.name)).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read_seed(spark: SparkSession, path: str, schema: T.StructType = CATEGORY_SCHEMA) -> DataFrame:
    """Typed CSV seed (header, no inference)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_tolerant_csv(spark: SparkSession, path: str, contract: T.StructType,
                      defaults: Mapping[str, object] | None = None) -> DataFrame:
    """CSV whose columns may be missing: read as text, then conform with typed defaults."""
    raw = spark.read.option("header", True).csv(path)
    return conform(raw, contract, defaults)


def write_search_results(df: DataFrame, path: str, narrow_cols: Sequence[str], status_col: str = "status") -> None:
    """Full result CSV plus a narrow projection of the FOUND* rows next to it."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/all")
    (df.where(F.col(status_col).startswith("FOUND")).select(*narrow_cols)
       .write.mode("overwrite").option("header", True).csv(f"{path}/found"))


def layer_path(root: str, layer: str) -> str:
    """Layer -> storage prefix; unknown layers are an error."""
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}; expected one of {LAYERS}")
    return f"{root.rstrip('/')}/{layer}"


def materialize_layer(df: DataFrame, root: str, layer: str, name: str, partition_col: str | None = None,
                      partition_by_month: bool = True, cluster_by: Sequence[str] = (), spark: SparkSession | None = None
                      ) -> DataFrame:
    """Staging and intermediate stay lazy temp views; marts are written partitioned by month of
    ``partition_col`` and clustered (sorted inside partitions) by ``cluster_by`` so parquet row-group
    statistics prune scans. Returns the relation to use downstream."""
    if layer in ("staging", "intermediate"):
        df.createOrReplaceTempView(name)
        return df
    path = f"{layer_path(root, layer)}/{name}"
    out = df
    parts: list[str] = []
    if partition_col:
        out = out.withColumn("_part", F.trunc(F.col(partition_col), "MM") if partition_by_month else F.col(partition_col))
        parts = ["_part"]
        out = out.repartitionByRange("_part", *cluster_by).sortWithinPartitions("_part", *cluster_by)
    elif cluster_by:
        out = out.sortWithinPartitions(*cluster_by)
    w = out.write.mode("overwrite")
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)
    return (spark or df.sparkSession).read.parquet(path)


def store_failures(failures: DataFrame, root: str, check_name: str) -> str:
    """Failing rows of a check written to the failures layer (overwritten per run)."""
    path = f"{layer_path(root, 'dq_failures')}/{check_name}"
    failures.write.mode("overwrite").parquet(path)
    return path


def scan(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Table scan with an optional LIMIT (lazy; nothing is pulled to the driver)."""
    d = spark.read.parquet(path)
    return d.limit(limit) if limit else d


def seed_today_quota(usage: DataFrame, today: Column, daily_limit: int = 10_000) -> DataFrame:
    """Idempotent insert of today's quota row (anti-join: nothing happens when it exists)."""
    row = usage.sparkSession.range(1).select(today.cast("date").alias("date"), F.lit(0).alias("quota_used"),
                                             F.lit(daily_limit).alias("daily_limit"))
    missing = row.join(usage.select("date"), "date", "left_anti")
    return usage.unionByName(missing.select(*usage.columns), allowMissingColumns=True)


def registry_add_or_update(registry: DataFrame, new: DataFrame, key: str, id_col: str = "id",
                           update_cols: Sequence[str] = ()) -> DataFrame:
    """Known keys are updated in place, unknown keys get ids max(id) + 1, + 2, ... in key order
    (distributed global rank, no single-task window). A key that repeats in ``new`` is an error."""
    from ..operators.ordering import global_rank
    from ..operators.tables import attach_scalars, unique_by
    new = unique_by(new, [key])
    known = new.join(registry.select(key), key, "left_semi")
    fresh = global_rank(new.join(registry.select(key), key, "left_anti"), [key], rank_col="_rk")
    mx = registry.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_mx"))
    fresh = attach_scalars(fresh, mx).withColumn(id_col, (F.col("_mx") + F.col("_rk")).cast("long")).drop("_mx", "_rk")
    upd = registry.alias("r").join(known.alias("n"), key, "left")
    cols = []
    for c in registry.columns:
        if c in update_cols:
            cols.append(F.coalesce(F.col(f"n.{c}"), F.col(f"r.{c}")).alias(c))
        elif c == key:
            cols.append(F.col(key))
        else:
            cols.append(F.col(f"r.{c}").alias(c))
    return upd.select(*cols).unionByName(fresh.select(*[c for c in registry.columns if c in fresh.columns]),
                                         allowMissingColumns=True)


def clean_for_display(df: DataFrame, id_col: str, numeric_cols: Sequence[str], sort_col: str) -> DataFrame:
    """Drop rows with an empty id, coerce numeric text (non-numeric -> 0), sort by ``sort_col`` desc."""
    out = df.where(F.col(id_col).isNotNull() & (F.trim(F.col(id_col)) != ""))
    for c in numeric_cols:
        out = out.withColumn(c, F.coalesce(F.col(c).try_cast("bigint"), F.lit(0).cast("bigint")))
    return out.orderBy(F.desc(sort_col), F.asc(id_col))
