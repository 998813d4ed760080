"""Bounded, repeatable samples of labelled rows for fitting, and the logistic fit both classifiers use."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fold


def training_labels(labels: DataFrame, label: str, parts: int, held_out: int) -> DataFrame:
    """(doc_id, y) of labelled rows outside the held-out fold; null ids and null labels are no labels. A doc_id that is
    labelled more than once counts once, with its smallest label."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
            .where(fold(F.col("doc_id"), parts) != held_out)
            .groupBy("doc_id").agg(F.min(F.col(label)).cast("int").alias("y")))


def first_by_hash(df: DataFrame, rows: int, salt: int, *cols: str) -> DataFrame:
    """At most ``rows`` rows in hash order of their doc_id: a repeatable sample, taken by a distributed top-k."""
    return df.orderBy(F.xxhash64(F.col("doc_id"), F.lit(salt)), "doc_id").limit(rows).select("doc_id", *cols)


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of a sampled id list. The list has at most the sample's bound of rows, so it is broadcast."""
    return docs.join(F.broadcast(ids), "doc_id")


def is_held_out(parts: int, held_out: int) -> Column:
    return fold(F.col("doc_id"), parts) == held_out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, sd = x.mean(axis=0), x.std(axis=0)
    return mean, np.where(sd > 1e-9, sd, 1.0)
