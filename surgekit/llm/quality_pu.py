"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows with label 1, the unlabelled set is web text, the class prior is estimated as the
positives' share of the labelled training rows. With logistic loss the unbiased risk of a linear score g is
``prior * E_p[l(g)] + (E_u[l(-g)] - prior * E_p[l(-g)])``; the bracket estimates the negatives' risk, which can't be
below zero, so whenever a step finds it negative the step undoes it instead (non-negative risk). Negative labels enter
the prior only.

Fitting uses at most ``POSITIVES`` and ``UNLABELLED`` rows, taken in hash order of doc_id outside the held-out fold;
scoring reads every whole text once, one batch at a time, with no shuffle.

Defined cases: null text counts as empty; an empty text has a score as any other (from its all-zero features); repeated
doc_ids are scored row by row; without a positive or an unlabelled training row every score is the prior (0.5 without any
label); an empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .shared import byte_chunks, fold, map_batches, texts
from .text_features import NAMES, features

#: Bounds of the fitting samples.
POSITIVES = 10_000
UNLABELLED = 20_000
FOLDS, HELD_OUT = 3, 1
STEPS, RATE, L2 = 800, 0.05, 1e-4
CLIP = 6.0


@dataclass(frozen=True)
class Model:
    prior: float
    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sampling.sigmoid(expand(x, self.mean, self.sd) @ self.weights + self.bias)


def expand(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, and their squares, so that both tails of a feature can count against a text."""
    z = np.clip((x - mean) / sd, -CLIP, CLIP)
    return np.concatenate([z, z * z / CLIP], axis=1)


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimises the non-negative unbiased risk by full-batch Adam steps from zero (no randomness)."""
    k = len(NAMES)
    if not len(positives) or not len(unlabelled):
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return Model(prior, np.zeros(k), np.ones(k), np.zeros(2 * k), float(np.log(p / (1 - p))))
    mean, sd = sampling.standardise(unlabelled)
    p, u = expand(positives, mean, sd), expand(unlabelled, mean, sd)
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        gp, gu = p @ w + b, u @ w + b
        sp, su = sampling.sigmoid(gp), sampling.sigmoid(gu)
        negative_risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        d_pos_w, d_pos_b = -prior * ((1 - sp) @ p) / len(p), -prior * (1 - sp).mean()
        d_neg_w = su @ u / len(u) - prior * (sp @ p) / len(p)
        d_neg_b = su.mean() - prior * sp.mean()
        if negative_risk >= 0:
            gw, gb = d_pos_w + d_neg_w, d_pos_b + d_neg_b
        else:
            gw, gb = -d_neg_w, -d_neg_b
        g = np.append(gw + L2 * w, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        delta = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - delta[:-1], b - delta[-1]
    return Model(prior, mean, sd, w, float(b))


def _feature_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in byte_chunks(batch):
                x = features(data, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])
    return map_batches(docs, run, "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = FOLDS, held_out: int = HELD_OUT,
          positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    known = sampling.training_labels(labels, label, parts, held_out)
    n, n1 = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)), F.lit(0))).first()
    prior = (n1 + 1) / (n + 2)
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != held_out)).distinct()
    pos = sampling.first_by_hash(known.where("y = 1"), positives, 1).withColumn("part", F.lit(1))
    web = sampling.first_by_hash(ids, unlabelled, 2).withColumn("part", F.lit(0))
    chosen = pos.unionByName(web).groupBy("doc_id").agg(F.collect_set("part").alias("parts"))
    sample = sampling.rows_of(texts(docs), chosen.select("doc_id"))
    # a doc_id may stand in several rows: one of its rows (the smallest features) speaks for it, so the bound holds
    rows = (_feature_rows(sample).groupBy("doc_id").agg(F.min("x").alias("x"))
            .join(F.broadcast(chosen), "doc_id").orderBy("doc_id").collect())
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(NAMES))
    is_pos, is_web = (np.array([k in r["parts"] for r in rows], bool) for k in (1, 0))
    return fit(x[is_pos], x[is_web], prior)


def score(docs: DataFrame, model: Model, parts: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``."""
    schema = "doc_id long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in byte_chunks(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(model.score(features(data, off)))], ["doc_id", "score"])
    return (map_batches(texts(docs), run, schema)
            .select("doc_id", F.coalesce(sampling.is_held_out(parts, held_out), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def quality_scores(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    return score(docs, train(docs, labels, **kw))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, all their columns unchanged."""
    fields = docs.schema
    names = docs.columns
    body = docs.withColumn("__body", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in byte_chunks(batch, column="__body"):
                good = pa.array(model.score(features(data, off)) >= threshold)
                yield batch.slice(a, b - a).select(names).filter(good)
    return map_batches(body, run, fields)
