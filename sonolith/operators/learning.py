"""Baseline classifier over feature arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .metrics import auc, class_weights, weighted_loss
from .splits import balanced_draws


def fit_baseline(train: DataFrame, validation: DataFrame, features: str, label: str, grid: tuple[float, ...] = (0.0, 0.01, 0.1)) -> tuple[LogisticRegressionModel, DataFrame]:
    """Class-weighted logistic regression; of the grid of regularisation the best validation AUC wins, the first of equals.

    Returns the model and (run, epoch, metric) of every candidate.
    """
    spark = train.sparkSession
    weights = class_weights(train.withColumn("y_true", F.col(label).cast("int"))).select(F.col("y_true").alias(label), "weight")
    rows = train.join(F.broadcast(weights), label).select(array_to_vector(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"), "weight").persist()
    best, tried = None, []
    for i, reg in enumerate(grid):
        model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", regParam=reg, maxIter=30).fit(rows)
        metric = auc(predict(model, validation, features, label)).first()["auc"] or 0.0
        tried.append(("baseline", i, float(metric)))
        if best is None or metric > best[0]:
            best = metric, model
    rows.unpersist()
    return best[1], spark.createDataFrame(tried, "run string, epoch int, metric double")


def predict(model: LogisticRegressionModel, df: DataFrame, features: str, label: str) -> DataFrame:
    out = model.transform(df.withColumn("x", array_to_vector(F.col(features))))
    return out.select(F.lit("baseline").alias("model"), F.col(label).cast("int").alias("y_true"), F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


@dataclass(frozen=True)
class Linear:
    """Weights of a logistic model, the last of them its bias, and the epoch and metric that chose them."""

    weights: tuple[float, ...]
    epoch: int
    metric: float

    def fingerprint(self, spark: SparkSession) -> str:
        row = spark.range(1).select(S.fingerprint(*[F.lit(repr(w)) for w in self.weights], F.lit(str(self.epoch))).alias("f"))
        return row.first()["f"]


def _summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """Sum of arrays of ``size`` numbers: ``part`` makes one of each task's batches, Spark adds them up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["i", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # one row per place
        out[r["i"]] = r["v"]
    return out


def _gradient(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Mean gradient of the cross entropy over rows (x, y)."""
    d = len(weights) - 1

    def part(batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        off = 1 / (1 + np.exp(-(x @ weights[:d] + weights[d]))) - batch.column(1).to_numpy(zero_copy_only=False)
        return np.concatenate([off @ x, [off.sum()], [len(off)]])

    total = _summed(rows, part, d + 2)
    return total[:-1] / max(1.0, total[-1])


def linear_scored(df: DataFrame, weights: tuple[float, ...], features: str, label: str, model: str, keep: list[str] | None = None) -> DataFrame:
    """(model, y_true, score) by one expression, beside the columns ``keep``."""
    terms = F.zip_with(features, F.array(*map(F.lit, weights[:-1])), lambda a, b: a * b)
    z = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) + F.lit(weights[-1])
    return df.select(*(keep or []), F.lit(model).alias("model"), F.col(label).cast("int").alias("y_true"), (1 / (1 + F.exp(-z))).alias("score"))


def fit_epochs(train: DataFrame, validation: DataFrame, features: str, label: str, row: str, epochs: int = 5, steps: int = 1, rate: float = 0.5, draws: int | None = None, seed: str = "epoch") -> tuple[Linear, DataFrame]:
    """Logistic regression by gradient steps over balanced draws; the earliest epoch with the best validation AUC is kept.

    Every epoch draws anew with replacement, each class equally often (balanced_draws), and takes ``steps`` steps, draw i in step
    i % steps. After it validation gets its class-weighted loss and its AUC. Returns the model and (run, epoch, loss, metric) of every
    epoch. Only weights and sums of gradients pass the driver.
    """
    spark = train.sparkSession
    known = train.select(F.col(row).alias("spec_id"), F.col(label).cast("int").alias("label"))
    x = train.select(F.col(row).alias("spec_id"), F.col(features).cast("array<double>").alias("x"))
    d = x.select(F.size("x").alias("d")).first()["d"]
    weights = np.zeros(d + 1)
    loss_weights = class_weights(train.select(F.col(label).cast("int").alias("y_true"))).select("y_true", "weight")
    best, history = None, []
    for epoch in range(epochs):
        drawn = balanced_draws(known, draws, f"{seed}{epoch}").join(x, "spec_id").select("x", F.col("label").cast("double").alias("y"), (F.col("draw") % steps).alias("step")).persist()
        for step in range(steps):
            weights = weights - rate * _gradient(drawn.filter(F.col("step") == step).select("x", "y"), weights)
        drawn.unpersist()
        scored = linear_scored(validation.withColumn(features, F.col(features).cast("array<double>")), tuple(weights.tolist()), features, label, "epochs")
        loss, metric = weighted_loss(scored, loss_weights).first()["loss"], auc(scored, 0.0).first()["auc"]
        history.append(("epochs", epoch, float(loss), float(metric)))
        if best is None or metric > best.metric:
            best = Linear(tuple(weights.tolist()), epoch, float(metric))
    return best, spark.createDataFrame(history, "run string, epoch int, loss double, metric double")


def save_linear(spark: SparkSession, model: Linear, folder: str) -> None:
    """The model as one JSON row with its fingerprint."""
    row = spark.createDataFrame([(json.dumps(model.weights), model.epoch, model.metric, model.fingerprint(spark))], "weights string, epoch int, metric double, fingerprint string")
    row.coalesce(1).write.json(folder)


def load_linear(spark: SparkSession, folder: str) -> Linear:
    """A saved model; one that isn't what its fingerprint says is an error."""
    r = spark.read.schema("weights string, epoch int, metric double, fingerprint string").json(folder).first()
    model = Linear(tuple(json.loads(r["weights"])), r["epoch"], r["metric"])
    if model.fingerprint(spark) != r["fingerprint"]:
        raise ValueError(f"{folder}: weights don't match their fingerprint")
    return model
