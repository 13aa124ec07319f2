"""A trainable text detector from Spark ML, and batch scoring with any scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from .text import binary_metrics, roc_auc


def pipeline(reg: float, iterations: int, features: int = 1 << 16) -> Pipeline:
    return Pipeline(stages=[RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\s+"), HashingTF(inputCol="words", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features"), LogisticRegression(regParam=reg, maxIter=iterations, labelCol="label")])


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds score, the probability of label 1."""
    scored = model.transform(df.withColumn("text", F.coalesce("text", F.lit(""))))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("words", "tf", "features", "rawPrediction", "probability", "prediction")


def score_with(df: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any DataFrame-to-DataFrame scorer that adds score."""
    out = scorer(df)
    if "score" not in out.columns:
        raise ValueError("the scorer adds no column score")
    return out


def fit_best(train: DataFrame, val: DataFrame, grid: tuple[tuple[float, int], ...] = ((0.01, 20), (0.1, 20))) -> tuple[PipelineModel, dict]:
    """The model with the best validation AUC (the first of equals) and its figures. One row per candidate reaches the driver."""
    best, found = None, {}
    train = train.select("text", "label").cache()
    for reg, iterations in grid:
        model = pipeline(reg, iterations).fit(train)
        auc = roc_auc(score(model, val)).first()
        value = auc["auc"] if auc and auc["auc"] is not None else 0.0
        if best is None or value > found["auc"]:
            best, found = model, {"reg": reg, "iterations": iterations, "auc": value}
    train.unpersist()
    return best, found


def evaluate(model: PipelineModel, df: DataFrame) -> DataFrame:
    """One row of metrics. Scores are written once, as narrow rows, and read for both figures."""
    scored = cut(score(model, df).select("label", "score"))
    on_one = lambda rows: rows.withColumn("one", F.lit(1))  # noqa: E731  two tables of one row each
    return on_one(binary_metrics(scored)).join(on_one(roc_auc(scored)), "one").drop("one")


def fit_newton(rows: DataFrame, ridge: float = 1e-3, tolerance: float = 1e-9, most_steps: int = 25) -> tuple[np.ndarray, int]:
    """Logistic regression on features (an array of at most a few hundred numbers) and label 0 or 1: weights and steps taken.

    Least mean log loss plus ridge / 2 times the squared weights, by Newton's method. Each step is one pass: tasks add the
    gradient and the curvature of their rows up, and sums of FAN tasks are added up until one is left, so the driver gets
    one of them. Rows with a null label or feature are left out."""
    kept = cut(rows.filter("label in (0, 1) and features is not null and not exists(features, x -> x is null)").select(F.col("label").cast("double").alias("label"), F.col("features").cast("array<double>").alias("features")))
    d = kept.select(F.max(F.size("features"))).first()[0] or 0
    w, n = np.zeros(d), 0
    for step in range(1, most_steps + 1 if d else 0):
        total = _newton_sums(kept, w)
        n, g, h = total[0], total[1 : 1 + d], total[1 + d :].reshape(d, d)
        move = np.linalg.solve(h / n + ridge * np.eye(d), g / n + ridge * w)
        w = w - move
        if np.abs(move).max() < tolerance:
            break
    return w, step if d else 0


FAN = 64


def _newton_sums(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """Number of rows, gradient and curvature of the log loss at w, over all rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, part = np.zeros(1 + len(w) + len(w) ** 2), 0
        for batch in batches:
            for b in (batch.slice(i, 2_000) for i in range(0, len(batch), 2_000)):
                if len(b):
                    part = b.column("part")[0].as_py()
                    x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
                    p = 0.5 * np.tanh(0.5 * (x @ w)) + 0.5
                    sums += np.concatenate([[len(b)], x.T @ (p - b.column("label").to_numpy()), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
        if sums[0]:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["part", "sums"])

    def merge(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in t.column("sums").to_pylist())
        return pa.table({"part": t.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    parts, most = rows.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(work, "part long, sums binary"), rows.rdd.getNumPartitions()
    while True:
        parts, most = parts.groupBy(F.floor(F.col("part") / FAN).alias("part_of")).applyInArrow(lambda key, t: merge(t), "part long, sums binary").withColumn("part", F.floor(F.col("part") / FAN)), -(-most // FAN)
        if most <= 1:
            return np.frombuffer(bytes(parts.first().sums), np.float64)
