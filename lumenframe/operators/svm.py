"""A linear multiclass SVM with hinge loss, fitted by one job an epoch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import add_columns, lists, matrix, sum_arrays


def encode_labels(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """df with class_index 0 .. C - 1 in the order of the labels, and the mapping (label, class_index)."""
    mapping = df.select(label).distinct().withColumn("class_index", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))
    return df.join(F.broadcast(mapping) if _few(mapping) else mapping, label), mapping


def _few(df: DataFrame, most: int = 100_000) -> bool:
    return df.limit(most + 1).count() <= most


def margins_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = x @ w.T + b
    m = np.maximum(0, s - s[np.arange(len(x)), y][:, None] + 1)
    m[np.arange(len(x)), y] = 0
    return m


def batch_gradient(x, y, w, b) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums over the rows: hinge margins, weight and bias gradients (not regularised, not averaged)."""
    m = margins_of(x, y, w, b)
    active = (m > 0).astype(np.float64)
    active[np.arange(len(x)), y] = -active.sum(axis=1)
    return float(m.sum()), active.T @ x, active.sum(axis=0)


def _sums(df: DataFrame, w: np.ndarray, b: np.ndarray):
    c, d = w.shape

    def run(batches):
        n, loss, gw, gb = 0, 0.0, np.zeros((c, d)), np.zeros(c)
        for batch in batches:
            x, y = matrix(batch.column("features")), batch.column("label").to_numpy()
            if len(x):
                part = batch_gradient(x, y, w, b)
                n, loss, gw, gb = n + len(x), loss + part[0], gw + part[1], gb + part[2]
        rows = np.concatenate([gw, gb[:, None], np.full((c, 1), loss / c)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(c), pa.int32()), pa.array([float(n)] * c), lists(rows)], names=["label", "n", "sums"])

    ddl = "label int, n double, sums array<double>"
    rows = sorted(sum_arrays(df.select("features", "label").mapInArrow(run, ddl), ["label"], ddl).collect(), key=lambda r: r["label"])
    sums = np.array([r["sums"] for r in rows])
    return rows[0]["n"] if rows else 0.0, float(sums[:, -1].sum()), sums[:, :d], sums[:, d]


def weight_arrays(weights: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(weights.collect(), key=lambda r: r["label"])
    return np.array([r["w"] for r in rows]), np.array([r["bias"] for r in rows])


def weight_rows(spark, w: np.ndarray, b: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, float(b[i]), [float(v) for v in w[i]]) for i in range(len(w))], "label int, bias double, w array<double>")


def hinge_gradient(df: DataFrame, weights: DataFrame, reg: float = 1e-4) -> DataFrame:
    """(label, loss, grad_b, grad_w): mean gradients, the weights' regularised, and the loss with the penalty reg / 2 |W|^2."""
    w, b = weight_arrays(weights)
    n, hinge, gw, gb = _sums(df, w, b)
    loss = hinge / n + reg / 2 * float((w * w).sum())
    gw, gb = gw / n + reg * w, gb / n
    return df.sparkSession.createDataFrame([(i, loss, float(gb[i]), [float(v) for v in gw[i]]) for i in range(len(w))], "label int, loss double, grad_b double, grad_w array<double>")


def svm_fit(df: DataFrame, lr: float = 0.01, reg: float = 1e-4, epochs: int = 30, batch_size: int = 256, seed: int = 42, mode: str = "average", n_classes: int | None = None, init: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(weights, history) from features and label 0 .. C - 1.

    average: in every epoch each partition goes through its rows in drawn mini-batches from the shared weights, and the
    results are averaged by rows; with one partition this is sequential mini-batch descent. The rows are kept once, on disk
    where memory ends; each epoch sorts a partition by a hash of row and epoch, which spills, and streams it: a task holds
    an Arrow batch and a mini-batch, however long its partition is. batch: one step of the whole
    gradient an epoch. The rate is lr / sqrt(epoch + 1). The loss of a batch takes margins before and the penalty after
    its update; history holds their mean. Only the weights, C x d, pass the driver.
    """
    first = df.select(F.size("features").alias("d")).first()
    if first is None:
        raise ValueError("there are no rows to fit")
    if df.where(F.size("features") != first["d"]).limit(1).count() or df.where(F.col("label").isNull()).limit(1).count():
        raise ValueError("vectors of one length and labels are needed")
    c = n_classes or int(df.agg(F.max("label")).first()[0]) + 1
    kept = None
    if mode != "batch":
        kept = df.select(F.col("features").cast("array<float>").alias("features"), "label", F.monotonically_increasing_id().alias("row")).persist(StorageLevel.MEMORY_AND_DISK)
    w, b = np.random.default_rng(seed).normal(0, init, (c, first["d"])) if init else np.zeros((c, first["d"])), np.zeros(c)
    history = []
    try:
        for epoch in range(epochs):
            rate = lr / np.sqrt(epoch + 1)
            if mode == "batch":
                n, hinge, gw, gb = _sums(df, w, b)
                w, b = w - rate * (gw / n + reg * w), b - rate * gb / n
                history.append((epoch, hinge / n + reg / 2 * float((w * w).sum())))
            else:
                w, b, loss = _local_epoch(kept.sortWithinPartitions(F.xxhash64("row", F.lit(seed), F.lit(epoch)), "row"), w, b, rate, reg, batch_size)
                history.append((epoch, loss))
    finally:
        if kept is not None:
            kept.unpersist()
    spark = df.sparkSession
    return weight_rows(spark, w, b), spark.createDataFrame(history, "epoch int, loss double")


def mini_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of ``size`` consecutive rows each, across Arrow batches; the last may have fewer."""
    x = y = None
    for batch in batches:
        if batch.num_rows:
            own = matrix(batch.column("features"), np.float32), batch.column("label").to_numpy()
            x, y = own if x is None or not len(x) else (np.concatenate([x, own[0]]), np.concatenate([y, own[1]]))
            whole = len(x) - len(x) % size
            for at in range(0, whole, size):
                yield x[at : at + size].astype(np.float64), y[at : at + size]
            x, y = x[whole:].copy(), y[whole:].copy()
    if x is not None and len(x):
        yield x.astype(np.float64), y


def _local_epoch(rows: DataFrame, w0: np.ndarray, b0: np.ndarray, rate: float, reg: float, size: int):
    c, d = w0.shape

    def run(batches):
        w, b, n, losses = w0.copy(), b0.copy(), 0, []
        for x, y in mini_batches(batches, size):
            hinge, gw, gb = batch_gradient(x, y, w, b)
            w -= rate * (gw / len(x) + reg * w)
            b -= rate * gb / len(x)
            n += len(x)
            losses.append(hinge / len(x) + reg / 2 * float((w * w).sum()))
        if n:
            own = np.concatenate([w, b[:, None], np.full((c, 1), np.mean(losses))], axis=1) * n  # a row a class
            yield pa.RecordBatch.from_arrays([pa.array(range(c), pa.int32()), pa.array([float(n)] * c), lists(own)], names=["k", "n", "sums"])

    ddl = "k int, n double, sums array<double>"
    found = sorted(sum_arrays(rows.select("features", "label").mapInArrow(run, ddl), ["k"], ddl).collect(), key=lambda r: r["k"])
    mean = np.array([r["sums"] for r in found]) / found[0]["n"]
    return mean[:, :d], mean[:, d], float(mean[0, -1])


def svm_scores(df: DataFrame, weights: DataFrame | tuple) -> DataFrame:
    """Adds scores and prediction (the class of the largest score, the first of equals)."""
    w, b = weights if isinstance(weights, tuple) else weight_arrays(weights)

    def make(f):
        s = matrix(f) @ w.T + b if len(f) else np.zeros((0, len(b)))
        return {"scores": lists(s), "prediction": pa.array(s.argmax(axis=1) if len(s) else [], pa.int32())}

    return add_columns(df, make, ["features"], "scores array<double>, prediction int")

