"""Scoring of images with a model bundle, and result records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import add_columns, bytes_matrix, lists
from .forest import Trees
from .hog import hog_batch
from .preprocess import gray_batch, scaler_arrays
from .svm import weight_arrays


def top_k(df: DataFrame, classes: list[str], k: int = 3) -> DataFrame:
    """Adds top_k: (label, class, score) by score descending, the higher label first among equals; k is held to 1 .. C.
    A row without scores ranks zeros."""
    k = max(1, min(int(k), len(classes)))
    names = F.array(*[F.lit(c) for c in classes])
    scores = F.coalesce(F.col("scores"), F.array_repeat(F.lit(0.0), len(classes)))
    pairs = F.sort_array(F.transform(scores, lambda s, i: F.struct(s.alias("score"), i.alias("label"))), asc=False)
    return df.withColumn("top_k", F.transform(F.slice(pairs, 1, k), lambda p: F.struct(p["label"].alias("label"), F.element_at(names, p["label"] + 1).alias("class"), p["score"].cast("double").alias("score"))))


def attach_actual(df: DataFrame, manifest: DataFrame | None, path: str = "path") -> DataFrame:
    """Adds actual_label by the base name of path; null without a record. The manifest has one row a file name."""
    if manifest is None:
        return df.withColumn("actual_label", F.lit(None).cast("int"))
    records = manifest.groupBy("file_name").agg(F.first("label").cast("int").alias("actual_label"))
    return df.withColumn("file_name", F.regexp_extract(path, r"[^/]+$", 0)).join(records, "file_name", "left").drop("file_name")


def parse_labels(df: DataFrame, classes: DataFrame, value: str = "value") -> DataFrame:
    """Adds label and error: a whole number in 0 .. C - 1, or a class name."""
    names = classes.select(F.col("class_name").alias(value), F.col("label").alias("named"))
    n = classes.count()
    number = F.expr(f"try_cast(`{value}` AS INT)")
    label = F.coalesce(number, F.col("named"))
    error = F.when(label.isNull(), "unknown class").when((label < 0) | (label >= n), "out of range")
    return df.join(F.broadcast(names) if n <= 100_000 else names, value, "left").withColumn("error", error).withColumn("label", F.when(F.col("error").isNull(), label)).drop("named")


def check_counts(labels: list, images: list) -> None:
    if len(labels) != len(images):
        raise ValueError("there must be one label for each image")


def prediction_records(df: DataFrame, classes: DataFrame) -> DataFrame:
    """source, predicted and actual labels and classes, the older names true_label and true_class, and status."""
    n = classes.select("label", "class_name")
    p = n.select(F.col("label").alias("prediction"), F.col("class_name").alias("predicted_class"))
    a = n.select(F.col("label").alias("actual_label"), F.col("class_name").alias("actual_class"))
    status = F.when(F.col("actual_label").isNull(), "unknown").when(F.col("actual_label") == F.col("prediction"), "correct").otherwise("wrong")
    j = df.join(p, "prediction", "left").join(a, "actual_label", "left")
    more = ["top_k"] if "top_k" in df.columns else []
    return j.select("source", F.col("prediction").alias("predicted_label"), "predicted_class", "actual_label", "actual_class", F.col("actual_label").alias("true_label"), F.col("actual_class").alias("true_class"), status.alias("status"), *more)


def score_images(images: DataFrame, bundle: dict, feature: str | None = None, h: int = 32, w: int = 32) -> DataFrame:
    """Adds scores (null for forests) and prediction: features, scaling and model in one map job, so streams work too.

    bundle: feature (pixel or hog), parameters, classes, and scaler, weights or nodes as tables or arrays.
    """
    name = feature or bundle.get("feature")
    if name is None:
        raise ValueError("the bundle names no feature; pass one")
    if name not in ("pixel", "hog"):
        raise ValueError(f"images can't be scored with feature {name}")
    parameters = bundle.get("parameters") or {}
    mean, scale = bundle["scaler"] if isinstance(bundle["scaler"], tuple) else scaler_arrays(bundle["scaler"])
    weights, nodes = bundle.get("weights"), bundle.get("nodes")
    if weights is not None and not isinstance(weights, tuple):
        weights = weight_arrays(weights)
    if nodes is not None and not isinstance(nodes, Trees):
        nodes = Trees([tuple(r) for r in nodes.select("tree", "node", "is_leaf", "prediction", "feature", "threshold").collect()])

    n_classes = len(bundle["classes"])

    def make(pixels):
        raw = bytes_matrix(pixels)
        if not len(raw):
            return {"scores": pa.array([], pa.list_(pa.float64())), "prediction": pa.array([], pa.int32())}
        x = raw / 255.0 if name == "pixel" else hog_batch(gray_batch(raw, h, w, raw.shape[1] // (h * w)), int(parameters.get("cell_size", 4)), int(parameters.get("block_size", 2)), int(parameters.get("num_bins", 9)))
        x = (x.astype(np.float32).astype(np.float64) - mean) / scale
        if weights is not None:
            s = x @ weights[0].T + weights[1]
            return {"scores": lists(s), "prediction": pa.array(s.argmax(axis=1), pa.int32())}
        votes = nodes.votes(x, n_classes)
        return {"scores": pa.nulls(len(x), pa.list_(pa.float64())), "prediction": pa.array(votes.argmax(axis=1), pa.int32())}

    return add_columns(images, make, ["pixels"], "scores array<double>, prediction int", drop=("pixels",))


def predict_images(images: DataFrame, bundle: dict, k: int = 3, feature: str | None = None) -> DataFrame:
    """score_images with top_k."""
    return top_k(score_images(images, bundle, feature), bundle["classes"], k)
