"""Pixels to floats, gray and scaled features, with statistics of the training rows only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import add_columns, binaries, bytes_matrix, lists, matrix

GRAY = np.array([0.299, 0.587, 0.114])
#: Each byte over 255.
UNIT = (np.arange(256) / 255.0).astype(np.float32)


def planar_to_hwc(df: DataFrame, h: int = 32, w: int = 32, c: int = 3) -> DataFrame:
    """pixels from planes (channel, row, column) to (row, column, channel)."""

    def make(pixels):
        p = bytes_matrix(pixels).reshape(-1, c, h, w).transpose(0, 2, 3, 1).reshape(len(pixels), -1)
        return {"pixels": binaries(p)}

    return add_columns(df, make, ["pixels"], "pixels binary")


def gray_batch(pixels: np.ndarray, h: int, w: int, c: int) -> np.ndarray:
    """(rows, h, w) from bytes in (row, column, channel) order; one channel is gray already."""
    x = pixels.reshape(-1, h, w, c) / 255.0
    if c == 1:
        return x[..., 0]
    if c != 3:
        raise ValueError("three channels are needed")
    return x @ GRAY


def to_float(df: DataFrame, column: str = "pixels") -> DataFrame:
    """Adds features: bytes over 255; an array column is cast alone."""
    if dict(df.dtypes)[column] != "binary":
        return df.withColumn("features", F.col(column).cast("array<float>"))
    return add_columns(df, lambda p: {"features": lists(UNIT[bytes_matrix(p)], pa.float32())}, [column], "features array<float>")


def pixel_features(df: DataFrame) -> DataFrame:
    """features: all bytes of the image over 255, in stored order."""
    return to_float(df).drop("pixels")


def rgb_to_gray(df: DataFrame, h: int = 32, w: int = 32) -> DataFrame:
    """Adds gray, row by row."""

    def make(pixels):
        raw = bytes_matrix(pixels)
        c = raw.shape[1] // (h * w) if raw.size else 3
        if raw.size and (c != 3 or raw.shape[1] != 3 * h * w):
            raise ValueError("three channels are needed")
        return {"gray": lists(gray_batch(raw, h, w, 3).reshape(len(raw), -1).astype(np.float32), pa.float32())}

    return add_columns(df, make, ["pixels"], "gray array<float>")


def channel_stats(df: DataFrame, channels: int = 3) -> DataFrame:
    """(channel, mean, std) of pixel / 255 over the rows given: exact integer sums a batch, std at least 1e-6."""

    def run(batches):
        for b in batches:
            x = bytes_matrix(b.column("pixels")).reshape(-1, channels).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range(channels), pa.int32()), pa.array([len(x)] * channels, pa.int64()), pa.array(x.sum(axis=0)), pa.array((x * x).sum(axis=0))], names=["channel", "n", "s", "ss"])

    sums = df.select("pixels").mapInArrow(run, "channel int, n long, s long, ss long").groupBy("channel").agg(*[F.sum(c).cast("double").alias(c) for c in ("n", "s", "ss")])
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))) / 255
    return sums.select("channel", (mean / 255).alias("mean"), F.greatest(std, F.lit(1e-6)).alias("std"))


def normalize_channels(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds features: (pixel / 255 - mean) / std of its channel, with frozen statistics (one row a channel)."""
    rows = sorted((r["channel"], r["mean"], r["std"]) for r in stats.collect())
    mean, std = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def make(pixels):
        raw = bytes_matrix(pixels)
        x = (raw.reshape(-1, len(mean)) / 255.0 - mean) / std
        return {"features": lists(x.reshape(len(raw), -1).astype(np.float32), pa.float32())}

    return add_columns(df, make, ["pixels"], "features array<float>")


def fit_scaler(df: DataFrame, epsilon: float = 1e-8) -> DataFrame:
    """(dim, mean, scale): mean and population deviation a dimension; a deviation under epsilon scales by 1.

    Each task sends one count, mean and sum of squares a dimension, so nothing is exploded to rows x dimensions.
    """

    def run(batches):
        n, mean, m2 = 0, None, None
        for b in batches:
            x = matrix(b.column("features"))
            if not len(x):
                continue
            bm, bm2 = x.mean(axis=0), ((x - x.mean(axis=0)) ** 2).sum(axis=0)
            if mean is None:
                n, mean, m2 = len(x), bm, bm2
                continue
            delta, total = bm - mean, n + len(x)
            m2 = m2 + bm2 + delta**2 * n * len(x) / total
            mean, n = mean + delta * len(x) / total, total
        if mean is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(mean)), pa.int32()), pa.array([float(n)] * len(mean)), pa.array(mean), pa.array(m2)], names=["dim", "n", "m", "m2"])

    part = df.select("features").mapInArrow(run, "dim int, n double, m double, m2 double")
    total = part.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum("m2").alias("m2"))
    mean = F.col("nm") / F.col("n")
    std = F.sqrt(F.greatest((F.col("m2") + F.col("nmm") - F.col("n") * mean * mean) / F.col("n"), F.lit(0.0)))
    return total.select("dim", mean.alias("mean"), F.when(std < epsilon, 1.0).otherwise(std).alias("scale"))


def scaler_arrays(scaler: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted((r["dim"], r["mean"], r["scale"]) for r in scaler.collect())
    if not rows:
        raise RuntimeError("the scaler is not fitted")
    return np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def apply_scaler(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """features standardised with a fitted scaler (one row a dimension)."""
    mean, scale = scaler_arrays(scaler)
    return add_columns(df, lambda f: {"features": lists(((matrix(f) - mean) / scale).astype(np.float32), pa.float32())}, ["features"], "features array<float>")
