"""Histograms of oriented gradients and Gaussian blur, a batch of images at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from ..functions.vectors import add_columns, bytes_matrix, lists, matrix
from .preprocess import gray_batch


def cell_histograms(gray: np.ndarray, cell: int, bins: int) -> np.ndarray:
    """(rows, cells down, cells across, bins): gradient magnitudes, shared between the two nearest orientations below and above."""
    rows = len(gray)
    down, across = gray.shape[1] // cell, gray.shape[2] // cell
    g = np.pad(gray[:, : down * cell, : across * cell], ((0, 0), (1, 1), (1, 1)), mode="edge")
    gx, gy = g[:, 1:-1, 2:] - g[:, 1:-1, :-2], g[:, 2:, 1:-1] - g[:, :-2, 1:-1]
    strength = np.hypot(gx, gy)
    place = np.mod(np.degrees(np.arctan2(gy, gx)), 180.0) * (bins / 180.0)
    below = np.floor(place)
    upper = place - below
    below = below.astype(np.int64) % bins
    cells = np.arange(down * cell)[:, None] // cell * across + np.arange(across * cell)[None, :] // cell
    base = (np.arange(rows)[:, None, None] * (down * across) + cells[None]) * bins
    size = rows * down * across * bins
    out = np.bincount((base + below).ravel(), (strength * (1 - upper)).ravel(), size)
    out += np.bincount((base + (below + 1) % bins).ravel(), (strength * upper).ravel(), size)
    return out.reshape(rows, down, across, bins)


def hog_batch(gray: np.ndarray, cell: int = 4, block: int = 2, bins: int = 9, clip: float = 0.2, epsilon: float = 1e-6) -> np.ndarray:
    cells = cell_histograms(gray, cell, bins)
    if cells.shape[1] < block or cells.shape[2] < block:
        raise ValueError("the image is too small for these cells and blocks")
    v = sliding_window_view(cells, (block, block), axis=(1, 2)).transpose(0, 1, 2, 4, 5, 3)
    v = v.reshape(*v.shape[:3], -1)

    def unit(x):
        return x / np.sqrt((x * x).sum(axis=-1, keepdims=True) + epsilon**2)

    return unit(np.minimum(unit(v), clip)).reshape(len(gray), -1)


def _gray_of(df: DataFrame, h: int, w: int):
    """The column to read, and how its batches become (rows, h, w)."""
    if "gray" in df.columns:
        return "gray", lambda c: matrix(c).reshape(-1, h, w)
    return "pixels", lambda c: gray_batch(bytes_matrix(c), h, w, max(1, len(c[0].as_py()) // (h * w)) if len(c) else 1)


def hog_features(df: DataFrame, cell_size: int = 4, block_size: int = 2, num_bins: int = 9, clip: float = 0.2, epsilon: float = 1e-6, h: int = 32, w: int = 32) -> DataFrame:
    """features instead of pixels (or gray): HOG vectors, 1764 long for 32 x 32 images and the defaults."""
    column, gray = _gray_of(df, h, w)
    make = lambda c: {"features": lists(hog_batch(gray(c), cell_size, block_size, num_bins, clip, epsilon).astype(np.float32), pa.float32())}
    return add_columns(df, make, [column], "features array<float>", drop=(column,))


def hog_cells(df: DataFrame, cell_size: int = 4, num_bins: int = 9, h: int = 32, w: int = 32) -> DataFrame:
    """(image_id, cy, cx, bin, value): the histogram of every cell."""
    column, gray = _gray_of(df, h, w)

    def run(batches):
        for b in batches:
            c = cell_histograms(gray(b.column(column)), cell_size, num_bins)
            n, down, across, bins = c.shape
            at = np.indices((n, down, across, bins)).reshape(4, -1)
            ids = b.column("image_id").take(pa.array(at[0]))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(a, pa.int32()) for a in at[1:]], pa.array(c.reshape(-1))], names=["image_id", "cy", "cx", "bin", "value"])

    return df.select("image_id", column).mapInArrow(run, "image_id long, cy int, cx int, bin int, value double")


def blur_kernel(sigma: float) -> np.ndarray:
    radius = max(1, round(3 * sigma))
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    return k / k.sum()


def blur_batch(x: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur of (rows, h, w), across and then down; borders mirror without repeating the edge."""
    k = blur_kernel(sigma).astype(x.dtype)
    r = len(k) // 2
    for axis in (2, 1):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        p = np.pad(x, pad, mode="reflect")
        n = x.shape[axis]
        x = sum(weight * p.take(range(i, i + n), axis=axis) for i, weight in enumerate(k))
    return x


def gaussian_blur(df: DataFrame, sigma: float, h: int, w: int) -> DataFrame:
    """gray blurred."""
    return add_columns(df, lambda c: {"gray": lists(blur_batch(matrix(c).reshape(-1, h, w), sigma).reshape(len(c), -1))}, ["gray"], "gray array<double>")
