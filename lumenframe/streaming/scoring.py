"""Scoring of arriving images."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.inference import predict_images


def score_stream(images: DataFrame, bundle: dict, path: str, checkpoint: str, k: int = 3):
    """Starts a query that appends records of arriving images (image_id, pixels) as Parquet; exactly once by its checkpoint."""
    scored = predict_images(images, bundle, k)
    return scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
