"""Features, predictions, model bundles and records on disk: Parquet tables and JSON."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_RECORD = "run string, feature string, model string, seed int, samples struct<train: long, validation: long, test: long>, parameters map<string, string>, seconds struct<extraction: double, training: double, inference: double>, validation struct<accuracy: double, macro_f1: double>, test struct<accuracy: double, macro_precision: double, macro_recall: double, macro_f1: double, confusion_matrix: array<array<long>>>"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir. In local mode one of our own where it is unset."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if top is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df from files in the shared folder: later stages see the same rows in the same partitions, whatever is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_runs(spark: SparkSession, paths) -> DataFrame:
    """Metric records from JSON files, with an explicit schema."""
    return spark.read.schema(RUN_RECORD).json(paths, multiLine=True)


def write_features(df: DataFrame, path: str, meta: dict) -> None:
    """Features by split, and what they are: name, parameters, seconds."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    row = [(meta.get("feature"), json.dumps(meta.get("parameters") or {}), float(meta.get("seconds") or 0.0))]
    df.sparkSession.createDataFrame(row, "feature string, parameters string, seconds double").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    m = spark.read.parquet(f"{path}/meta").first()
    return spark.read.parquet(f"{path}/rows"), {"feature": m["feature"], "parameters": json.loads(m["parameters"]), "seconds": m["seconds"]}


def predictions(df: DataFrame) -> DataFrame:
    """image_id (-1 where it is not known), label, prediction, scores."""
    image_id = F.coalesce(F.col("image_id"), F.lit(-1)) if "image_id" in df.columns else F.lit(-1)
    scores = F.col("scores") if "scores" in df.columns else F.lit(None).cast("array<double>")
    return df.select(image_id.cast("long").alias("image_id"), "label", "prediction", scores.alias("scores"))


def write_predictions(df: DataFrame, path: str) -> None:
    predictions(df).write.mode("overwrite").parquet(path)


def save_bundle(path: str, scaler: DataFrame, classes: list[str], feature: str, parameters: dict | None = None, weights: DataFrame | None = None, nodes: DataFrame | None = None) -> None:
    """Model, scaler, class names, feature name and its parameters, all together."""
    spark = scaler.sparkSession
    scaler.coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")
    kind = "svm" if weights is not None else "forest"
    (weights if weights is not None else nodes).coalesce(1).write.mode("overwrite").parquet(f"{path}/{kind}")
    spark.createDataFrame([(feature, json.dumps(parameters or {}), kind, classes)], "feature string, parameters string, kind string, classes array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> dict:
    m = spark.read.parquet(f"{path}/meta").first()
    out = {"feature": m["feature"], "parameters": json.loads(m["parameters"]), "classes": list(m["classes"]), "scaler": spark.read.parquet(f"{path}/scaler")}
    return out | {"weights" if m["kind"] == "svm" else "nodes": spark.read.parquet(f"{path}/{m['kind']}")}


def write_records_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
