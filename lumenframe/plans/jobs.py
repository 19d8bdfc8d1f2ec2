"""The workloads as composed jobs: extract, train, evaluate, evidence, sample, infer."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codebook, evidence, forest, hog, inference, metrics, preprocess, sampling, sift, svm
from ..sources import artifacts, images as sources


def split_images(images: DataFrame, fraction: float = 0.1, train_limit: int | None = None, test_limit: int | None = None, seed: int = 42) -> DataFrame:
    """Images (split train or test) with a validation part split off and limits applied; only ids and labels are shuffled
    to choose, pixels once to follow."""
    narrow = images.select("image_id", "label", "split")
    drawn = sampling.stratified_split(narrow.where("split = 'train'").drop("split"), "label", "image_id", fraction, seed)
    chosen = sampling.limit_splits(drawn.select("image_id", "label", "split").unionByName(narrow.where("split = 'test'")), "label", "image_id", train_limit, test_limit, seed)
    return images.drop("split").join(chosen.select("image_id", "split"), "image_id")


def extract(images: DataFrame, feature: str, parameters: dict | None = None, codebook_size: int = 128) -> DataFrame:
    """image_id, split, label, features of pixel, hog, sift or sift_bovw."""
    p = parameters or {}
    if feature == "pixel":
        out = preprocess.pixel_features(images)
    elif feature == "hog":
        out = hog.hog_features(images, **p)
    elif feature in ("sift", "sift_bovw"):
        k = sift.sift_keypoints(images, **p)
        if feature == "sift":
            vectors = sift.flatten_descriptors(k, images)
        else:
            train = k.join(images.where("split = 'train'").select("image_id"), "image_id", "left_semi")
            vectors = codebook.bovw_transform(k, images, codebook.bovw_fit(train, codebook_size))
        out = images.drop("pixels").join(vectors, "image_id")
    else:
        raise ValueError(f"unknown feature {feature}")
    return out.select("image_id", "split", "label", "features")


def extract_archive(images: DataFrame, path: str, feature: str, parameters: dict | None = None, **limits) -> None:
    began = time.perf_counter()
    rows = extract(split_images(images, **limits), feature, parameters)
    artifacts.write_features(rows, path, {"feature": feature, "parameters": parameters, "seconds": time.perf_counter() - began})


def train_svm(train: DataFrame, classes: list[str], feature: str, parameters: dict | None = None, **fit) -> dict:
    """A bundle: scaler and SVM of the training rows (features, label), class names, feature and its parameters."""
    scaler = preprocess.fit_scaler(train)
    scaled = preprocess.apply_scaler(train, scaler).persist()
    try:
        weights, history = svm.svm_fit(scaled, **fit)
    finally:
        scaled.unpersist()
    return {"feature": feature, "parameters": parameters or {}, "classes": classes, "scaler": scaler, "weights": weights, "history": history}


def train_forest(train: DataFrame, classes: list[str], feature: str, parameters: dict | None = None, **fit) -> dict:
    scaler = preprocess.fit_scaler(train)
    return {"feature": feature, "parameters": parameters or {}, "classes": classes, "scaler": scaler, "nodes": forest.forest_fit(preprocess.apply_scaler(train, scaler), **fit)}


def predict(features: DataFrame, bundle: dict) -> DataFrame:
    """Features with scores (SVM) and prediction."""
    scaled = preprocess.apply_scaler(features, bundle["scaler"])
    return svm.svm_scores(scaled, bundle["weights"]) if "weights" in bundle else forest.forest_predict(scaled, bundle["nodes"])


def evaluate(features: DataFrame, bundle: dict, split: str = "test") -> DataFrame:
    return metrics.classification_summary(predict(features.where(F.col("split") == split), bundle), len(bundle["classes"]))


def train_and_report(features: DataFrame, bundle: dict, path: str) -> DataFrame:
    """Saves the bundle and the test predictions; metrics by split."""
    artifacts.save_bundle(f"{path}/model", bundle["scaler"], bundle["classes"], bundle["feature"], bundle["parameters"], bundle.get("weights"), bundle.get("nodes"))
    scored = predict(features.where("split != 'train'"), bundle)
    artifacts.write_predictions(scored.where("split = 'test'"), f"{path}/predictions")
    report = metrics.summary_by(scored, ["split"], len(bundle["classes"]))
    artifacts.write_records_json(report, f"{path}/metrics")
    return report


def error_evidence(spark: SparkSession, predictions_path: str, classes: list[str]) -> dict[str, DataFrame]:
    """Summary, top confusions, gallery and margin histogram of stored predictions."""
    p = spark.read.parquet(predictions_path)
    names = sources.class_table(spark, classes)
    return {"summary": evidence.evidence_summary(p), "top_confusions": evidence.top_confusions(p, names, len(classes)), "gallery": evidence.gallery(p), "margins": evidence.margin_histogram(p)}


def infer_files(spark: SparkSession, path: str, bundle: dict, manifest: str | None = None, k: int = 3) -> DataFrame:
    """Records for image files: prediction, top k, actual label by file name."""
    scored = inference.predict_images(sources.read_images(spark, path), bundle, k)
    actual = inference.attach_actual(scored, sources.read_manifest(spark, manifest) if manifest else None)
    return inference.prediction_records(actual.withColumn("source", F.col("path")), sources.class_table(spark, bundle["classes"]))
