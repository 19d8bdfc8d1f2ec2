"""Image sources: batches of planar records, class names, image files, checksums, manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import binaries, bytes_matrix
from ..operators.preprocess import planar_to_hwc  # noqa: F401  the planar source's second half
from .artifacts import scratch_path

MANIFEST = "images map<string, struct<label: int, class_name: string, test_index: long>>"


def union_batches(train: list[DataFrame], test: DataFrame) -> DataFrame:
    """image_id, split, label, pixels of batches (position, label, raw): train batches in order, the test part by itself.

    A row's id is its position after all batches before it, so ids need one count a batch and no sort.
    """
    parts, offset = [], 0
    for batch in train:
        parts.append(batch.select((F.col("position") + offset).alias("image_id"), F.lit("train").alias("split"), "label", F.col("raw").alias("pixels")))
        offset += batch.count()
    parts.append(test.select(F.col("position").alias("image_id"), F.lit("test").alias("split"), "label", F.col("raw").alias("pixels")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_table(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "label int, class_name string")


def with_class_name(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds class_name; null for a label without a name. Class names are as few as a model's classes."""
    few = classes.limit(100_001).count() <= 100_000
    return df.join(F.broadcast(classes) if few else classes, "label", "left")


def resize_weights(size: int, target: int) -> np.ndarray:
    """(target, size) weights of a triangle filter, widened when shrinking, as whole numbers: 2 max(size, target) less the
    distance of both middles, counted in halves of 1 / (size * target) of the whole."""
    middle = np.arange(max(size, target)) * 2 + 1
    away = np.abs(target * middle[None, :size] - size * middle[:target, None])
    return np.maximum(0, 2 * max(size, target) - away)


#: Numbers that a resize holds at once.
RESIZE_AT_ONCE = 1 << 22


def resize(images: np.ndarray, size: int) -> np.ndarray:
    """(n, size, size, channels) bytes of n images of one shape: across first, then down, rounded to bytes after each, halves
    up. Sums are of whole numbers, so results don't depend on the order of adding."""
    n, h, w, channels = images.shape
    across, down = (resize_weights(k, size).astype(np.float64) for k in (w, h))
    # floor((2 s + t) / 2 t) is s / t rounded
    to_byte = lambda s, weights: np.floor((2 * s + weights.sum(axis=1)[:, None]) / (2 * weights.sum(axis=1)[:, None]))
    out = np.empty((n, size, size, channels), np.uint8)
    step = max(1, RESIZE_AT_ONCE // (h * w * channels))
    for at in range(0, n, step):
        some = images[at : at + step].astype(np.float64)
        rows = to_byte(np.matmul(across, some), across)
        done = to_byte(np.matmul(down, rows.reshape(len(some), h, -1)), down)
        out[at : at + step] = done.reshape(len(some), size, size, channels)
    return out


def read_images(spark: SparkSession, path: str, size: int = 32, tasks: int | None = None) -> DataFrame:
    """path, height, width, channels, pixels: image files as RGB of size x size. Gray becomes three equal channels, alpha is
    left out, and so is a file that is no image. Images of one shape in a batch are resized together. tasks: so many at most.
    The driver holds a list of all files: read_image_folders is for more than it can hold."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path)
    raw = raw if tasks is None else raw.coalesce(tasks)
    raw = raw.select(F.col("image.origin").alias("path"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("data"))

    def run(batches):
        for b in batches:
            n, shapes = b.num_rows, {}
            for i, shape in enumerate(zip(*(b.column(k).to_pylist() for k in ("h", "w", "c")))):
                shapes.setdefault(shape, []).append(i)
            pixels = np.empty((n, size * size * 3), np.uint8)
            for (h, w, c), at in shapes.items():
                x = bytes_matrix(b.column("data").take(pa.array(at))).reshape(-1, h, w, c)
                x = np.repeat(x, 3, axis=3) if c == 1 else x[..., 2::-1]
                pixels[at] = resize(x, size).reshape(len(at), -1)
            yield pa.RecordBatch.from_arrays([b.column("path"), *[pa.array([v] * n, pa.int32()) for v in (size, size, 3)], binaries(pixels)], names=["path", "height", "width", "channels", "pixels"])

    return raw.mapInArrow(run, "path string, height int, width int, channels int, pixels binary")


#: Files of a folder of images, about: Spark's driver lists a folder's files and holds the list while it is read.
FILES_AT_ONCE = 5_000
#: Tasks that read a folder, at most: by itself Spark gives a task as few files as if each had 4 MB.
FOLDER_TASKS = 24


def folders_for(n: int) -> int:
    """Over how many folders n files are dealt."""
    return max(1, -(-n // FILES_AT_ONCE))


def read_image_folders(spark: SparkSession, folders: Iterable[str], make: Callable[[DataFrame], DataFrame], size: int = 32) -> DataFrame:
    """make (a map job) of read_images of every folder, one after the other, so that the driver holds one folder's list at a
    time; what is made of them is written to the shared folder. A folder is listed by few tasks, too: by itself Spark takes one
    for each folder in it, and the driver keeps records of all."""
    path, made = scratch_path(spark, "read-images"), None
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(FOLDER_TASKS))
    try:
        for folder in folders:
            made = make(read_images(spark, folder, size, FOLDER_TASKS))
            made.write.mode("append").parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    if made is None:
        raise ValueError("there are no folders")
    return spark.read.schema(made.schema).parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file under path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def checksums(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, md5, ok) of files (path, content) against expected (path, md5); no expectation is not ok."""
    own = files.select("path", F.md5("content").alias("md5"))
    want = expected.select("path", F.col("md5").alias("want"))
    return own.join(want, "path", "left").select("path", "md5", F.coalesce(F.col("md5") == F.col("want"), F.lit(False)).alias("ok"))


def verify_checksums(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """checksums of the files under path; any that fails is an error."""
    found = checksums(read_files(spark, path), expected)
    if not found.where(~F.col("ok")).isEmpty():
        raise ValueError("a file does not have its checksum")
    return found


def manifest_rows(texts: DataFrame) -> DataFrame:
    """(file_name, label, class_name, test_index) from manifests as JSON texts (value)."""
    entries = F.explode(F.from_json("value", MANIFEST)["images"]).alias("file_name", "r")
    return texts.select(entries).select("file_name", "r.label", "r.class_name", "r.test_index")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_rows(spark.read.text(path, wholetext=True))


def write_manifest(df: DataFrame, path: str) -> None:
    """One JSON object for all rows: a manifest lists a sample, a few files a class."""
    entry = F.struct("file_name", F.struct(F.col("label").cast("int").alias("label"), "class_name", F.col("test_index").cast("long").alias("test_index")))
    whole = df.groupBy().agg(F.to_json(F.struct(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("images"))).alias("value"))
    whole.write.mode("overwrite").text(path)
