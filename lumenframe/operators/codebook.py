"""K-means by partial sums and bags of visual words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import first_by_key, order_key
from ..functions.vectors import add_columns, lists, matrix, sum_arrays


def center_matrix(centers: DataFrame) -> np.ndarray:
    """Centres (cluster, center) as a matrix: k x dimensions, the size of a model."""
    return np.array([r["center"] for r in sorted(centers.collect(), key=lambda r: r["cluster"])], dtype=np.float64)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre (the first of equals) and the squared distance, at least 0."""
    d = np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T), 0)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def assign_clusters(df: DataFrame, centers: DataFrame | np.ndarray, column: str = "descriptor") -> DataFrame:
    """Adds cluster and distance."""
    c = centers if isinstance(centers, np.ndarray) else center_matrix(centers)

    def make(v):
        at, d = nearest(matrix(v), c) if len(v) else (np.zeros(0, int), np.zeros(0))
        return {"cluster": pa.array(at, pa.int32()), "distance": pa.array(d, pa.float64())}

    return add_columns(df, make, [column], "cluster int, distance double")


def _as_rows(spark, c: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(c)], "cluster int, center array<double>")


def _step(df: DataFrame, c: np.ndarray, column: str, id_: str, seed) -> np.ndarray:
    """Means of the members of each centre; an empty one moves to a drawn row."""
    k, d = c.shape

    def run(batches):
        sums, n = np.zeros((k, d)), np.zeros(k)
        for b in batches:
            x = matrix(b.column(column))
            if len(x):
                at, _ = nearest(x, c)
                n += np.bincount(at, minlength=k)
                for j in range(d):
                    sums[:, j] += np.bincount(at, x[:, j], k)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own]), lists(sums[own])], names=["cluster", "n", "sums"])

    partial = df.select(column).mapInArrow(run, "cluster int, n double, sums array<double>")
    new, empty = c.copy(), np.ones(k, dtype=bool)
    for r in sum_arrays(partial, ["cluster"], "cluster int, n double, sums array<double>").collect():
        new[r["cluster"]] = np.array(r["sums"]) / r["n"]
        empty[r["cluster"]] = False
    if empty.any():
        drawn = df.orderBy(order_key(seed, id_), id_).limit(int(empty.sum())).select(column).collect()
        for i, r in zip(np.flatnonzero(empty), drawn):
            new[i] = r[0]
    return new


def kmeans_step(df: DataFrame, centers: DataFrame, column: str = "descriptor", id_: str = "image_id", seed: int = 42) -> DataFrame:
    """One Lloyd update: (cluster, center)."""
    return _as_rows(df.sparkSession, _step(df, center_matrix(centers), column, id_, seed))


def kmeans_fit(df: DataFrame, k: int = 128, max_iter: int = 50, tol: float = 1e-4, seed: int = 42, column: str = "descriptor", id_: str = "image_id", engine: str = "lloyd") -> DataFrame:
    """(cluster, center). lloyd: k drawn rows, then updates until all centres together move at most tol. ml: Spark ML's KMeans."""
    if engine == "ml":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        model = KMeans(k=k, maxIter=max_iter, tol=tol, seed=seed, featuresCol="v").fit(df.select(array_to_vector(F.col(column).cast("array<double>")).alias("v")))
        return _as_rows(df.sparkSession, np.array(model.clusterCenters()))
    start = df.orderBy(order_key(seed, id_), id_).limit(k).select(column).collect()
    if len(start) < k:
        raise ValueError("there must be at least as many rows as clusters")
    c = np.array([r[0] for r in start], dtype=np.float64)
    for i in range(max_iter):
        new = _step(df, c, column, id_, f"{seed}:{i}")
        shift = float(np.linalg.norm(new - c))
        c = new
        if shift <= tol:
            break
    return _as_rows(df.sparkSession, c)


def bovw_fit(keypoints: DataFrame, k: int = 128, max_descriptors: int | None = 50_000, seed: int = 42, **kmeans) -> DataFrame:
    """A codebook from the descriptors of training images: of all for None, else a draw of max_descriptors where there are more."""
    keyed = keypoints.select(F.concat_ws("/", "image_id", "rank").alias("image_id"), "descriptor")
    pool = keyed if max_descriptors is None else first_by_key(keyed, "image_id", f"{seed}:pool", max_descriptors)
    pool = pool.persist()
    try:
        if pool.isEmpty():
            raise ValueError("there are no descriptors")
        return kmeans_fit(pool, k, seed=seed, **kmeans)
    finally:
        pool.unpersist()


def bovw_transform(keypoints: DataFrame, images: DataFrame, centers: DataFrame | np.ndarray) -> DataFrame:
    """(image_id, features): counts of words of each image over their length plus 1e-8; zeros without descriptors."""
    c = centers if isinstance(centers, np.ndarray) else center_matrix(centers)
    words = assign_clusters(keypoints.select("image_id", "descriptor"), c).groupBy("image_id", "cluster").agg(F.count("*").alias("n"))
    counts = words.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("cluster", F.col("n").cast("double")))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    size = F.sequence(F.lit(0), F.lit(len(c) - 1))
    value = F.transform(size, lambda i: (F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)) / (F.coalesce("norm", F.lit(0.0)) + 1e-8)).cast("float"))
    return images.select("image_id").join(counts, "image_id", "left").select("image_id", value.alias("features"))
