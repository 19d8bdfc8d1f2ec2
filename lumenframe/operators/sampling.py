"""Splits and samples. All draws are orders on md5 of seed and id, so they hold on any partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.draws import draw_int, first_by_key, half_even, ranked
from ..sources.artifacts import written

#: Rows of a cell and cells of a group, where draws are split.
CELL = 4096
BOOTS = StructType([StructField("tree", IntegerType()), StructField("weight", IntegerType())])


def stratified_split(df: DataFrame, label: str, id_: str, fraction: float = 0.1, seed: int = 42, min_per_class: int = 1) -> DataFrame:
    """Adds split: of each label max(min_per_class, round(n * fraction)) rows are ``validation``, the rest ``train``."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    narrow = ranked(df.select(id_, label), label, id_, seed)
    count = F.greatest(half_even(F.col("_n") * F.lit(fraction)), F.lit(min_per_class))
    split = narrow.select(id_, F.when(F.col("_rank") <= count, "validation").otherwise("train").alias("split"))
    return df.join(split, id_)


def limit_stratified(df: DataFrame, label: str, id_: str, limit: int | None, seed: int = 42) -> DataFrame:
    """Rows in proportion to the labels, at least one of each; a second draw cuts to ``limit`` if there are more."""
    if limit is None:
        return df
    total = df.count()
    if limit >= total:
        return df
    r = ranked(df.select(id_, label), label, id_, seed)
    quota = F.greatest(half_even(F.lit(limit) * F.col("_n") / F.lit(total)), F.lit(1))
    chosen = r.where(F.col("_rank") <= quota).select(id_)
    return df.join(first_by_key(chosen, id_, f"{seed}:cut", limit), id_, "left_semi")


def limit_splits(df: DataFrame, label: str, id_: str, train_limit: int | None, test_limit: int | None, seed: int = 42) -> DataFrame:
    """limit_stratified of each split: seeds seed, seed + 1, seed + 2; validation gets max(10, train_limit // 9)."""
    validation = None if train_limit is None else max(10, train_limit // 9)
    parts = [limit_stratified(df.where(F.col("split") == name), label, id_, limit, seed + i) for i, (name, limit) in enumerate([("train", train_limit), ("validation", validation), ("test", test_limit)])]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def balanced_limit(df: DataFrame, label: str, id_: str, limit: int, seed: int = 42, n_classes: int = 10) -> DataFrame:
    """limit // n_classes rows of each label, one more of the first limit % n_classes labels."""
    if limit < n_classes:
        raise ValueError("limit must hold one row of each class")
    quota = F.lit(limit // n_classes) + F.when(F.col(label) < limit % n_classes, 1).otherwise(0)
    short = df.groupBy(label).count().where(F.col("count") < quota)
    if df.select(label).distinct().where(F.col(label).between(0, n_classes - 1)).count() < n_classes or not short.isEmpty():
        raise ValueError("a class has fewer rows than its share")
    r = ranked(df.select(id_, label), label, id_, seed)
    return df.join(r.where(F.col("_rank") <= quota).select(id_), id_, "left_semi")


def sample_per_class(df: DataFrame, classes: DataFrame, label: str = "label", id_: str = "image_id", n: int = 1, seed: int = 42) -> DataFrame:
    """n rows of each class by draw: id, label, class_name and the file name class_00000.png."""
    if n < 1:
        raise ValueError("n must be at least 1")
    counts = classes.join(df.groupBy(label).count(), label, "left").where(F.coalesce(F.col("count"), F.lit(0)) < n)
    if not counts.isEmpty():
        raise ValueError("a class has fewer than n rows")
    r = ranked(df.select(id_, label), label, id_, seed).where(F.col("_rank") <= n)
    return r.join(classes, label).select(id_, label, "class_name", F.format_string("%s_%05d.png", "class_name", id_).alias("file_name")).orderBy(id_)


def first_per_class(df: DataFrame, label: str = "label", id_: str = "image_id") -> DataFrame:
    return df.groupBy(label).agg(F.min(id_).alias(id_))


class Splits:
    """How often each of ``trees`` trees draws each of ``n`` rows in ``draws`` draws with replacement.

    The draws of a tree are split between groups of cells by a multinomial draw, those of a group between its cells, those of
    a cell between its rows. Every split is a function of seed, tree and place alone: any task works out the cells it
    needs by itself, and all tasks agree.
    """

    def __init__(self, n: int, draws: int, trees: int, seed: int):
        self.n, self.trees, self.seed = n, trees, seed
        self.group_counts = self._split([draws] * trees, 0, 0, n, CELL * CELL)
        self.group, self.cell_counts = -1, None

    def _random(self, level: int, tree: int, place: int) -> np.random.Generator:
        return np.random.default_rng([self.seed % (1 << 63), level, tree, place])

    def _split(self, counts, level: int, place: int, rows: int, size: int) -> np.ndarray:
        """(trees, parts): counts dealt over the parts of ``rows`` rows, ``size`` rows a part and the rest in the last."""
        sizes = np.full(-(-rows // size), size, dtype=np.float64)
        sizes[-1] = rows - size * (len(sizes) - 1)
        return np.stack([self._random(level, tree, place).multinomial(c, sizes / rows) for tree, c in enumerate(counts)])

    def cell(self, c: int) -> np.ndarray:
        """(trees, rows of cell c): draws of each row."""
        g = c // CELL
        if g != self.group:
            first = g * CELL * CELL
            self.group, self.cell_counts = g, self._split(self.group_counts[:, g], 1, g, min(CELL * CELL, self.n - first), CELL)
        rows = min(CELL, self.n - c * CELL)
        own = self.cell_counts[:, c - g * CELL]
        return np.stack([np.bincount(self._random(2, tree, c).integers(0, rows, k), minlength=rows) for tree, k in enumerate(own)])


def bootstrap_counts(df: DataFrame, id_: str, n_trees: int, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """(id, boots): the trees that draw a row and how often, max(2, round(n * fraction)) draws a tree with replacement.

    Rows are numbered in the order of their ids; then each task splits the draws down to its own rows (Splits). No draw
    passes a shuffle. A row that no tree draws has an empty list; rows of equal ids are drawn one by one.
    """
    rows = dense_index(df.select(id_), id_)
    n = rows.count()
    draws = max(2, round(n * fraction))
    out = StructType([df.schema[id_], StructField("boots", ArrayType(BOOTS))])

    def run(batches):
        splits = Splits(n, draws, n_trees, seed) if n else None
        at, last = -1, None
        for b in batches:
            row = b.column("row").to_numpy()
            drawn = np.zeros((len(row), n_trees), np.int32)
            for c in np.unique(row // CELL):
                if c != at:
                    at, last = c, splits.cell(int(c))
                here = row // CELL == c
                drawn[here] = last[:, row[here] - c * CELL].T
            i, tree = np.nonzero(drawn)
            ends = np.concatenate([[0], np.cumsum((drawn > 0).sum(axis=1))]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(tree, pa.int32()), pa.array(drawn[i, tree], pa.int32())], names=["tree", "weight"])
            yield pa.RecordBatch.from_arrays([b.column(id_), pa.ListArray.from_arrays(pa.array(ends), pairs)], names=[id_, "boots"])

    return rows.select(id_, "row").mapInArrow(run, out)


def bootstrap_weights(df: DataFrame, id_: str, n_trees: int, fraction: float = 1.0, seed: int = 42, mode: str = "exact") -> DataFrame:
    """(tree, id, weight): how often each tree draws each row.

    split: max(2, round(n * fraction)) draws a tree with replacement, without a shuffle of draws (bootstrap_counts); for
    large tables. exact: as many, every draw by its own number, the same in SQL; trees x draws rows are shuffled. poisson:
    each row's weight by itself from a Poisson draw, so a tree's total is not fixed.
    """
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree")
    if mode == "split":
        drawn = bootstrap_counts(df, id_, n_trees, fraction, seed)
        return drawn.select(id_, F.explode("boots").alias("b")).select("b.tree", id_, F.col("b.weight").cast("long").alias("weight"))
    if mode == "poisson":
        u = draw_int(seed, "tree", id_) / F.lit(float(1 << 52))
        edges, p, total = [], 2.718281828459045 ** -fraction, 0.0
        for k in range(12):
            total += p
            edges.append(total)
            p = p * fraction / (k + 1)
        weight = sum((F.when(F.col("_u") >= e, 1).otherwise(0) for e in edges), F.lit(0))
        return df.select(id_, trees).withColumn("_u", u).select("tree", id_, weight.cast("long").alias("weight")).where("weight > 0")
    n = df.count()
    if n == 0:
        return df.select(F.lit(0).alias("tree"), id_, F.lit(0).cast("long").alias("weight")).limit(0)
    draws = max(2, round(n * fraction))
    spark = df.sparkSession
    drawn = spark.range(n_trees * draws).select((F.col("id") / draws).cast("int").alias("tree"), (F.col("id") % draws).alias("draw"))
    hits = drawn.select("tree", (draw_int(seed, "tree", "draw") % n).alias("row")).groupBy("tree", "row").agg(F.count("*").alias("weight"))
    return hits.join(dense_index(df.select(id_), id_), "row").select("tree", id_, "weight")


def dense_index(df: DataFrame, id_: str) -> DataFrame:
    """Adds row: 0, 1, 2 ... in the order of id_, by a range partitioning, written once, and the counts of its partitions."""
    spread = written(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = spread.groupBy("_p").agg(F.count("*").alias("_c"), F.min(id_).alias("_lo"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).select("_p", "_before")
    nth = F.row_number().over(Window.partitionBy("_p").orderBy(id_)) - 1
    return spread.withColumn("_nth", nth).join(before, "_p").withColumn("row", (F.col("_before") + F.col("_nth")).cast("long")).drop("_p", "_nth", "_before")


def split_digest(df: DataFrame, id_: str = "image_id", bucket_rows: int = 100_000) -> DataFrame:
    """(split, digest) and a row ``all``: equal if and only if the splits hold the same ids.

    Two levels: the sorted ids of a bucket are digested where they meet, then the digests of the buckets. There are 64
    buckets, or as many (a power of two) as hold ``bucket_rows`` ids each.
    """
    buckets = max(64, 1 << (df.count() // bucket_rows).bit_length())
    own = df.groupBy("split", (F.pmod(F.col(id_), F.lit(buckets))).alias("bucket")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(id_)), lambda x: x.cast("string")), ","), 256).alias("d"))
    per = own.groupBy("split").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), ","), 256).alias("digest"))
    total = per.groupBy().agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "digest"))), lambda x: F.concat_ws("=", x["split"], x["digest"])), ","), 256).alias("digest"))
    return per.unionByName(total.select(F.lit("all").alias("split"), "digest"))


def select_indices(df: DataFrame, ids: list[int], id_: str = "image_id") -> DataFrame:
    """The rows with these ids; an id without a row is an error."""
    wanted = df.sparkSession.createDataFrame([(int(i),) for i in ids], f"{id_} long")
    missing = wanted.join(df.select(id_), id_, "left_anti")
    if not missing.isEmpty():
        raise ValueError("an index has no row")
    return df.join(F.broadcast(wanted.distinct()), id_, "left_semi")


def split_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """(split, label, n): per class and split, per split (label null) and in all (both null)."""
    return df.rollup("split", label).agg(F.count("*").alias("n"))
