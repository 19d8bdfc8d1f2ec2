"""Draws that do not depend on partitioning: orders and numbers from md5 of a seed and an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _text(seed, parts) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


def order_key(seed, *parts) -> Column:
    """A text whose order is a random order of the rows, the same on any number of partitions."""
    return F.md5(_text(seed, parts))


def draw_int(seed, *parts) -> Column:
    """A whole number under 2 ** 52."""
    return F.conv(F.substring(F.md5(_text(seed, parts)), 1, 13), 16, 10).cast("long")


def draw_uniform(seed, *parts) -> Column:
    """A number in [0, 1)."""
    return draw_int(seed, *parts) / F.lit(float(1 << 52))


def half_even(x: Column) -> Column:
    return F.rint(x).cast("long")


def ranked(df: DataFrame, group: str, id_: str, seed) -> DataFrame:
    """Adds _rank (from 1, within ``group``, in the order of order_key, then id), _n (rows of the group) and _key.

    Ranks are counted in 256 cells a group, so the rows of a large group are dealt over many tasks; only the counts
    of the cells meet in one. Rows whose group is null take no part.
    """
    keyed = df.withColumn("_key", order_key(seed, id_)).withColumn("_cell", F.substring("_key", 1, 2))
    cells = keyed.groupBy(group, "_cell").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(group).orderBy("_cell")
    cells = cells.select(group, "_cell", (F.sum("_c").over(before) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(group)).alias("_n"))
    nth = F.row_number().over(Window.partitionBy(group, "_cell").orderBy("_key", id_))
    return keyed.withColumn("_nth", nth).join(cells, [group, "_cell"]).withColumn("_rank", F.col("_before") + F.col("_nth")).drop("_cell", "_nth", "_before")


def first_by_key(df: DataFrame, id_: str, seed, n: int) -> DataFrame:
    """The n rows that come first in the order of order_key, then id_ (all if there are fewer).

    Counts of 65536 cells of the key tell up to which cell rows are wanted: whole cells are kept as they are, and only
    the rows of the last one are sorted.
    """
    keyed = df.withColumn("_key", order_key(seed, id_))
    cell = F.substring("_key", 1, 4)
    left = n
    for r in sorted(keyed.groupBy(cell.alias("cell")).count().collect()):
        if r["count"] >= left:
            last = keyed.where(cell == r["cell"]).orderBy("_key", id_).limit(left)
            return keyed.where(cell < r["cell"]).unionByName(last).drop("_key")
        left -= r["count"]
    return df
