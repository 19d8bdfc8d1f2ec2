"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import quoted, stash, table

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SPREAD = 256
SPACES = " \t\n\x0b\x0c\r"


def with_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds size: the number of [^\\x20\\x09-\\x0D]+ in the text (null: 0)."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES))
    return docs.withColumn("size", F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, so small beside the documents.

    Sources by code point, null last, weigh ``weights``, repeating, and share the sum of all sizes. A target stops at
    ``most`` times its source's size; the excess is reshared by weight until none is above. That end is reached at
    once: by ascending cap / weight, sources stay at their caps while the share per weight of the rest is above.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    ascending = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ascending.rowsBetween(Window.unboundedPreceding, -1)
    after = ascending.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("share", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("share"))
    level = F.max(F.when(~F.col("capped"), F.col("share"))).over(everything)
    first_free = F.first(F.when(~F.col("capped"), F.col("share")), ignorenulls=True).over(ascending.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.coalesce(first_free, level) * F.col("weight")).alias("target"))


def _shares(docs: DataFrame, carry: list[str], weights: tuple, most: int, seed: int) -> DataFrame:
    """_others (the columns ``carry`` as a struct), size, source_size, target, copies of each row of docs."""
    source = F.col("source").cast("string")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    keyed = with_size(docs.select(
        F.struct(*[F.col(quoted(c)) for c in carry]).alias("_others"),
        F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)).alias("_source"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), key)).alias("_salt"),
        F.col("text").cast("string").alias("text"),
    )).drop("text")
    keyed = keyed.withColumn("_class", F.floor(F.log(F.col("size").cast("double") + 1) * 16).cast("int")).withColumn("_cell", (F.conv(F.substring("_salt", 1, 4), 16, 10).cast("int") % SPREAD))
    cells = stash(keyed.groupBy("_source", "_class", "_cell").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    classes = cells.groupBy("_source", "_class").agg(F.sum("n").alias("n"))
    by_class = Window.partitionBy("_source").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    by_cell = Window.partitionBy("_source", "_class").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = classes.withColumn("_from", F.coalesce(F.sum("n").over(by_class), F.lit(0))).drop("n")
    named = F.when(F.col("_source") == "n", F.lit(None)).otherwise(F.substring("_source", 2, 1 << 30)).alias("source")
    goal = stash(targets(cells.groupBy("_source").agg(F.sum("size").alias("source_size")).select(named, "source_size"), weights, most))
    goal = goal.withColumn("_source", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))).drop("source")
    # a multiple of 2 ** -20, so that whole rates stay exact
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("offset"), F.col("_source"))), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    cells = cells.select("_source", "_class", "_cell", (F.coalesce(F.sum("n").over(by_cell), F.lit(0))).alias("_before"))
    cells = cells.join(offsets, ["_source", "_class"]).join(goal, "_source").withColumn("_draw", draw)
    nth = F.row_number().over(Window.partitionBy("_source", "_class", "_cell").orderBy("_salt", "size"))
    ranked = keyed.withColumn("_nth", nth).join(cells, ["_source", "_class", "_cell"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = (F.col("_from") + F.col("_before") + F.col("_nth")).cast("double")
    copies = F.floor(F.col("_draw") + rate * rank) - F.floor(F.col("_draw") + rate * (rank - 1))
    return ranked.select("_others", "size", "source_size", "target", F.least(copies, F.lit(most)).cast("int").alias("copies"))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES, seed: int = 42) -> DataFrame:
    """The columns of docs (doc_id, source, text), and size, source_size, target and taken (size times the copies taken).

    Every document of a source expects target / source_size copies. Within its source, in an order by size class and
    then by hash, expected copies are summed up; with one offset drawn a source, a document is emitted once for each
    integer that its stretch of the sum crosses. So each run of like documents gives its share, whatever the seed.
    Ranks come from counts of small cells (source, size class, hash), so no task holds a source.

    Null text: size 0, taken 0. Null source: a source of its own, last. Null doc_id: ranked by its text. Repeated rows:
    ranked like all others; rows that tie share the copies that their ranks give. A source without words: target 0,
    nothing taken. Very long texts count whole. Empty table: no rows. Other columns come along whatever their names, but
    for size, source_size, target and taken, which are replaced.
    """
    out = ("size", "source_size", "target", "taken")
    carry = [c for c in docs.columns if c not in out]
    shares = _shares(docs, carry, weights, most, seed).withColumn("taken", F.col("size") * F.col("copies"))
    return shares.select(*[F.col("_others").getField(c).alias(c) for c in carry], *out)


def emit_mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES, seed: int = 42) -> DataFrame:
    """The mix itself: each row of docs as often as mix_sources takes it, with its number in ``copy`` (1, 2 ...).

    Rows that the mix leaves out are gone; so are rows without words, which have nothing to take. All else as in
    mix_sources; a column named copy is replaced.
    """
    carry = [c for c in docs.columns if c != "copy"]
    taken = _shares(docs, carry, weights, most, seed).where((F.col("copies") > 0) & (F.col("size") > 0))
    return taken.select(*[F.col("_others").getField(c).alias(c) for c in carry], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of documents; nulls, ties and repeated rows as in mix_sources."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    shares = _shares(docs, ["doc_id"], WEIGHTS, MOST_COPIES, 42)
    return shares.select("_others.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixing_sql(documents: str = "documents") -> str:
    """DuckDB SQL for the mix of ``documents`` (doc_id, source, text)."""
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS salt FROM {documents}),
k AS (SELECT *, floor(ln(size + 1) * 16)::INT AS class, ('0x' || substr(salt, 1, 4))::INT % 256 AS cell FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM s),
h AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w),
f AS (SELECT min_by(share, cap / weight) FILTER (cap / weight > share) AS level FROM h),
t AS (SELECT source, source_size, CASE WHEN cap / weight <= share THEN cap ELSE level * weight END AS target,
  ('0x' || substr(md5('42:offset:' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END), 1, 5))::INT::DOUBLE / 1048576 AS draw FROM h, f),
r AS (SELECT k.*, t.source_size, target, draw, CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0 END AS rate,
  (row_number() OVER (PARTITION BY k.source ORDER BY class, cell, salt, size))::DOUBLE AS rank FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT *, (size * least(floor(draw + rate * rank) - floor(draw + rate * (rank - 1)), 3))::BIGINT AS taken FROM r"""


OP2_SQL = f"SELECT doc_id, size, source_size, target, taken FROM ({mixing_sql()})"
