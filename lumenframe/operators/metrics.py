"""Classification metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _grid(spark, n_classes: int) -> DataFrame:
    """All pairs of classes: n_classes squared rows, a fixed small table."""
    cell = spark.range(n_classes * n_classes)
    return cell.select((F.col("id") / n_classes).cast("int").alias("label"), (F.col("id") % n_classes).cast("int").alias("prediction"))


def confusion(df: DataFrame, n_classes: int) -> DataFrame:
    """(label, prediction, n) for every pair of classes, zeros too."""
    counts = df.groupBy(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))
    return _grid(df.sparkSession, n_classes).join(counts, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def _ratio(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def per_class(conf: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(label, support, predicted, hits, precision, recall, f1) of a confusion table; a zero denominator gives 0."""
    keys = list(keys)
    both = conf.select(*keys, F.explode(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hits")), F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")))).alias("x"))
    sums = both.groupBy(*keys, F.col("x.c").alias("label")).agg(*[F.sum(f"x.{c}").alias(c) for c in ("support", "predicted", "hits")])
    p, r = _ratio(F.col("hits"), F.col("predicted")), _ratio(F.col("hits"), F.col("support"))
    scored = sums.withColumn("precision", p).withColumn("recall", r)
    return scored.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification_summary(df: DataFrame, n_classes: int) -> DataFrame:
    """One row: n, accuracy and macro precision, recall, f1 over all classes, absent ones as 0."""
    return summary_of(per_class(confusion(df, n_classes)))


def summary_of(classes: DataFrame, keys: list[str] = ()) -> DataFrame:
    return classes.groupBy(*keys).agg(
        F.sum("support").alias("n"),
        (F.sum("hits") / F.greatest(F.sum("support"), F.lit(1))).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )


def summary_by(df: DataFrame, keys: list[str], n_classes: int) -> DataFrame:
    """classification_summary for each value of keys, in one pass over df."""
    counts = df.groupBy(*keys, F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))
    seen = counts.select(*keys).distinct()
    classes = F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("label")
    empty = seen.select(*keys, classes).select(*keys, "label", F.col("label").alias("prediction"), F.lit(0).cast("long").alias("n"))
    return summary_of(per_class(counts.unionByName(empty), keys), keys)


def softmax_loss(df: DataFrame) -> DataFrame:
    """Adds probs, top1 (largest), p_true and loss: cross-entropy as max - z_y + log1p(sum of the others' exp(z - max))."""
    top = F.array_max("scores")
    at = F.array_position("scores", F.col("_top"))
    e = F.transform("scores", lambda z: F.exp(z - F.col("_top")))
    others = F.aggregate(F.transform("_e", lambda x, i: F.when(i == F.col("_at") - 1, F.lit(0.0)).otherwise(x)), F.lit(0.0), lambda a, x: a + x)
    d = df.withColumn("_top", top).withColumn("_at", at).withColumn("_e", e).withColumn("_others", others)
    d = d.withColumn("probs", F.transform("_e", lambda x: x / (F.col("_others") + 1)))
    true = F.element_at("scores", (F.col("label") + 1).cast("int"))
    return d.withColumn("top1", F.array_max("probs")).withColumn("p_true", F.element_at("probs", (F.col("label") + 1).cast("int"))).withColumn("loss", F.col("_top") - true + F.log1p("_others")).drop("_top", "_at", "_e", "_others")


def mean_cross_entropy(df: DataFrame) -> DataFrame:
    return softmax_loss(df).agg(F.avg("loss").alias("cross_entropy"), F.count("*").alias("n"))


def confusion_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two confusion tables agree, how many cells differ, and the accuracy of each."""
    x = a.select("label", "prediction", F.col("n").alias("na"))
    y = b.select("label", "prediction", F.col("n").alias("nb"))
    j = x.join(y, ["label", "prediction"], "full_outer").fillna(0, ["na", "nb"])
    hit = F.col("label") == F.col("prediction")
    return j.agg(
        F.sum(F.when(F.col("na") != F.col("nb"), 1).otherwise(0)).alias("differences"),
        *[(F.sum(F.when(hit, F.col(c)).otherwise(0)) / F.greatest(F.sum(c), F.lit(1))).alias(f"accuracy_{s}") for c, s in (("na", "a"), ("nb", "b"))],
    ).withColumn("matches", F.col("differences") == 0)
