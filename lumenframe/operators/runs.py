"""Tables of experiment runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_epoch(history: DataFrame) -> DataFrame:
    """(run, epoch, validation_accuracy): the highest accuracy of each run, the earliest of equals."""
    best = F.max_by(F.struct("epoch", "validation_accuracy"), F.struct("validation_accuracy", -F.col("epoch"))).alias("b")
    return history.groupBy("run").agg(best).select("run", "b.epoch", "b.validation_accuracy")


def epoch_losses(batches: DataFrame) -> DataFrame:
    """(run, epoch, mean_loss, weighted_loss): means over batches, plain and by their rows."""
    return batches.groupBy("run", "epoch").agg(F.avg("loss").alias("mean_loss"), (F.sum(F.col("loss") * F.col("rows")) / F.sum("rows")).alias("weighted_loss"))


def result_rows(runs: DataFrame) -> DataFrame:
    """(run, line): feature, model, test rows, accuracy and macro F1 to four places, with _ and % escaped, joined by &."""
    escape = lambda c: F.regexp_replace(F.col(c).cast("string"), r"([_%])", r"\\$1")
    number = lambda c: F.format_string("%.4f", F.col(c))
    return runs.select("run", F.concat_ws(" & ", escape("feature"), escape("model"), F.col("n_test").cast("string"), number("accuracy"), number("macro_f1")).alias("line"))


def compatible_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many variants of the keys there are, and whether it is one at most."""
    n = F.countDistinct(F.struct(*keys))
    return runs.agg(n.alias("n_variants")).withColumn("ok", F.col("n_variants") <= 1)


def require_compatible(runs: DataFrame, keys: list[str]) -> DataFrame:
    if not compatible_runs(runs, keys).first()["ok"]:
        raise ValueError("runs differ in " + ", ".join(keys))
    return runs


def missing_runs(runs: DataFrame, required: DataFrame, budget: int) -> DataFrame:
    """Rows of required (feature, model) without a run of that budget."""
    return required.join(runs.where(F.col("budget") == budget), ["feature", "model"], "left_anti")


def compare_runs(a: DataFrame, b: DataFrame, required: DataFrame, budget: int = 200) -> DataFrame:
    """Runs of both families with the budget, in one table; a required configuration that is missing is an error."""
    both = a.unionByName(b).where(F.col("budget") == budget)
    missing = missing_runs(both, required, budget)
    if not missing.isEmpty():
        raise ValueError("a required configuration is missing")
    return both


def leaderboard(runs: DataFrame) -> DataFrame:
    """One row: the best run by accuracy, the fastest and slowest by training time, hours to two places; ids break ties."""
    best = F.max_by(F.struct("run", "accuracy"), F.struct("accuracy", -F.col("run_order"))).alias("best")
    fast = F.min_by(F.struct("run", "training_seconds"), F.struct("training_seconds", "run_order")).alias("fast")
    slow = F.max_by(F.struct("run", "training_seconds"), F.struct("training_seconds", -F.col("run_order"))).alias("slow")
    hours = lambda c: F.round(F.col(c) / 3600, 2)
    return runs.agg(best, fast, slow).select(
        F.col("best.run").alias("best_run"), F.col("best.accuracy").alias("best_accuracy"), F.col("fast.run").alias("fastest_run"), hours("fast.training_seconds").alias("fastest_hours"), F.col("slow.run").alias("slowest_run"), hours("slow.training_seconds").alias("slowest_hours")
    )


def check_run_records(models: DataFrame, runs: DataFrame, atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """(run, ok, reason): whether a stored model (run, epoch, stats) agrees with its record: present, same best epoch,
    statistics with |a - b| <= atol + rtol * |b|."""
    j = models.select("run", F.col("epoch").alias("ea"), F.col("stats").alias("sa"), F.lit(1).alias("in_a")).join(runs.select("run", F.col("epoch").alias("eb"), F.col("stats").alias("sb"), F.lit(1).alias("in_b")), "run", "full_outer")
    close = F.forall(F.arrays_zip(F.col("sa").alias("a"), F.col("sb").alias("b")), lambda x: F.coalesce(F.abs(x["a"] - x["b"]) <= atol + rtol * F.abs(x["b"]), F.lit(False)))
    reason = F.when(F.col("in_a").isNull(), "no model").when(F.col("in_b").isNull(), "no record").when(~F.col("ea").eqNullSafe(F.col("eb")), "best epoch").when((F.size("sa") != F.size("sb")) | ~close, "statistics").otherwise("")
    return j.select("run", (reason == "").alias("ok"), reason.alias("reason"))
