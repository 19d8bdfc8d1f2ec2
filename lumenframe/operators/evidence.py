"""Error evidence from stored predictions (image_id, label, prediction, scores)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.artifacts import written
from .metrics import confusion

CELLS = 4096
#: So many values of a cell are looked at one by one.
FEW = 4096


def margins(df: DataFrame) -> DataFrame:
    """Adds margin (largest minus second largest score; 0 without two scores) and correct. A negative id is an error."""
    s = F.sort_array("scores", asc=False)
    margin = F.when(F.size("scores") >= 2, F.get(s, 0) - F.get(s, 1)).otherwise(F.lit(0.0))
    checked = F.when(F.col("image_id") < 0, F.raise_error(F.lit("a prediction has no valid image index"))).otherwise(F.coalesce(margin, F.lit(0.0)))
    return df.withColumn("margin", checked.cast("double")).withColumn("correct", F.col("label") == F.col("prediction"))


def order_statistics(df: DataFrame, value: str, asked: dict) -> dict:
    """name -> (value, before): the values at given places, and at which place among their equals they are.

    asked is name -> (condition on the rows, place from 0, ascending, and the extremes of the values or None). Each round
    counts CELLS equal cells between the extremes that are left, for all names in one pass, and goes on in the cell that
    holds the place, until its values are equal or no more than FEW, which are then looked at. No rows are moved or sorted.
    """
    found, open_, few = {}, dict(asked), {}

    def inside(condition, span):
        known = condition & F.col(value).isNotNull()
        return known & F.col(value).between(*map(F.lit, span)) if span else known

    while open_:
        cells = []
        for i, (condition, _, span) in enumerate(open_.values()):
            width = float(span[1]) - float(span[0]) if span else 0.0
            cell = F.floor((F.col(value) - F.lit(span[0])).cast("double") / F.lit(width) * CELLS).cast("int") if width else F.lit(0)
            cells.append(F.when(inside(condition, span), F.struct(F.lit(i).alias("i"), cell.alias("cell"))))
        counted = df.select(value, F.explode(F.array(*cells)).alias("c")).where("c IS NOT NULL").groupBy("c.i", "c.cell").agg(F.count("*").alias("n"), F.min(value).alias("a"), F.max(value).alias("b"))
        rows, further = sorted(counted.collect()), {}  # CELLS + 1 a name at most
        for i, (name, (condition, place, _)) in enumerate(open_.items()):
            for r in rows:
                if r["i"] == i:
                    if r["n"] > place:
                        break
                    place -= r["n"]
            if r["a"] == r["b"]:
                found[name] = (r["a"], place)
            else:
                (few if r["n"] <= FEW else further)[name] = (condition, place, (r["a"], r["b"]))
        open_ = further
    if few:
        mine = [F.when(inside(condition, span), F.lit(i)) for i, (condition, _, span) in enumerate(few.values())]
        lists = df.select(value, F.explode(F.array(*mine)).alias("i")).where("i IS NOT NULL").groupBy("i").agg(F.sort_array(F.collect_list(value)).alias("v")).collect()  # FEW a name at most
        for r in lists:
            name, v = list(few)[r["i"]], r["v"]
            at = v[few[name][1]]
            found[name] = (at, few[name][1] - v.index(at))
    return found


def evidence_summary(df: DataFrame) -> DataFrame:
    """One row: counts, accuracy, mean and exact median margin of right and of wrong rows (null for an empty group)."""
    m = written(margins(df).select("margin", "correct"), "margins")  # every pass reads these two columns
    right, wrong = F.when(F.col("correct"), F.col("margin")), F.when(~F.col("correct"), F.col("margin"))
    one = m.agg(
        F.count("*").alias("num_samples"),
        F.count(right).alias("num_correct"),
        F.count(wrong).alias("num_errors"),
        (F.count(right) / F.greatest(F.count("*"), F.lit(1))).alias("accuracy"),
        F.avg(right).alias("mean_margin_correct"),
        F.avg(wrong).alias("mean_margin_error"),
        *[f(c).alias(f"{k}{i}") for i, c in enumerate((right, wrong)) for k, f in (("a", F.min), ("b", F.max))],
    ).first()
    asked = {}
    for i, (n, condition) in enumerate(((one["num_correct"], F.col("correct")), (one["num_errors"], ~F.col("correct")))):
        asked |= {(i, j): (condition, j, (one[f"a{i}"], one[f"b{i}"])) for j in {(n - 1) // 2, n // 2} if n}
    at = order_statistics(m, "margin", asked)
    median = [[v for (x, _), (v, _) in at.items() if x == i] for i in range(2)]
    row = (*one[:6], *[sum(v) / len(v) if v else None for v in median])
    return df.sparkSession.createDataFrame([row], "num_samples long, num_correct long, num_errors long, accuracy double, mean_margin_correct double, mean_margin_error double, median_margin_correct double, median_margin_error double")


def top_confusions(df: DataFrame, classes: DataFrame, n_classes: int, k: int = 10) -> DataFrame:
    """The k largest off-diagonal cells; equal counts: the later cell first. Zero cells may appear."""
    names = lambda c, as_: classes.select(F.col("label").alias(c), F.col("class_name").alias(as_))
    cells = confusion(df, n_classes).where("label != prediction").withColumn("cell", F.col("label") * n_classes + F.col("prediction"))
    top = cells.orderBy(F.desc("n"), F.desc("cell")).limit(k)
    place = F.row_number().over(Window.orderBy(F.desc("n"), F.desc("cell")))
    return top.withColumn("place", place).join(names("label", "true_class"), "label").join(names("prediction", "predicted_class"), "prediction").select("place", "true_class", "predicted_class", "n")


def gallery(df: DataFrame) -> DataFrame:
    """For right and wrong rows and each true label, the row of the largest margin (smallest id on ties), by max_by."""
    best = F.max_by(F.struct("image_id", "margin"), F.struct("margin", -F.col("image_id"))).alias("best")
    return margins(df).groupBy("correct", "label").agg(best).select("correct", "label", F.col("best.image_id").alias("image_id"), F.col("best.margin").alias("margin"))


def margin_histogram(df: DataFrame, bins: int = 35) -> DataFrame:
    """(correct, bin, lo, hi, n, density): equal bins over the range of each group, the last one closed."""
    m = margins(df).select("correct", "margin")
    span = m.groupBy("correct").agg(F.min("margin").alias("a"), F.max("margin").alias("b"), F.count("*").alias("total"))
    # a range of one value is widened by a half to each side
    span = span.withColumn("w", F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) / bins).otherwise(F.lit(1.0 / bins))).withColumn("a", F.when(F.col("b") > F.col("a"), F.col("a")).otherwise(F.col("a") - 0.5))
    placed = m.join(F.broadcast(span), "correct").withColumn("bin", F.least(F.floor((F.col("margin") - F.col("a")) / F.col("w")), F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy("correct", "bin").agg(F.count("*").alias("n"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(counts, ["correct", "bin"], "left").fillna(0, ["n"])
    return full.select("correct", "bin", (F.col("a") + F.col("bin") * F.col("w")).alias("lo"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("hi"), "n", (F.col("n") / F.col("total") / F.col("w")).alias("density"))


def representatives(losses: DataFrame) -> DataFrame:
    """Of right and of wrong rows the one at place n // 2 by (loss, id). Needs image_id, correct, loss; both groups must exist.

    The loss at that place is found by counts, and among rows of that loss the id in the same way.
    """
    narrow = written(losses.select("image_id", "correct", "loss"), "losses")
    groups = {r["correct"]: r for r in narrow.groupBy("correct").agg(F.count("*").alias("n"), F.min("loss").alias("a"), F.max("loss").alias("b")).collect()}
    if not groups.get(True) or not groups.get(False):
        raise ValueError("a group has no rows")
    of = {right: F.col("correct") == right for right in (True, False)}
    loss = order_statistics(narrow, "loss", {right: (of[right], g["n"] // 2, (g["a"], g["b"])) for right, g in groups.items() if right is not None})
    ids = order_statistics(narrow, "image_id", {right: (of[right] & (F.col("loss") == at), before, None) for right, (at, before) in loss.items()})
    rows = [(right, ids[right][0], loss[right][0], groups[right]["n"]) for right in of]
    return losses.sparkSession.createDataFrame(rows, "correct boolean, image_id long, loss double, n long")
