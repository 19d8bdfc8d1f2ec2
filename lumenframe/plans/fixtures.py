"""Images, features, logits and runs derived from the test tables, in Spark and as the same expressions in SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import draw_uniform
from ..functions.vectors import matrix

CLASS_NAMES = [f"class_{i}" for i in range(10)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split(c: str):
    return F.when(F.col(c) % 6 == 0, "test").otherwise("train").alias("split")


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CLASS_NAMES)), "label int, class_name string")


def features(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), F.col("label").cast("int").alias("label"), _split("vec_id"), F.col("embedding").cast("array<double>").alias("features"))


def gray8(spark, d) -> DataFrame:
    """8 x 8 gray images: image_id, label, split, gray (numbers 0 .. 1)."""
    q = F.transform("features", lambda x: F.floor((x + 1) * 127.5) / 255.0)
    return features(spark, d).select("image_id", "label", "split", q.alias("gray"))


_AT = np.array([(7 * (y // 2) + 3 * (x // 2) + (y // 2) * (x // 2) + 21 * c) % 64 for y in range(32) for x in range(32) for c in range(3)])


def images(spark, d, planar: bool = False) -> DataFrame:
    """32 x 32 x 3 images as bytes."""
    order = np.arange(3072).reshape(32, 32, 3).transpose(2, 0, 1).reshape(-1) if planar else np.arange(3072)

    def run(batches):
        for b in batches:
            q = np.floor((matrix(b.column("features")) + 1) * 127.5).astype(np.uint8)
            p = q[:, _AT[order]] if len(q) else np.zeros((0, 3072), np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("image_id"), b.column("label"), b.column("split"), pa.array([r.tobytes() for r in p], pa.binary())], names=["image_id", "label", "split", "pixels"])

    return features(spark, d).select("image_id", "label", "split", "features").mapInArrow(run, "image_id long, label int, split string, pixels binary")


def words(spark, d) -> DataFrame:
    """Four descriptors of 16 numbers an image; none where vec_id is a multiple of 11."""
    f = features(spark, d).where("image_id % 11 != 0")
    return f.select("image_id", "split", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rank"), "features").select("image_id", "split", "rank", F.slice("features", F.col("rank") * 16 + 1, 16).alias("descriptor"))


def event_classes(spark, d) -> DataFrame:
    kinds = table(spark, d, "events").select("event_type").distinct()
    return kinds.select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("int").alias("label"))


def big(spark, d) -> DataFrame:
    """id, label, features (value, k, hour, user) of every event."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    f = F.array(F.col("value").cast("double"), k, F.hour("ts").cast("double"), F.col("user_id").cast("double"))
    return e.join(event_classes(spark, d), "event_type").select(F.col("event_id").alias("id"), "label", _split("event_id"), f.alias("features"))


def imbalanced(spark, d) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"))


def logits(spark, d) -> DataFrame:
    s = F.transform(F.slice("features", 1, 10), lambda x: x * 8)
    out = features(spark, d).select("image_id", "label", "split", s.alias("scores"))
    return out.withColumn("prediction", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))


def logits_big(spark, d) -> DataFrame:
    scores = F.array(*[draw_uniform("logit", "id", F.lit(k)) for k in range(5)])
    out = big(spark, d).select(F.col("id").alias("image_id"), "label", "split", scores.alias("scores"))
    return out.withColumn("prediction", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))


def batches(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("run"), (F.col("user_id") % 4).cast("string")).alias("run"), F.dayofmonth("ts").alias("epoch"), F.col("value").cast("double").alias("loss"), (F.col("event_id") % 7 + 1).alias("rows"))


def runs(spark, d) -> DataFrame:
    r = batches(spark, d).groupBy("run").agg(F.count("*").alias("n"), F.sum("loss").alias("s"), F.sum("rows").alias("r"))
    return r.select(
        "run",
        F.substring("run", 4, 1).cast("int").alias("run_order"),
        F.when(F.col("run") < "run2", "classic").otherwise("deep").alias("family"),
        F.when(F.col("run") < "run2", "hog_%").otherwise("pixel").alias("feature"),
        F.concat(F.lit("model_"), F.substring("run", 4, 1)).alias("model"),
        F.lit(200).alias("budget"),
        F.lit(42).alias("seed"),
        F.col("n").alias("n_test"),
        F.round(F.col("s") / F.col("n") / 100, 9).alias("accuracy"),
        F.round(F.col("s") / F.col("r") / 100, 9).alias("macro_f1"),
        F.col("r").cast("double").alias("training_seconds"),
    )


_KINDS = "(SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::INT AS label FROM (SELECT DISTINCT event_type FROM events))"

#: The same fixtures in DuckDB's SQL.
SQL = {
    "fx_features": "SELECT vec_id AS image_id, label::INT AS label, CASE WHEN vec_id % 6 = 0 THEN 'test' ELSE 'train' END AS split, [x::DOUBLE FOR x IN embedding] AS f FROM embeddings",
    "fx_dims": "SELECT image_id, label, split, unnest(range(0, 64))::INT AS dim, unnest(f) AS x FROM fx_features",
    "fx_gray": "SELECT image_id, label, split, (unnest(range(0, 64)) // 8)::INT AS y, (unnest(range(0, 64)) % 8)::INT AS x, floor((unnest(f) + 1) * 127.5) / 255.0::DOUBLE AS g FROM fx_features",
    "fx_px": "SELECT image_id, label, split, y, x, c, ((y * 32 + x) * 3 + c)::BIGINT AS i, floor((f[((7 * (y // 2) + 3 * (x // 2) + (y // 2) * (x // 2) + 21 * c) % 64 + 1)::INT] + 1) * 127.5)::BIGINT AS v FROM fx_features, range(0, 32) AS a(y), range(0, 32) AS b(x), range(0, 3) AS h(c)",
    "fx_words": "SELECT image_id, split, r::INT AS rank, f[(r * 16 + 1)::INT:(r * 16 + 16)::INT] AS d FROM fx_features, range(0, 4) AS a(r) WHERE image_id % 11 <> 0",
    "fx_big": f"SELECT event_id AS id, k.label, CASE WHEN event_id % 6 = 0 THEN 'test' ELSE 'train' END AS split, [value::DOUBLE, json_extract_string(props, '$.k')::DOUBLE, hour(ts)::DOUBLE, user_id::DOUBLE] AS f FROM events JOIN {_KINDS} k USING (event_type)",
    "fx_imbalanced": "SELECT doc_id AS id, quality::INT AS label FROM labels",
    "fx_logits": "SELECT *, (list_position(scores, list_max(scores)) - 1)::INT AS prediction FROM (SELECT image_id, label, split, [x * 8 FOR x IN f[1:10]] AS scores FROM fx_features)",
    "fx_logits_big": "SELECT *, (list_position(scores, list_max(scores)) - 1)::INT AS prediction FROM (SELECT id AS image_id, label, split, ["
    + ", ".join(f"('0x' || substr(md5('logit:' || id || ':{k}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE" for k in range(5))
    + "] AS scores FROM fx_big)",
    "fx_classes": "SELECT i::INT AS label, 'class_' || i AS class_name FROM range(0, 10) AS t(i)",
    "fx_batches": "SELECT 'run' || (user_id % 4) AS run, day(ts)::INT AS epoch, value::DOUBLE AS loss, event_id % 7 + 1 AS rows FROM events",
    "fx_runs": "SELECT run, substr(run, 4, 1)::INT AS run_order, CASE WHEN run < 'run2' THEN 'classic' ELSE 'deep' END AS family, CASE WHEN run < 'run2' THEN 'hog_%' ELSE 'pixel' END AS feature, 'model_' || substr(run, 4, 1) AS model, 200 AS budget, 42 AS seed, n AS n_test, round(s / n / 100, 9) AS accuracy, round(s / r / 100, 9) AS macro_f1, r::DOUBLE AS training_seconds FROM (SELECT run, count(*) AS n, sum(loss) AS s, sum(rows) AS r FROM fx_batches GROUP BY run)",
}
_NEEDS = {"fx_dims": ["fx_features"], "fx_gray": ["fx_features"], "fx_px": ["fx_features"], "fx_words": ["fx_features"], "fx_logits": ["fx_features"], "fx_logits_big": ["fx_big"], "fx_runs": ["fx_batches"]}


def with_fixtures(*names: str, more: str = "", then: str) -> str:
    """A query over fixtures: WITH the named ones, more of its own, then its body."""
    out: list[str] = []
    for n in names:
        for m in [*_NEEDS.get(n, []), n]:
            if m not in out:
                out.append(m)
    parts = [f"{n} AS ({SQL[n]})" for n in out] + ([more] if more else [])
    return "WITH " + ",\n".join(parts) + "\n" + then
