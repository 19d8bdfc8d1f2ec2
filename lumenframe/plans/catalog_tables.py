"""Queries of the relational operators: sampling, metrics, evidence, runs, inference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evidence, inference, metrics, runs, sampling
from ..operators.forest import candidate_thresholds, best_split, feature_subset, gini
from ..operators.svm import encode_labels
from ..sources import images as src
from ..sources.artifacts import scratch_path
from . import fixtures as fx
from .fixtures import with_fixtures

NUM_EVENT_CLASSES = 5
_PICK = [1, 3, 5, 8, 13, 21, 34, 55, 89, 144]


def _r(c, digits=6):
    return F.round(F.col(c), digits).alias(c)


def _ranked_sql(source: str, id_: str, seed, where: str = "TRUE", label: str = "label") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}:' || {id_}), {id_}) AS rk, count(*) OVER (PARTITION BY {label}) AS n FROM {source} WHERE {where}"


# -- sampling ----------------------------------------------------------------------------------------------------------
def smp1(s, d):
    return sampling.stratified_split(fx.big(s, d).drop("split"), "label", "id", 0.1).select("id", "label", "split")


def _split_sql(source, fraction, least):
    return with_fixtures(source, more=f"r AS ({_ranked_sql(source, 'id', 42)})", then=f"SELECT id, label, CASE WHEN rk <= greatest(round_even(n * {fraction}::DOUBLE, 0), {least}) THEN 'validation' ELSE 'train' END AS split FROM r")


def smp2(s, d):
    return sampling.stratified_split(fx.imbalanced(s, d), "label", "id", 0.01, min_per_class=0)


def _limit_sql(source, id_, limit, seed, where="TRUE", name="q"):
    return f"""{name}_r AS ({_ranked_sql(source, id_, seed, where)}), {name}_t AS (SELECT count(*) AS total FROM {name}_r),
{name}_c AS (SELECT {name}_r.*, row_number() OVER (ORDER BY md5('{seed}:cut:' || {id_}), {id_}) AS cut FROM {name}_r, {name}_t
  WHERE total <= {limit} OR rk <= greatest(round_even({limit} * n::DOUBLE / total, 0), 1)),
{name} AS (SELECT {name}_c.* FROM {name}_c, {name}_t WHERE total <= {limit} OR cut <= {limit})"""


def smp3(s, d):
    return sampling.limit_stratified(fx.big(s, d), "label", "id", 997).select("id", "label")


def smp4(s, d):
    three = fx.features(s, d).withColumn("split", F.when(F.col("image_id") % 5 == 0, "validation").otherwise(F.col("split"))).select("image_id", "label", "split")
    return sampling.limit_splits(three, "label", "image_id", 90, 40)


SMP4_SQL = with_fixtures(
    "fx_features",
    more="b AS (SELECT image_id, label, CASE WHEN image_id % 5 = 0 THEN 'validation' ELSE split END AS split FROM fx_features), " + ", ".join(_limit_sql("b", "image_id", n, 42 + i, f"split = '{name}'", f"q{i}") for i, (name, n) in enumerate([("train", 90), ("validation", 10), ("test", 40)])),
    then="SELECT image_id, label, split FROM q0 UNION ALL SELECT image_id, label, split FROM q1 UNION ALL SELECT image_id, label, split FROM q2",
)


def smp5(s, d):
    return sampling.balanced_limit(fx.big(s, d), "label", "id", 503, n_classes=NUM_EVENT_CLASSES).select("id", "label")


def smp6(s, d):
    return sampling.sample_per_class(fx.features(s, d).where("split = 'test'"), fx.classes(s), n=2)


def smp7(s, d):
    return sampling.first_per_class(fx.big(s, d), "label", "id")


def smp8(s, d):
    return sampling.bootstrap_weights(fx.features(s, d), "image_id", 3, 0.7)


SMP8_SQL = with_fixtures(
    "fx_features",
    more="n AS (SELECT count(*) AS n, greatest(2, round_even(count(*) * 0.7::DOUBLE, 0))::BIGINT AS k FROM fx_features), i AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS row FROM fx_features), h AS (SELECT t::INT AS tree, ('0x' || substr(md5('42:' || t || ':' || j), 1, 13))::BIGINT % n AS row FROM n, range(0, 3) AS a(t), range(0, 1000000) AS b(j) WHERE j < k)",
    then="SELECT tree, image_id, count(*) AS weight FROM h JOIN i USING (row) GROUP BY tree, image_id",
)


def smp8_split(s, d):
    """Draws split down to the rows: the total of each tree, and that it lists a row once."""
    f = fx.big(s, d).select("id")
    w = sampling.bootstrap_weights(f, "id", 3, 0.7, mode="split")
    return w.join(f, "id").groupBy("tree").agg(F.sum("weight").alias("draws"), (F.count("*") == F.countDistinct("id")).alias("once"), (F.min("weight") >= 1).alias("drawn"))


SMP8_SPLIT_SQL = with_fixtures("fx_big", then="SELECT t::INT AS tree, greatest(2, round_even(count(*) * 0.7::DOUBLE, 0))::BIGINT AS draws, true AS once, true AS drawn FROM fx_big, range(0, 3) AS a(t) GROUP BY t")


def smp9(s, d):
    return sampling.split_digest(fx.features(s, d))


SMP9_SQL = with_fixtures(
    "fx_features",
    more="b AS (SELECT split, image_id % 64 AS bucket, sha256(string_agg(image_id::VARCHAR, ',' ORDER BY image_id)) AS dg FROM fx_features GROUP BY 1, 2), p AS (SELECT split, sha256(string_agg(dg, ',' ORDER BY bucket)) AS digest FROM b GROUP BY split)",
    then="SELECT split, digest FROM p UNION ALL SELECT 'all', sha256(string_agg(split || '=' || digest, ',' ORDER BY split)) FROM p",
)


def smp10(s, d):
    return sampling.select_indices(fx.logits(s, d).select("image_id", "label", "prediction"), _PICK)


def smp11(s, d):
    return sampling.split_counts(fx.big(s, d)).withColumn("label", F.col("label").cast("string"))


# -- metrics -----------------------------------------------------------------------------------------------------------
_CONF = "conf AS (SELECT a.i::INT AS label, b.i::INT AS prediction, coalesce(k.n, 0) AS n FROM range(0, {c}) AS a(i), range(0, {c}) AS b(i) LEFT JOIN (SELECT label, prediction, count(*) AS n FROM {t} GROUP BY 1, 2) k ON k.label = a.i AND k.prediction = b.i)"
_PER = "per AS (SELECT label, support, predicted, hits, p AS precision, r AS recall, CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (SELECT *, CASE WHEN predicted <> 0 THEN hits / predicted::DOUBLE ELSE 0 END AS p, CASE WHEN support <> 0 THEN hits / support::DOUBLE ELSE 0 END AS r FROM (SELECT x.label, (SELECT sum(n) FROM conf WHERE label = x.label)::BIGINT AS support, (SELECT sum(n) FROM conf WHERE prediction = x.label)::BIGINT AS predicted, (SELECT sum(n) FROM conf WHERE label = x.label AND prediction = x.label)::BIGINT AS hits FROM (SELECT DISTINCT label FROM conf) x)))"


def met1(s, d):
    return metrics.confusion(fx.logits_big(s, d), NUM_EVENT_CLASSES)


def met2(s, d):
    p = metrics.per_class(metrics.confusion(fx.logits(s, d), 10))
    return p.select("label", "support", "predicted", "hits", _r("precision"), _r("recall"), _r("f1"))


_MACRO = ["accuracy", "macro_precision", "macro_recall", "macro_f1"]


def met3(s, d):
    return metrics.classification_summary(fx.logits_big(s, d), NUM_EVENT_CLASSES).select("n", *[_r(c) for c in _MACRO])


_SUMMARY = "sum(support)::BIGINT AS n, round(sum(hits) / greatest(sum(support), 1)::DOUBLE, 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1"


def met4(s, d):
    return metrics.summary_by(fx.logits(s, d), ["split"], 10).select("split", "n", *[_r(c) for c in _MACRO])


MET4_SQL = with_fixtures(
    "fx_logits",
    more="k AS (SELECT split, label, prediction, count(*) AS n FROM fx_logits GROUP BY 1, 2, 3), per AS (SELECT split, label, support, hits, CASE WHEN predicted > 0 THEN hits / predicted::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support::DOUBLE ELSE 0 END AS recall FROM (SELECT sp.split, c.i AS label, coalesce((SELECT sum(n) FROM k WHERE k.split = sp.split AND k.label = c.i), 0) AS support, coalesce((SELECT sum(n) FROM k WHERE k.split = sp.split AND k.prediction = c.i), 0) AS predicted, coalesce((SELECT sum(n) FROM k WHERE k.split = sp.split AND k.label = c.i AND k.prediction = c.i), 0) AS hits FROM (SELECT DISTINCT split FROM k) sp, range(0, 10) AS c(i)))",
    then="SELECT split, " + _SUMMARY.replace("avg(f1)", "avg(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END)") + " FROM per GROUP BY split",
)


def met5(s, d):
    return metrics.mean_cross_entropy(fx.logits(s, d)).select(_r("cross_entropy"), "n")


_LOSS = "loss AS (SELECT *, list_max(scores) AS top, scores[label + 1] AS z, list_sum([exp(v - list_max(scores)) FOR v IN scores]) AS e FROM {t})"


def los1(s, d):
    p = metrics.softmax_loss(fx.logits(s, d))
    return p.select("image_id", _r("top1"), _r("p_true"), _r("loss"), F.transform("probs", lambda x: F.round(x, 6))[0].alias("first_prob"))


def met6(s, d):
    a = metrics.confusion(fx.logits(s, d), 10)
    recorded = metrics.confusion(fx.logits(s, d).where("image_id % 97 != 0"), 10)
    return metrics.confusion_matches(a, recorded).select("differences", "matches", _r("accuracy_a"), _r("accuracy_b"))


MET6_SQL = with_fixtures(
    "fx_logits",
    more="a AS (SELECT label, prediction, count(*) AS n FROM fx_logits GROUP BY 1, 2), b AS (SELECT label, prediction, count(*) AS n FROM fx_logits WHERE image_id % 97 <> 0 GROUP BY 1, 2), j AS (SELECT label, prediction, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b USING (label, prediction))",
    then="SELECT count(*) FILTER (na <> nb) AS differences, count(*) FILTER (na <> nb) = 0 AS matches, round(sum(na) FILTER (label = prediction) / sum(na)::DOUBLE, 6) AS accuracy_a, round(sum(nb) FILTER (label = prediction) / sum(nb)::DOUBLE, 6) AS accuracy_b FROM j",
)


# -- evidence ----------------------------------------------------------------------------------------------------------
_MARGIN = "m AS (SELECT *, label = prediction AS correct, list_sort(scores, 'DESC')[1] - list_sort(scores, 'DESC')[2] AS margin FROM {t})"


def evd1(s, d):
    return evidence.margins(fx.logits_big(s, d)).select("image_id", _r("margin"), "correct")


def evd2(s, d):
    e = evidence.evidence_summary(fx.logits_big(s, d))
    return e.select("num_samples", "num_correct", "num_errors", *[_r(c) for c in e.columns[3:]])


def evd3(s, d):
    return evidence.top_confusions(fx.logits(s, d), fx.classes(s), 10)


def evd4(s, d):
    return evidence.gallery(fx.logits_big(s, d)).select("correct", "label", "image_id", _r("margin"))


def evd5(s, d):
    h = evidence.margin_histogram(fx.logits(s, d))
    return h.select("correct", "bin", _r("lo"), _r("hi"), "n", _r("density"))


EVD5_SQL = with_fixtures(
    "fx_logits",
    more=_MARGIN.format(t="fx_logits") + ", g AS (SELECT correct, min(margin) AS a, (max(margin) - min(margin)) / 35 AS w, count(*) AS total FROM m GROUP BY correct), c AS (SELECT correct, least(floor((margin - a) / w), 34)::INT AS bin, count(*) AS n FROM m JOIN g USING (correct) GROUP BY 1, 2)",
    then="SELECT g.correct, b.i::INT AS bin, round(a + i * w, 6) AS lo, round(a + (i + 1) * w, 6) AS hi, coalesce(n, 0) AS n, round(coalesce(n, 0) / total::DOUBLE / w, 6) AS density FROM g, range(0, 35) AS b(i) LEFT JOIN c ON c.correct = g.correct AND c.bin = b.i",
)


def evd6(s, d):
    losses = metrics.softmax_loss(fx.logits_big(s, d)).withColumn("correct", F.col("label") == F.col("prediction"))
    return evidence.representatives(losses).select("correct", "image_id", _r("loss"), "n")


EVD6_SQL = with_fixtures(
    "fx_logits_big",
    more=_LOSS.format(t="fx_logits_big") + ", o AS (SELECT label = prediction AS correct, image_id, top - z + ln(e) AS loss, row_number() OVER (PARTITION BY label = prediction ORDER BY round(top - z + ln(e), 12), image_id) - 1 AS place, count(*) OVER (PARTITION BY label = prediction) AS n FROM loss)",
    then="SELECT correct, image_id, round(loss, 6) AS loss, n FROM o WHERE place = n // 2",
)


# -- runs --------------------------------------------------------------------------------------------------------------
def _history(s, d):
    return runs.epoch_losses(fx.batches(s, d)).select("run", "epoch", F.round(F.col("mean_loss") / 1000, 4).alias("validation_accuracy"))


def run1(s, d):
    return runs.best_epoch(_history(s, d))


def run2(s, d):
    return runs.epoch_losses(fx.batches(s, d)).select("run", "epoch", _r("mean_loss"), _r("weighted_loss"))


def run3(s, d):
    return runs.result_rows(fx.runs(s, d))


def run4(s, d):
    return runs.compatible_runs(fx.runs(s, d), ["budget", "seed", "n_test"])


def run5(s, d):
    r = fx.runs(s, d)
    required = r.select("feature", "model")
    both = runs.compare_runs(r.where("family = 'classic'"), r.where("family = 'deep'"), required)
    return both.select("run", "family", "feature", "model", _r("accuracy"))


def run6(s, d):
    return runs.leaderboard(fx.runs(s, d)).select("best_run", _r("best_accuracy"), "fastest_run", "fastest_hours", "slowest_run", "slowest_hours")


def run7(s, d):
    r = fx.runs(s, d).select("run", F.col("run_order").alias("epoch"), F.array("accuracy", "macro_f1").alias("stats"))
    models = r.where("run != 'run3'").withColumn("stats", F.when(F.col("run") == "run1", F.transform("stats", lambda x: x * 1.001)).otherwise(F.transform("stats", lambda x: x + 1e-9))).withColumn("epoch", F.when(F.col("run") == "run2", F.lit(9)).otherwise(F.col("epoch")))
    return runs.check_run_records(models, r)


RUN7_SQL = with_fixtures("fx_runs", then="SELECT run, run = 'run0' AS ok, CASE run WHEN 'run0' THEN '' WHEN 'run1' THEN 'statistics' WHEN 'run2' THEN 'best epoch' ELSE 'no model' END AS reason FROM fx_runs")


# -- inference, sources, labels ----------------------------------------------------------------------------------------
def inf2(s, d):
    t = inference.top_k(fx.logits(s, d), fx.CLASS_NAMES, 3)
    return t.select("image_id", F.posexplode("top_k").alias("place", "t")).select("image_id", "place", "t.label", "t.class", F.round("t.score", 6).alias("score"))


INF2_SQL = with_fixtures(
    "fx_logits",
    more="u AS (SELECT image_id, (unnest(range(0, 10)))::INT AS label, unnest(scores) AS score FROM fx_logits), o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label DESC) - 1 AS place FROM u)",
    then="SELECT image_id, place::INT AS place, label, 'class_' || label AS class, round(score, 6) AS score FROM o WHERE place < 3",
)


def _paths(s, d):
    f = fx.logits(s, d).withColumn("class_name", F.concat(F.lit("class_"), F.col("label").cast("string")))
    return f.select("image_id", "label", "prediction", F.format_string("/in/%d/%s_%05d.png", F.col("image_id") % 3, "class_name", "image_id").alias("path"))


def _manifest(s, d):
    rows = _paths(s, d).where("image_id % 2 = 0").select(F.regexp_extract("path", "[^/]+$", 0).alias("file_name"), "label", F.concat(F.lit("class_"), F.col("label").cast("string")).alias("class_name"), F.col("image_id").alias("test_index"))
    entry = F.struct("file_name", F.struct("label", "class_name", "test_index"))
    texts = rows.groupBy((F.col("test_index") % 50).alias("part")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("images"))).alias("value"))
    return src.manifest_rows(texts.select("value"))


_PATHS_SQL = "p AS (SELECT image_id, label, prediction, format('/in/{}/class_{}_{:05d}.png', image_id % 3, label, image_id) AS path FROM fx_logits)"


def src6(s, d):
    return _manifest(s, d)


def inf3(s, d):
    return inference.attach_actual(_paths(s, d), _manifest(s, d)).select("path", F.col("actual_label").cast("string").alias("actual_label"))


def inf4(s, d):
    value = F.when(F.col("image_id") % 4 == 0, F.concat(F.lit("class_"), F.col("label").cast("string"))).when(F.col("image_id") % 4 == 1, F.col("label").cast("string")).when(F.col("image_id") % 4 == 2, F.lit("12")).otherwise(F.lit("owl"))
    return inference.parse_labels(fx.logits(s, d).select("image_id", "label").withColumn("value", value).drop("label"), fx.classes(s)).select("image_id", "value", F.col("label").cast("string").alias("label"), "error")


INF4_SQL = with_fixtures("fx_logits", then="SELECT image_id, CASE image_id % 4 WHEN 0 THEN 'class_' || label WHEN 1 THEN label::VARCHAR WHEN 2 THEN '12' ELSE 'owl' END AS value, CASE WHEN image_id % 4 < 2 THEN label::VARCHAR END AS label, CASE image_id % 4 WHEN 2 THEN 'out of range' WHEN 3 THEN 'unknown class' END AS error FROM fx_logits")


def inf5(s, d):
    known = inference.attach_actual(_paths(s, d), _manifest(s, d)).withColumn("source", F.col("path"))
    r = inference.prediction_records(known, fx.classes(s))
    return r.withColumns({c: F.col(c).cast("string") for c in ("actual_label", "true_label")})


INF5_SQL = with_fixtures(
    "fx_logits",
    more=_PATHS_SQL + ", a AS (SELECT *, CASE WHEN image_id % 2 = 0 THEN label END AS actual FROM p)",
    then="SELECT path AS source, prediction AS predicted_label, 'class_' || prediction AS predicted_class, actual::VARCHAR AS actual_label, 'class_' || actual AS actual_class, actual::VARCHAR AS true_label, 'class_' || actual AS true_class, CASE WHEN actual IS NULL THEN 'unknown' WHEN actual = prediction THEN 'correct' ELSE 'wrong' END AS status FROM a",
)


def src2(s, d):
    e = fx.features(s, d).select((F.row_number().over(Window.partitionBy(F.col("image_id") % 6).orderBy("image_id")) - 1).cast("long").alias("position"), "label", F.col("image_id").cast("string").cast("binary").alias("raw"), (F.col("image_id") % 6).alias("part"))
    u = src.union_batches([e.where(F.col("part") == i) for i in range(1, 6)], e.where("part = 0"))
    return u.select("image_id", "split", "label", F.col("pixels").cast("string").cast("long").alias("vec_id"))


SRC2_SQL = with_fixtures(
    "fx_features",
    more="r AS (SELECT image_id AS vec_id, label, image_id % 6 AS part, row_number() OVER (PARTITION BY image_id % 6 ORDER BY image_id) - 1 AS position FROM fx_features), o AS (SELECT part, sum(n) OVER (ORDER BY part) - n AS before FROM (SELECT part, count(*) AS n FROM r WHERE part > 0 GROUP BY part))",
    then="SELECT (position + coalesce(before, 0))::BIGINT AS image_id, CASE WHEN part = 0 THEN 'test' ELSE 'train' END AS split, label, vec_id FROM r LEFT JOIN o USING (part)",
)


def src3(s, d):
    return src.with_class_name(fx.logits(s, d).select("image_id", (F.col("label") + F.col("image_id") % 2 * 5).alias("label")), fx.classes(s))


def src5(s, d):
    """Documents written to files of a hundred, a line each, read as bytes and compared with a table of checksums in which each tenth is wrong."""
    path = scratch_path(s, "files")
    docs = fx.table(s, d, "documents").select(F.floor(F.col("doc_id") / 100).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    docs.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    files = src.read_files(s, path).withColumn("path", F.regexp_extract("path", r"part=\d+", 0)).where("path != ''")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "value"))), lambda x: F.concat(x["value"], F.lit("\n")))
    own = docs.groupBy("part").agg(F.md5(F.array_join(lines, "").cast("binary")).alias("md5"))
    expected = own.select(F.format_string("part=%d", "part").alias("path"), F.when(F.col("part") % 10 == 0, F.md5(F.lit("altered").cast("binary"))).otherwise(F.col("md5")).alias("md5"))
    return src.checksums(files, expected)


def lbl1(s, d):
    e = fx.table(s, d, "events").select("event_id", "event_type")
    return encode_labels(e, "event_type")[0].select("event_id", "event_type", "class_index")


# -- trees over the large keyed table ----------------------------------------------------------------------------------
def _long(s, d):
    return fx.big(s, d).select((F.col("id") % 3).alias("node"), "label", F.posexplode("features").alias("feature", "x"))


_LONG_SQL = "lg AS (SELECT id % 3 AS node, label, (unnest(range(0, 4)))::INT AS feature, unnest(f) AS x FROM fx_big)"
_CAND_SQL = "v AS (SELECT DISTINCT node, feature, x FROM lg), sp AS (SELECT node, feature, min(x) AS lo, max(x) AS hi, count(*) AS kinds FROM v GROUP BY 1, 2), th AS (SELECT node, feature, (x + nx) / 2 AS threshold FROM (SELECT v.*, lead(x) OVER (PARTITION BY node, feature ORDER BY x) AS nx FROM v) JOIN sp USING (node, feature) WHERE nx IS NOT NULL AND kinds <= {k} UNION ALL SELECT node, feature, lo + ('0x' || substr(md5('42:' || node || ':' || feature || ':' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * (hi - lo) FROM sp, range(0, {t}) AS r(i) WHERE kinds > {k})"


def tre1(s, d):
    return gini(fx.big(s, d).withColumn("node", F.col("id") % 7), ["node"]).select("node", "n", _r("gini", 9))


def tre2(s, d):
    return candidate_thresholds(_long(s, d), 30).select("node", "feature", _r("threshold", 6))


def tre3(s, d):
    rows = fx.big(s, d).select((F.col("id") % 3).alias("node"), "label", "features")
    return best_split(rows, candidate_thresholds(_long(s, d), 16), 2).select("node", "feature", _r("threshold"), _r("score"))


TRE3_SQL = with_fixtures(
    "fx_big",
    more=_LONG_SQL + ", " + _CAND_SQL.format(k=17, t=16) + ", kk AS (SELECT node, feature, x, label, count(*) AS k FROM lg GROUP BY ALL), sd AS (SELECT node, feature, threshold, label, sum(CASE WHEN x <= threshold THEN k ELSE 0 END)::DOUBLE AS l, sum(CASE WHEN x > threshold THEN k ELSE 0 END)::DOUBLE AS r FROM kk JOIN th USING (node, feature) GROUP BY ALL), sc AS (SELECT node, feature, threshold, sum(l) AS nl, sum(r) AS nr, sum(l * l) AS ll, sum(r * r) AS rr FROM sd GROUP BY ALL), o AS (SELECT *, round((nl - ll / nl + nr - rr / nr) / (nl + nr), 12) AS score, row_number() OVER (PARTITION BY node ORDER BY round((nl - ll / nl + nr - rr / nr) / (nl + nr), 12), feature, threshold) AS k FROM sc WHERE nl >= 2 AND nr >= 2)",
    then="SELECT node, feature, round(threshold, 6) AS threshold, round(score, 6) AS score FROM o WHERE k = 1",
)


def tre4(s, d):
    nodes = fx.big(s, d).select((F.col("id") % 5).cast("int").alias("tree"), (F.col("id") % 31).alias("node")).distinct()
    return feature_subset(nodes, 64, "sqrt")


TRE4_SQL = with_fixtures(
    "fx_big",
    more="""n AS (SELECT DISTINCT (id % 5)::INT AS tree, id % 31 AS node FROM fx_big),
dr AS (SELECT tree, node, j, ('0x' || substr(md5('42:' || tree || ':' || node || ':' || j), 1, 13))::BIGINT % (j + 1) AS t FROM n, range(56, 64) AS a(j)),
fl(tree, node, j, own) AS (SELECT tree, node, 55, []::BIGINT[] FROM n UNION ALL SELECT fl.tree, fl.node, dr.j, list_append(own, CASE WHEN list_contains(own, dr.t) THEN dr.j ELSE dr.t END) FROM fl JOIN dr ON dr.tree = fl.tree AND dr.node = fl.node AND dr.j = fl.j + 1)""",
    then="SELECT tree, node, unnest(own)::INT AS feature FROM fl WHERE j = 63",
).replace("WITH ", "WITH RECURSIVE ", 1)

ENTRIES = {
    "smp1_stratified_split": (smp1, _split_sql("fx_big", 0.1, 1)),
    "smp2_split_no_floor": (smp2, _split_sql("fx_imbalanced", 0.01, 0)),
    "smp3_limit_stratified": (smp3, with_fixtures("fx_big", more=_limit_sql("fx_big", "id", 997, 42), then="SELECT id, label FROM q")),
    "smp4_limit_splits": (smp4, SMP4_SQL),
    "smp5_balanced_limit": (smp5, with_fixtures("fx_big", more=f"r AS ({_ranked_sql('fx_big', 'id', 42)})", then="SELECT id, label FROM r WHERE rk <= 100 + CASE WHEN label < 3 THEN 1 ELSE 0 END")),
    "smp6_sample_per_class": (smp6, with_fixtures("fx_features", more=f"r AS ({_ranked_sql('fx_features', 'image_id', 42, chr(115) + 'plit = ' + chr(39) + 'test' + chr(39))})", then="SELECT image_id, label, 'class_' || label AS class_name, format('class_{}_{:05d}.png', label, image_id) AS file_name FROM r WHERE rk <= 2")),
    "smp7_first_per_class": (smp7, with_fixtures("fx_big", then="SELECT label, min(id) AS id FROM fx_big GROUP BY label")),
    "smp8_bootstrap": (smp8, SMP8_SQL),
    "smp8_bootstrap_split": (smp8_split, SMP8_SPLIT_SQL),
    "smp9_split_digest": (smp9, SMP9_SQL),
    "smp10_select_indices": (smp10, with_fixtures("fx_logits", then=f"SELECT image_id, label, prediction FROM fx_logits WHERE image_id IN ({', '.join(map(str, _PICK))})")),
    "smp11_split_counts": (smp11, with_fixtures("fx_big", then="SELECT split, label::VARCHAR AS label, count(*) AS n FROM fx_big GROUP BY ROLLUP (split, label)")),
    "met1_confusion": (met1, with_fixtures("fx_logits_big", more=_CONF.format(c=5, t="fx_logits_big"), then="SELECT * FROM conf")),
    "met2_per_class": (met2, with_fixtures("fx_logits", more=_CONF.format(c=10, t="fx_logits") + ", " + _PER, then="SELECT label, support, predicted, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM per")),
    "met3_summary": (met3, with_fixtures("fx_logits_big", more=_CONF.format(c=5, t="fx_logits_big") + ", " + _PER, then=f"SELECT {_SUMMARY} FROM per")),
    "met4_summary_by_split": (met4, MET4_SQL),
    "met5_cross_entropy": (met5, with_fixtures("fx_logits", more=_LOSS.format(t="fx_logits"), then="SELECT round(avg(top - z + ln(e)), 6) AS cross_entropy, count(*) AS n FROM loss")),
    "los1_softmax_loss": (los1, with_fixtures("fx_logits", more=_LOSS.format(t="fx_logits"), then="SELECT image_id, round(1 / e, 6) AS top1, round(exp(z - top) / e, 6) AS p_true, round(top - z + ln(e), 6) AS loss, round(exp(scores[1] - top) / e, 6) AS first_prob FROM loss")),
    "met6_confusion_matches": (met6, MET6_SQL),
    "evd1_margins": (evd1, with_fixtures("fx_logits_big", more=_MARGIN.format(t="fx_logits_big"), then="SELECT image_id, round(margin, 6) AS margin, correct FROM m")),
    "evd2_evidence_summary": (evd2, with_fixtures("fx_logits_big", more=_MARGIN.format(t="fx_logits_big"), then="SELECT count(*) AS num_samples, count(*) FILTER (correct) AS num_correct, count(*) FILTER (NOT correct) AS num_errors, round(count(*) FILTER (correct) / count(*)::DOUBLE, 6) AS accuracy, round(avg(margin) FILTER (correct), 6) AS mean_margin_correct, round(avg(margin) FILTER (NOT correct), 6) AS mean_margin_error, round(median(margin) FILTER (correct), 6) AS median_margin_correct, round(median(margin) FILTER (NOT correct), 6) AS median_margin_error FROM m")),
    "evd3_top_confusions": (evd3, with_fixtures("fx_logits", more=_CONF.format(c=10, t="fx_logits") + ", o AS (SELECT *, row_number() OVER (ORDER BY n DESC, label * 10 + prediction DESC) AS place FROM conf WHERE label <> prediction)", then="SELECT place::INT AS place, 'class_' || label AS true_class, 'class_' || prediction AS predicted_class, n FROM o WHERE place <= 10")),
    "evd4_gallery": (evd4, with_fixtures("fx_logits_big", more=_MARGIN.format(t="fx_logits_big") + ", o AS (SELECT *, row_number() OVER (PARTITION BY correct, label ORDER BY margin DESC, image_id) AS r FROM m)", then="SELECT correct, label, image_id, round(margin, 6) AS margin FROM o WHERE r = 1")),
    "evd5_margin_histogram": (evd5, EVD5_SQL),
    "evd6_representatives": (evd6, EVD6_SQL),
    "run1_best_epoch": (run1, with_fixtures("fx_batches", more="h AS (SELECT run, epoch, round(avg(loss) / 1000, 4) AS validation_accuracy FROM fx_batches GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY validation_accuracy DESC, epoch) AS r FROM h)", then="SELECT run, epoch, validation_accuracy FROM o WHERE r = 1")),
    "run2_epoch_losses": (run2, with_fixtures("fx_batches", then="SELECT run, epoch, round(avg(loss), 6) AS mean_loss, round(sum(loss * rows) / sum(rows), 6) AS weighted_loss FROM fx_batches GROUP BY 1, 2")),
    "run3_result_rows": (run3, with_fixtures("fx_runs", then=r"SELECT run, replace(replace(feature, '_', '\_'), '%', '\%') || ' & ' || replace(replace(model, '_', '\_'), '%', '\%') || ' & ' || n_test || ' & ' || format('{:.4f}', accuracy) || ' & ' || format('{:.4f}', macro_f1) AS line FROM fx_runs")),
    "run4_compatible_runs": (run4, with_fixtures("fx_runs", then="SELECT count(*) AS n_variants, count(*) <= 1 AS ok FROM (SELECT DISTINCT budget, seed, n_test FROM fx_runs)")),
    "run5_compare_runs": (run5, with_fixtures("fx_runs", then="SELECT run, family, feature, model, round(accuracy, 6) AS accuracy FROM fx_runs WHERE budget = 200")),
    "run6_leaderboard": (run6, with_fixtures("fx_runs", then="SELECT (SELECT run FROM fx_runs ORDER BY accuracy DESC, run_order LIMIT 1) AS best_run, round((SELECT max(accuracy) FROM fx_runs), 6) AS best_accuracy, (SELECT run FROM fx_runs ORDER BY training_seconds, run_order LIMIT 1) AS fastest_run, round((SELECT min(training_seconds) FROM fx_runs) / 3600, 2) AS fastest_hours, (SELECT run FROM fx_runs ORDER BY training_seconds DESC, run_order LIMIT 1) AS slowest_run, round((SELECT max(training_seconds) FROM fx_runs) / 3600, 2) AS slowest_hours")),
    "run7_check_run_records": (run7, RUN7_SQL),
    "inf2_top_k": (inf2, INF2_SQL),
    "inf3_attach_actual": (inf3, with_fixtures("fx_logits", more=_PATHS_SQL, then="SELECT path, CASE WHEN image_id % 2 = 0 THEN label::VARCHAR END AS actual_label FROM p")),
    "inf4_parse_labels": (inf4, INF4_SQL),
    "inf5_prediction_records": (inf5, INF5_SQL),
    "src2_union_batches": (src2, SRC2_SQL),
    "src3_class_names": (src3, with_fixtures("fx_logits", "fx_classes", more="b AS (SELECT image_id, (label + image_id % 2 * 5)::BIGINT AS label FROM fx_logits)", then="SELECT image_id, b.label, class_name FROM b LEFT JOIN fx_classes c ON b.label = c.label")),
    "src5_checksums": (src5, "SELECT 'part=' || (doc_id // 100) AS path, md5(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS md5, (doc_id // 100) % 10 <> 0 AS ok FROM documents GROUP BY doc_id // 100"),
    "src6_manifest": (src6, with_fixtures("fx_logits", then="SELECT format('class_{}_{:05d}.png', label, image_id) AS file_name, label, 'class_' || label AS class_name, image_id AS test_index FROM fx_logits WHERE image_id % 2 = 0")),
    "lbl1_encode_labels": (lbl1, "SELECT event_id, event_type, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS class_index FROM events"),
    "tre1_gini": (tre1, with_fixtures("fx_big", more="k AS (SELECT id % 7 AS node, label, count(*) AS k FROM fx_big GROUP BY 1, 2)", then="SELECT node, sum(k)::BIGINT AS n, round(1 - sum(k::DOUBLE * k) / (sum(k)::DOUBLE * sum(k)), 9) AS gini FROM k GROUP BY node")),
    "tre2_candidate_thresholds": (tre2, with_fixtures("fx_big", more=_LONG_SQL + ", " + _CAND_SQL.format(k=31, t=30), then="SELECT node, feature, round(threshold, 6) AS threshold FROM th")),
    "tre3_best_split": (tre3, TRE3_SQL),
    "tre4_feature_subset": (tre4, TRE4_SQL),
}
