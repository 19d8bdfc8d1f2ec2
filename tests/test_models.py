"""SVM, trees, forests, metrics, inference, sources."""

import struct
import zlib
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import evidence, forest, inference, metrics, runs, sampling, svm
from lumenframe.plans import catalog, jobs
from lumenframe.sources import artifacts, images
from lumenframe.streaming.scoring import score_stream

from .compare import same


def blobs(spark, n=30):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.2, (n, 2)) for c in ((-2, -2), (2, -2), (0, 2))])
    rows = [(i, i // n, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "image_id long, label int, features array<double>")


@pytest.mark.parametrize("mode,parts", [("average", 1), ("average", 4), ("batch", 3)])
def test_svm_learns_blobs(spark, mode, parts):
    df = blobs(spark).repartition(parts)
    w, h = svm.svm_fit(df, lr=0.05 if mode == "average" else 0.5, epochs=30, batch_size=15, seed=1, mode=mode)
    p = svm.svm_scores(df, w)
    assert p.where("label = prediction").count() / 90 > 0.98
    loss = [r.loss for r in h.orderBy("epoch").collect()]
    assert loss[-1] < loss[0]


def test_svm_rejects_shapes(spark):
    bad = spark.createDataFrame([(0, 0, [1.0]), (1, 1, [1.0, 2.0])], "image_id long, label int, features array<double>")
    with pytest.raises(ValueError):
        svm.svm_fit(bad)
    with pytest.raises(ValueError):
        svm.svm_fit(bad.limit(0))


def test_tree_learns_a_step(spark):
    df = spark.createDataFrame([(i, int(i >= 10), [float(i)]) for i in range(20)], "image_id long, label int, features array<double>")
    nodes = forest.tree_fit(df, max_depth=2, max_features=1, seed=1)
    assert forest.tree_predict(df, nodes).where("label != prediction").count() == 0


def test_forest(spark):
    df = blobs(spark)
    nodes = forest.forest_fit(df, num_trees=5, max_depth=5, seed=2)
    p = forest.forest_predict(df, nodes)
    assert {r.prediction for r in p.collect()} <= {0, 1, 2} and p.where("label = prediction").count() > 80
    same = forest.forest_fit(df.repartition(3), num_trees=5, max_depth=5, seed=2)
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, same.collect()))
    assert {r.tree for r in forest.forest_fit(df, num_trees=2, max_depth=2, bootstrap="poisson").collect()} == {0, 1}
    with pytest.raises(ValueError):
        forest.forest_fit(df.withColumn("label", F.col("label") + 1))


def test_perfect_prediction(spark):
    df = blobs(spark).withColumn("prediction", F.col("label"))
    assert metrics.classification_summary(df, 3).first().macro_f1 == 1
    assert metrics.classification_summary(df.limit(0), 3).first().accuracy == 0


def test_split_properties(spark):
    df = spark.createDataFrame([(i, i // 20) for i in range(60)], "id long, label int")
    out = sampling.stratified_split(df, "label", "id", 0.2, seed=7)
    assert out.count() == 60
    assert [r["count"] for r in out.where("split = 'validation'").groupBy("label").count().collect()] == [4, 4, 4]
    results = [sorted(map(tuple, sampling.stratified_split(df.repartition(n), "label", "id", 0.2, seed=7).collect())) for n in (1, 3, 8)]
    assert results[0] == results[1] == results[2]
    with pytest.raises(ValueError):
        sampling.stratified_split(df, "label", "id", 1.0)
    one = spark.createDataFrame([(1, 5)], "id long, label int")
    assert sampling.stratified_split(one, "label", "id").first().split == "validation"


def test_limits(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(100)], "id long, label int")
    assert sampling.limit_stratified(df, "label", "id", None).count() == 100
    assert sampling.limit_stratified(df, "label", "id", 3).count() == 3
    assert sampling.balanced_limit(df, "label", "id", 20, n_classes=7).count() == 20
    with pytest.raises(ValueError):
        sampling.balanced_limit(df, "label", "id", 5, n_classes=7)
    with pytest.raises(ValueError):
        sampling.balanced_limit(df, "label", "id", 700, n_classes=7)
    with pytest.raises(ValueError):
        sampling.select_indices(df, [3, 100], "id")
    assert sampling.bootstrap_weights(df, "id", 2).groupBy("tree").agg(F.sum("weight").alias("w")).where("w = 100").count() == 2
    assert [r.row for r in sampling.dense_index(df.select("id"), "id").orderBy("id").collect()] == list(range(100))


def test_evidence_edges(spark):
    df = spark.createDataFrame([(0, 1, 1, [0.5, 2.0]), (1, 0, 0, None), (2, 0, 0, [3.0])], "image_id long, label int, prediction int, scores array<double>")
    assert [r.margin for r in evidence.margins(df).orderBy("image_id").collect()] == [1.5, 0.0, 0.0]
    e = evidence.evidence_summary(df).first()
    assert e.num_errors == 0 and e.mean_margin_error is None
    with pytest.raises(Exception):
        evidence.margins(df.withColumn("image_id", F.lit(-1))).collect()
    losses = spark.createDataFrame([(i, True, float(i)) for i in range(5)], "image_id long, correct boolean, loss double")
    with pytest.raises(ValueError):
        evidence.representatives(losses)
    both = losses.unionByName(losses.withColumn("correct", F.lit(False)))
    assert {r.image_id for r in evidence.representatives(both).collect()} == {2}


def png(path, pixels):
    """Gray or RGB bytes as a PNG file."""
    x = np.asarray(pixels, np.uint8)
    h, w = x.shape[:2]

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + row.tobytes() for row in x)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if x.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_bundle_and_inference(spark, tmp_path):
    (tmp_path / "in").mkdir()
    png(tmp_path / "in" / "cat_00001.png", np.full((41, 19), 250))
    red = np.zeros((32, 32, 3))
    red[..., 0] = 40
    png(tmp_path / "in" / "dog_00002.png", red)
    read = {r.path.rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path / "in")).collect()}
    assert len(read["cat_00001.png"].pixels) == 3072 and set(read["cat_00001.png"].pixels) == {250}
    assert bytes(read["dog_00002.png"].pixels) == red.astype(np.uint8).tobytes()

    rows = [(i, "train", int(i >= 10), bytearray([0 if i < 10 else 255] * 3072)) for i in range(20)]
    train = spark.createDataFrame(rows, "image_id long, split string, label int, pixels binary")
    bundle = jobs.train_svm(jobs.extract(train, "pixel"), ["dark", "bright"], "pixel", lr=0.1, epochs=10, batch_size=4, seed=1)
    artifacts.save_bundle(str(tmp_path / "model"), bundle["scaler"], bundle["classes"], bundle["feature"], weights=bundle["weights"])
    loaded = artifacts.load_bundle(spark, str(tmp_path / "model"))
    assert loaded["feature"] == "pixel" and loaded["classes"] == ["dark", "bright"]
    images.write_manifest(spark.createDataFrame([("cat_00001.png", 1, "bright", 7)], "file_name string, label int, class_name string, test_index long"), str(tmp_path / "manifest"))
    records = {r.source.rsplit("/", 1)[1]: r for r in jobs.infer_files(spark, str(tmp_path / "in"), loaded, str(tmp_path / "manifest"), 2).collect()}
    assert records["cat_00001.png"].predicted_class == "bright" and records["cat_00001.png"].status == "correct"
    assert records["dog_00002.png"].predicted_class == "dark" and records["dog_00002.png"].status == "unknown"
    assert len(records["dog_00002.png"].top_k) == 2
    with pytest.raises(ValueError):
        inference.score_images(train, loaded | {"feature": "sift"})
    with pytest.raises(ValueError):
        inference.score_images(train, loaded | {"feature": None})

    train.write.parquet(str(tmp_path / "arriving"))
    stream = spark.readStream.schema(train.schema).parquet(str(tmp_path / "arriving"))
    score_stream(stream, loaded, str(tmp_path / "scored"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "scored")).where("label = prediction").count() == 20

    report = jobs.train_and_report(jobs.extract(train, "pixel").withColumn("split", F.when(F.col("image_id") % 2 == 0, "train").otherwise("test")), bundle, str(tmp_path / "out"))
    assert report.first().accuracy == 1
    found = jobs.error_evidence(spark, str(tmp_path / "out/predictions"), ["dark", "bright"])
    assert found["summary"].first().num_errors == 0 and found["gallery"].count() == 2


def test_image_files_are_listed_some_at_a_time(spark, sf_dir, monkeypatch):
    read, seen = images.read_images, []

    def noted(spark, path, *more, **named):
        seen.append(len(spark.read.format("image").load(path).inputFiles()))
        return read(spark, path, *more, **named)

    monkeypatch.setattr(images, "FILES_AT_ONCE", 125, raising=False)
    monkeypatch.setattr(images, "read_images", noted)
    assert len(same(spark, sf_dir, catalog.queries()["src4_read_images"], catalog.oracle_sql()["src4_read_images"])) == 500
    assert sum(seen) == 500 and max(seen) <= 150  # dealt by a hash
    with pytest.raises(ValueError):
        images.read_image_folders(spark, [], lambda df: df)


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", 0, [1.0]), (2, "test", 1, [2.0])], "image_id long, split string, label int, features array<float>")
    artifacts.write_features(df, str(tmp_path / "f"), {"feature": "hog", "parameters": {"cell_size": 4}, "seconds": 1.5})
    rows, meta = artifacts.read_features(spark, str(tmp_path / "f"))
    assert meta == {"feature": "hog", "parameters": {"cell_size": 4}, "seconds": 1.5} and rows.where("split = 'test'").first().image_id == 2
    old = spark.createDataFrame([(1, 0)], "label int, prediction int")
    assert artifacts.predictions(old).first().image_id == -1
    (tmp_path / "r.json").write_text('{"run": "a",\n "feature": "hog", "test": {"accuracy": 0.5}, "samples": {"test": 7}}')
    r = artifacts.read_runs(spark, str(tmp_path / "r.json")).first()
    assert r.test.accuracy == 0.5 and r.samples.test == 7
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.bin").write_bytes(b"abc")
    path = spark.read.format("binaryFile").load(str(tmp_path / "x")).first().path
    good = spark.createDataFrame([(path, "900150983cd24fb0d6963f7d28e17f72")], "path string, md5 string")
    assert images.verify_checksums(spark, str(tmp_path / "x"), good).first().ok
    with pytest.raises(ValueError):
        images.verify_checksums(spark, str(tmp_path / "x"), good.withColumn("md5", F.lit("0")))


def test_extract_archive(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, "test" if i >= 20 else "train", i % 2, bytearray(rng.integers(0, 256, 3072).astype(np.uint8).tobytes())) for i in range(26)]
    df = spark.createDataFrame(rows, "image_id long, split string, label int, pixels binary")
    jobs.extract_archive(df, str(tmp_path / "a"), "hog", train_limit=12, test_limit=4)
    rows, meta = artifacts.read_features(spark, str(tmp_path / "a"))
    assert {r.split: r["count"] for r in rows.groupBy("split").count().collect()} == {"train": 12, "validation": 2, "test": 4}
    assert meta["feature"] == "hog"


def test_runs_refuse(spark):
    a = spark.createDataFrame([("a", "hog", "svm", 200, 1), ("b", "hog", "rf", 100, 1)], "run string, feature string, model string, budget int, seed int")
    with pytest.raises(ValueError):
        runs.compare_runs(a, a.limit(0), a.select("feature", "model"))
    with pytest.raises(ValueError):
        runs.require_compatible(a, ["budget"])
    assert runs.require_compatible(a, ["seed"]).count() == 2
    with pytest.raises(ValueError):
        inference.check_counts([1], [])


def test_resize_equals_plain_loops(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(images, "RESIZE_AT_ONCE", 3000)  # two images of 19 x 41 at once

    def line(values, size):
        step = Fraction(len(values), size)
        out = []
        for o in range(size):
            near = [(max(Fraction(0), 1 - abs((j + Fraction(1, 2) - (o + Fraction(1, 2)) * step) / max(step, Fraction(1)))), int(v)) for j, v in enumerate(values)]
            out.append(floor(sum(w * v for w, v in near) / sum(w for w, _ in near) + Fraction(1, 2)))
        return out

    for h, w, c in ((19, 41, 1), (37, 23, 3), (32, 32, 3), (1, 5, 3)):
        x = rng.integers(0, 256, (3, h, w, c), dtype=np.uint8)
        got = images.resize(x, 32)
        for n in range(3):
            for k in range(c):
                across = np.array([line(row, 32) for row in x[n, :, :, k]])
                want = np.array([line(column, 32) for column in across.T]).T
                assert np.array_equal(got[n, :, :, k], want)


def test_forest_bundles_score_images(spark):
    rows = [(i, int(i >= 10), bytearray([0 if i < 10 else 255] * 3072)) for i in range(20)]
    df = spark.createDataFrame(rows, "image_id long, label int, pixels binary")
    bundle = jobs.train_forest(jobs.extract(df.withColumn("split", F.lit("train")), "pixel"), ["dark", "bright"], "pixel", num_trees=4, max_depth=2)
    got = inference.predict_images(df, bundle, 2)
    assert got.where("label = prediction AND scores IS NULL").count() == 20
