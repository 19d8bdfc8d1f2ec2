"""Places and first rows found by counts, against sorting; sums of arrays; splits by gaps against all thresholds."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions.draws import first_by_key
from lumenframe.functions.vectors import bytes_matrix, sum_arrays
from lumenframe.operators import evidence, forest, sampling


@pytest.mark.parametrize("cells,few", [(4, 1), (4, 20), (4096, 4096)])
def test_order_statistics_equal_sorting(spark, monkeypatch, cells, few):
    monkeypatch.setattr(evidence, "CELLS", cells)
    monkeypatch.setattr(evidence, "FEW", few)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=300), np.zeros(200), np.full(20, 1e9), rng.normal(size=50) * 1e-9])
    df = spark.createDataFrame([(float(v), i % 2 == 0) for i, v in enumerate(values)] + [(None, True)], "v double, even boolean")
    asked = {(even, k): (F.col("even") == even, k, None) for even in (True, False) for k in (0, 1, 100, 140, 200, 283, 284)}
    got = evidence.order_statistics(df, "v", asked)
    own = {even: sorted(v for i, v in enumerate(values) if (i % 2 == 0) == even) for even in (True, False)}
    assert got == {(even, k): (own[even][k], k - own[even].index(own[even][k])) for even, k in asked}


def test_summary_of_one_group(spark):
    rows = [(i, 0, 0, [float(i), 0.0]) for i in range(5)]
    got = evidence.evidence_summary(spark.createDataFrame(rows, "image_id long, label int, prediction int, scores array<double>")).first()
    assert got.median_margin_correct == 2.0 and got.median_margin_error is None and got.num_errors == 0
    empty = evidence.evidence_summary(spark.createDataFrame([], "image_id long, label int, prediction int, scores array<double>")).first()
    assert empty.num_samples == 0 and empty.median_margin_correct is None


@pytest.mark.parametrize("n", [0, 1, 7, 199, 200, 500])
def test_first_by_key_equals_sorting(spark, n):
    df = spark.createDataFrame([(i,) for i in range(200)], "id long")
    want = sorted(range(200), key=lambda i: (hashlib.md5(f"s:{i}".encode()).hexdigest(), i))[:n]
    assert sorted(r.id for r in first_by_key(df, "id", "s", n).collect()) == sorted(want)


def test_sums_of_arrays_in_two_levels(spark):
    df = spark.range(0, 1000, 1, 90).select((F.col("id") % 3).cast("int").alias("k"), F.lit(1.0).alias("n"), F.array(F.col("id").cast("double"), F.lit(2.0)).alias("sums"))
    got = {r.k: (r.n, r.sums) for r in sum_arrays(df, ["k"], "k int, n double, sums array<double>").collect()}
    assert got == {k: (len(range(k, 1000, 3)), [float(sum(range(k, 1000, 3))), 2.0 * len(range(k, 1000, 3))]) for k in range(3)}


def test_bytes_of_one_length_are_needed():
    import pyarrow as pa

    column = pa.array([b"abcd", b"efgh", b"ijkl"], pa.binary()).slice(1)
    assert bytes_matrix(column).tobytes() == b"efghijkl"
    with pytest.raises(ValueError):
        bytes_matrix(pa.array([b"ab", b"abc"], pa.binary()))


def test_digest_has_more_buckets_for_more_ids(spark):
    df = spark.range(500).select(F.col("id").alias("image_id"), F.lit("a").alias("split"))
    one, two = (sampling.split_digest(d, bucket_rows=1).collect() for d in (df, df.repartition(7)))
    assert sorted(one) == sorted(two) != sorted(sampling.split_digest(df.where("image_id > 0"), bucket_rows=1).collect())


def test_best_split_equals_all_splits(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 3)), int(rng.integers(0, 3)), [float(rng.integers(0, 5)), float(rng.normal())]) for _ in range(300)]
    df = spark.createDataFrame(rows, "node int, label int, features array<double>").repartition(5)
    long = forest.long_features(df)
    cuts = forest.candidate_thresholds(long, 8)
    by = {}
    for r in cuts.collect():
        by.setdefault((r.node, r.feature), []).append(r.threshold)
    for node in range(3):
        values = sorted({f[0] for n, _, f in rows if n == node})
        assert sorted(by[node, 0]) == [(a + b) / 2 for a, b in zip(values, values[1:])]
        assert len(by[node, 1]) == 8 and all(min(f[1] for n, _, f in rows if n == node) <= t <= max(f[1] for n, _, f in rows if n == node) for t in by[node, 1])
    want = {}
    for (node, feature), thresholds in by.items():
        for t in thresholds:
            sides = [[y for n, y, f in rows if n == node and (f[feature] <= t) == left] for left in (True, False)]
            if min(map(len, sides)) >= 2:
                impurity = sum(len(s) - sum(s.count(c) ** 2 for c in set(s)) / len(s) for s in sides) / sum(map(len, sides))
                want[node] = min(want.get(node, (math.inf,)), (round(impurity, 12), feature, t))
    got = {r.node: (r.score, r.feature, r.threshold) for r in forest.best_split(df, cuts).collect()}
    assert {n: pytest.approx(v, abs=1e-9) for n, v in want.items()} == got


def test_features_are_drawn_alike_in_sql_and_tasks(spark):
    nodes = spark.range(40).select((F.col("id") % 4).cast("int").alias("tree"), F.col("id").alias("node"))
    for d, m in ((10, 3), (5, 5), (7, 1)):
        got = {}
        for r in forest.feature_subset(nodes, d, m, 9).collect():
            got.setdefault((r.tree, r.node), []).append(r.feature)
        assert got == {(i % 4, i): forest._features(9, i % 4, i, d, m) for i in range(40)}
        assert all(len(set(f)) == m and set(f) <= set(range(d)) for f in got.values())


def test_compiled_trees_descend_as_their_nodes_say():
    rng = np.random.default_rng(3)
    rows = []
    for tree in range(6):
        open_ = [0]
        while open_:
            n = open_.pop()
            leaf = n > 60 or rng.random() < 0.3
            if not (n and rng.random() < 0.1):  # some nodes are open: not listed
                rows.append((tree, n, leaf, int(rng.integers(0, 5)), -1 if leaf else int(rng.integers(0, 4)), 0.0 if leaf else float(rng.normal())))
                open_ += [] if leaf else [2 * n + 1, 2 * n + 2]
    x = rng.normal(size=(300, 4))
    trees, listed = forest.Trees(rows), {(r[0], r[1]): r for r in rows}
    at = trees.place(x)
    for i in range(300):
        for tree in range(6):
            n = 0
            while (tree, n) in listed and not listed[tree, n][2]:
                _, _, _, _, f, threshold = listed[tree, n]
                n = 2 * n + 1 + int(x[i, f] > threshold)
            assert (trees.tree[at[i, tree]], trees.node[at[i, tree]]) == (tree, n)
            assert (tree, n) not in listed or trees.prediction[at[i, tree]] == listed[tree, n][3]


def test_mini_batches_hold_a_few_batches_only():
    import tracemalloc

    import pyarrow as pa
    from lumenframe.functions.vectors import lists
    from lumenframe.operators.svm import mini_batches

    x = np.arange(1000 * 64, dtype=np.float32).reshape(1000, 64)

    def stream(n):
        for _ in range(n):
            yield pa.RecordBatch.from_arrays([lists(x, pa.float32()), pa.array(np.arange(1000, dtype=np.int32))], names=["features", "label"])

    whole = list(mini_batches(stream(3), 256))
    assert [len(y) for _, y in whole] == [256] * 11 + [184]
    assert np.array_equal(np.concatenate([a for a, _ in whole]), np.concatenate([x] * 3)) and whole[4][1][0] == 24
    tracemalloc.start()
    assert sum(len(y) for _, y in mini_batches(stream(100), 256)) == 100_000
    assert tracemalloc.get_traced_memory()[1] < 5 * x.nbytes  # of a hundred batches
    tracemalloc.stop()


def test_split_draws_are_those_of_a_multinomial(monkeypatch):
    monkeypatch.setattr(sampling, "CELL", 4)  # 70 rows: five groups, the last cut, its last cell too
    n, draws, trees = 70, 90, 3000
    whole = np.concatenate([sampling.Splits(n, draws, trees, 5).cell(c) for c in range(18)], axis=1)
    assert whole.shape == (trees, n) and (whole.sum(axis=1) == draws).all()
    p = 1 / n
    assert np.abs(whole.mean(axis=0) - draws * p).max() < 5 * np.sqrt(draws * p / trees)
    assert np.abs(whole.var(axis=0) / (draws * p * (1 - p)) - 1).max() < 0.2
    pairs = np.cov(whole, rowvar=False)  # rows of one cell, one group and others alike
    for i, j in ((0, 1), (0, 5), (0, 40), (3, 69)):
        assert abs(pairs[i, j] + draws * p * p) < 0.1
    late = sampling.Splits(n, draws, trees, 5)
    assert np.array_equal(late.cell(17), whole[:, 68:]) and np.array_equal(late.cell(3), whole[:, 12:16])
    assert not np.array_equal(whole[0], whole[1]) and not np.array_equal(sampling.Splits(n, draws, 1, 6).cell(0)[0], whole[0, :4])


def test_split_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(9001).select((F.col("id") * 3).alias("id"))  # three cells
    one, two = (sorted(map(tuple, sampling.bootstrap_weights(d, "id", 2, 0.5, 7, "split").collect())) for d in (df.repartition(1), df.repartition(13)))
    assert one == two and [sum(w for t, _, w in one if t == tree) for tree in (0, 1)] == [4500, 4500]
    texts = df.limit(5).select(F.col("id").cast("string").alias("name"))
    counts = sampling.bootstrap_counts(texts, "name", 3)
    assert counts.count() == 5 and counts.schema["name"].dataType.simpleString() == "string"
    assert sampling.bootstrap_weights(df.limit(0), "id", 2, mode="split").count() == 0
