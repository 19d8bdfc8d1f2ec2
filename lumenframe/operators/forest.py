"""Decision trees and forests, grown level by level from counts of all open nodes at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_int, draw_uniform
from ..functions.vectors import add_columns, lists, matrix

NODES = "tree int, node long, is_leaf boolean, prediction int, feature int, threshold double"
#: (node, feature) pairs that are open in one job: their thresholds go to every task.
OPEN_AT_ONCE = 200_000
#: Rows that descend all trees together.
ROWS_AT_ONCE = 2048


def gini(df: DataFrame, group: list[str], label: str = "label") -> DataFrame:
    """(group, n, gini): 1 - sum of squared shares of the labels."""
    n = df.groupBy(*group, label).agg(F.count("*").alias("k"))
    return n.groupBy(*group).agg(F.sum("k").alias("n"), (1 - F.sum(F.col("k").cast("double") * F.col("k")) / (F.sum("k").cast("double") * F.sum("k"))).alias("gini"))


def long_features(df: DataFrame, features: list[int] | None = None) -> DataFrame:
    """(node, label, feature, x) rows of a feature table; of the given features only."""
    rows = df.select("node", "label", F.posexplode("features").alias("feature", "x"))
    return rows if features is None else rows.where(F.col("feature").isin(features))


def _few_values(long: DataFrame, most: int) -> DataFrame:
    """(node, feature, x) of the distinct values of each node and feature, of more than ``most`` some and the extremes.

    A task keeps up to ``most`` values of each pair, whatever the number of its rows.
    """

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            t = t.group_by(["node", "feature", "x"]).aggregate([]).sort_by([("node", "ascending"), ("feature", "ascending"), ("x", "ascending")]).combine_chunks()
            if not t.num_rows:
                continue
            new = np.ones(t.num_rows, dtype=bool)
            node, feature = t["node"].to_numpy(), t["feature"].to_numpy()
            new[1:] = (node[1:] != node[:-1]) | (feature[1:] != feature[:-1])
            first = np.flatnonzero(new)
            rank = np.arange(t.num_rows) - np.repeat(first, np.diff(np.append(first, t.num_rows)))
            held = t.filter(pa.array((rank < most - 1) | np.append(new[1:], True)))
        if held is not None:
            yield from held.to_batches()

    own = long.select("node", "feature", F.col("x").cast("double").alias("x"))
    return own.mapInArrow(run, own.schema).distinct()


def candidate_thresholds(long: DataFrame, t: int = 16, seed: int = 42) -> DataFrame:
    """(node, feature, threshold): none if all values are equal; the middles between neighbours if there are up to t + 1
    values; otherwise t uniform draws between the extremes."""
    values = _few_values(long, t + 2)
    v = values.groupBy("node", "feature").agg(F.array_sort(F.collect_list("x")).alias("v")).where(F.size("v") > 1)  # up to t + 2 a task
    lo, hi = F.get("v", 0), F.element_at("v", -1)
    middles = F.transform(F.slice("v", 2, F.size("v") - 1), lambda x, i: (x + F.get("v", i)) / 2)
    drawn = F.transform(F.sequence(F.lit(0), F.lit(t - 1)), lambda i: lo + draw_uniform(seed, "node", "feature", i) * (hi - lo))
    return v.select("node", "feature", F.explode(F.when(F.size("v") <= t + 1, middles).otherwise(drawn)).alias("threshold"))


def best_split(df: DataFrame, thresholds: DataFrame, min_leaf: int = 2) -> DataFrame:
    """(node, feature, threshold, score): the lowest weighted gini of x <= threshold against the rest, both sides at
    least min_leaf rows; the first (feature, threshold) of equals.

    df: node, label (0, 1, 2 ...) and features, an array a row, which stays one: map tasks count rows by node, feature, gap
    between thresholds and label, and send those sums. thresholds: node, feature, threshold, of OPEN_AT_ONCE (node, feature)
    at most, like a level of a forest.
    """
    found = thresholds.groupBy(F.col("node").cast("long").alias("node"), "feature").agg(F.array_sort(F.collect_set("threshold")).alias("cuts"))
    cuts, classes = _lists(found.limit(OPEN_AT_ONCE + 1), ("node", "feature")), int(df.agg(F.max("label")).first()[0] or 0) + 1
    if len(cuts) > OPEN_AT_ONCE:
        raise ValueError(f"more than {OPEN_AT_ONCE} (node, feature) pairs: split the nodes")
    shared, of_node = df.sparkSession.sparkContext.broadcast(cuts), {}
    for node, feature in cuts:
        of_node.setdefault(node, []).append(feature)

    def counts(batches):
        total: dict = {}
        for b in batches:
            x, y, node = matrix(b.column("features")), b.column("label").to_numpy().astype(np.int64), b.column("node").to_numpy()
            for i in _runs(node, np.arange(len(node))):
                for f in of_node.get(int(node[i[0]]), ()):
                    cut = shared.value[int(node[i[0]]), f]
                    n = np.bincount(np.searchsorted(cut, x[i, f]) * classes + y[i], minlength=(len(cut) + 1) * classes)
                    key = (int(node[i[0]]), f)
                    total[key] = total.get(key, 0) + n
        keys = list(total)
        for at in range(0, len(keys), 4096):
            some = keys[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in some], pa.int64()), pa.array([k[1] for k in some], pa.int32()), pa.array([total[k].tolist() for k in some], pa.list_(pa.float64()))], names=["node", "feature", "v"])

    def judge(group: pa.Table) -> pa.Table:
        node, f = group["node"][0].as_py(), group["feature"][0].as_py()
        score, threshold = _split_of(sum(matrix(c).sum(axis=0) for c in group["v"].chunks), shared.value[node, f], classes, min_leaf)
        return pa.table({"node": pa.array([node]), "feature": pa.array([f], pa.int32()), "threshold": [threshold], "score": [score]})

    sums = df.select(F.col("node").cast("long").alias("node"), "label", "features").mapInArrow(counts, "node long, feature int, v array<double>")
    each = sums.groupBy("node", "feature").applyInArrow(judge, "node long, feature int, threshold double, score double").where(F.col("score") < float("inf"))
    return each.groupBy("node").agg(F.min(F.struct("score", "feature", "threshold")).alias("b")).select("node", "b.feature", "b.threshold", "b.score")


def subset_size(d: int, max_features: str | float | int) -> int:
    if max_features == "sqrt":
        return max(1, int(np.sqrt(d)))
    m = round(d * max_features) if isinstance(max_features, float) else int(max_features)
    return min(max(m, 1), d)


def feature_subset(nodes: DataFrame, d: int, max_features: str | float | int = "sqrt", seed: int = 42) -> DataFrame:
    """(tree, node, feature): the m features that a node may split on, drawn with m numbers (Floyd's sampling).

    For j = d - m .. d - 1 a number up to j is drawn from (seed, tree, node, j); it is taken, or j if it was taken before.
    """
    m = subset_size(d, max_features)
    numbers = F.transform(F.sequence(F.lit(d - m), F.lit(d - 1)), lambda j: F.struct(j.alias("j"), (draw_int(seed, "tree", "node", j) % (j + 1)).cast("int").alias("t")))
    taken = F.aggregate(numbers, F.array().cast("array<int>"), lambda own, x: F.array_append(own, F.when(F.array_contains(own, x["t"]), x["j"]).otherwise(x["t"])))
    return nodes.select("tree", "node", F.explode(taken).alias("feature"))


class Trees:
    """All nodes of all trees as flat arrays: a row descends by gathers, all trees at once.

    Places are heap positions: children of n are 2n + 1 and 2n + 2. A leaf is its own child; so is a child that is not listed
    (an open node).
    """

    def __init__(self, rows, trees: int | None = None):
        listed = {(tree, node): (leaf, prediction, feature, threshold) for tree, node, leaf, prediction, feature, threshold in rows}
        self.trees = list(range(trees)) if trees is not None else sorted({t for t, _ in listed})
        keys = {(t, 0) for t in self.trees} | set(listed)
        keys |= {(t, 2 * n + side) for (t, n), v in listed.items() if not v[0] for side in (1, 2)}
        keys = sorted(keys)
        index = {key: i for i, key in enumerate(keys)}
        n = len(keys)
        self.tree, self.node = np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64)
        self.feature, self.threshold, self.prediction = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n, np.int64)
        self.left = self.right = np.arange(n)
        self.left, self.right, self.roots = self.left.copy(), self.right.copy(), np.array([index[t, 0] for t in self.trees], np.int64)
        for key, (leaf, prediction, feature, threshold) in listed.items():
            i = index[key]
            self.prediction[i] = prediction
            if not leaf:
                self.feature[i], self.threshold[i] = feature, threshold
                self.left[i], self.right[i] = index[key[0], 2 * key[1] + 1], index[key[0], 2 * key[1] + 2]
        self.depth = max((int(k[1]) + 1).bit_length() for k in keys) if keys else 0

    def place(self, x: np.ndarray, trees: slice = slice(None)) -> np.ndarray:
        """(rows, trees): where in the arrays each row of x ends in each tree."""
        at = np.repeat(self.roots[trees][None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[row, self.feature[at]] > self.threshold[at]
            below = np.where(right, self.right[at], self.left[at])
            if (below == at).all():
                break
            at = below
        return at

    def predict(self, x: np.ndarray, trees: slice = slice(None)) -> np.ndarray:
        return self.prediction[self.place(x, trees)]

    def votes(self, x: np.ndarray, classes: int) -> np.ndarray:
        """(rows, classes): how many trees give each class."""
        out = np.zeros((len(x), classes), np.int32)
        for a in range(0, len(x), ROWS_AT_ONCE):
            own = self.predict(x[a : a + ROWS_AT_ONCE])
            cells = np.arange(len(own))[:, None] * classes + own
            out[a : a + len(own)] = np.bincount(cells.reshape(-1), minlength=len(own) * classes).reshape(-1, classes)
        return out


def _of(nodes: DataFrame | Trees) -> Trees:
    """A node table is the size of a model."""
    return nodes if isinstance(nodes, Trees) else Trees([tuple(r) for r in nodes.select("tree", "node", "is_leaf", "prediction", "feature", "threshold").collect()])


def tree_predict(df: DataFrame, nodes: DataFrame | Trees, tree: int = 0) -> DataFrame:
    """Adds prediction."""
    t = _of(nodes)
    own = slice(t.trees.index(tree), t.trees.index(tree) + 1)
    return add_columns(df, lambda f: {"prediction": pa.array(t.predict(matrix(f), own)[:, 0] if len(f) else [], pa.int32())}, ["features"], "prediction int")


def forest_predict(df: DataFrame, nodes: DataFrame | Trees) -> DataFrame:
    """Adds votes (a count a class) and prediction: the class with most trees, the lowest of equals."""
    t = _of(nodes)
    classes = 1 + int(t.prediction.max(initial=0))

    def make(f):
        votes = t.votes(matrix(f), classes)
        return {"votes": lists(votes, pa.int32()), "prediction": pa.array(votes.argmax(axis=1) if len(votes) else [], pa.int32())}

    return add_columns(df, make, ["features"], "votes array<int>, prediction int")


def _weights(boots: pa.Array, trees: int) -> np.ndarray:
    """(rows, trees): how often each tree drew each row."""
    sizes = np.diff(boots.offsets.to_numpy())
    flat = boots.flatten()
    out = np.zeros((len(boots), trees))
    np.add.at(out, (np.repeat(np.arange(len(boots)), sizes), flat.field("tree").to_numpy()), flat.field("weight").to_numpy())
    return out


def _draw_int(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def _features(seed: int, tree: int, node: int, d: int, m: int) -> list[int]:
    """What feature_subset draws, in the drawn order; told again wherever it is needed, by m numbers."""
    taken: dict[int, None] = {}
    for j in range(d - m, d):
        t = _draw_int(f"{seed}:{tree}:{node}:{j}") % (j + 1)
        taken[j if t in taken else t] = None
    return list(taken)


def _cuts(seen: DataFrame, t: int, seed: int) -> dict:
    """(tree, node, feature) -> sorted thresholds, of the distinct values ``v`` of each (up to t + 2 of them, and the extremes).

    They are decided in tasks, where the values meet; as columns of OPEN_AT_ONCE lists at most they pass the driver to all tasks.
    """
    lo, hi = F.get("v", 0), F.element_at("v", -1)
    middles = F.transform(F.slice("v", 2, F.size("v") - 1), lambda x, i: (x + F.get("v", i)) / 2)
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(t - 1)), lambda i: lo + draw_uniform(seed, "tree", "node", "feature", i) * (hi - lo)))
    own = seen.where(F.size("v") > 1).select("tree", "node", "feature", F.when(F.size("v") <= t + 1, middles).otherwise(drawn).alias("cuts"))
    return _lists(own, ("tree", "node", "feature"))


def _lists(df: DataFrame, keys: tuple) -> dict:
    """keys -> the numbers of ``cuts``, as columns to the driver."""
    own = df.toArrow()
    if not own.num_rows:
        return {}
    cuts = own["cuts"].combine_chunks()
    flat, ends = cuts.flatten().to_numpy(), np.cumsum(np.append(0, cuts.value_lengths().to_numpy()))
    return {key: flat[a:b] for key, a, b in zip(zip(*[own[c].to_pylist() for c in keys]), ends[:-1].tolist(), ends[1:].tolist())}


def _split_of(c: np.ndarray, cut: np.ndarray, classes: int, min_leaf: int) -> tuple[float, float]:
    """(score, threshold) of the best split by class counts of the gaps between thresholds; infinite without one."""
    left = c.reshape(-1, classes).cumsum(axis=0)
    left, right = left[:-1], left[-1] - left[:-1]
    nl, nr = left.sum(axis=1), right.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.round((nl - (left**2).sum(axis=1) / nl + nr - (right**2).sum(axis=1) / nr) / (nl + nr), 12)
    score[(nl < min_leaf) | (nr < min_leaf)] = np.inf
    best = int(np.argmin(score))
    return float(score[best]), float(cut[best])


def _runs(key: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """``rows`` by equal keys."""
    by = np.argsort(key, kind="stable")
    return np.split(rows[by], np.flatnonzero(np.diff(key[by])) + 1) if len(by) else []


def _level(rows: DataFrame, trees: Trees, n_trees: int, open_: list, d: int, classes: int, t: int, min_leaf: int, m: int, seed: int):
    """(tree, node) -> (class counts, (feature, threshold) of the best split or None), of some open nodes: two map jobs with small sums.

    The first finds extremes and up to t + 2 distinct values of each (tree, node, feature); the second counts classes
    between thresholds. Both send one row a task and (tree, node, feature), whatever the number of rows; sums and best
    splits are found in tasks, and the driver gets one row a node.
    """
    wanted = set(open_)
    asked = sorted({tree for tree, _ in wanted})
    most = t + 2

    def grouped(batches):
        drawn: dict = {}
        for b in batches:
            x, y = matrix(b.column("features")), b.column("label").to_numpy()
            if not len(x):
                continue
            weights, at = _weights(b.column("boots"), n_trees), trees.place(x)
            for tree in asked:
                used = np.flatnonzero(weights[:, tree])
                for i in _runs(at[used, tree], used):
                    node = int(trees.node[at[i[0], tree]])
                    if (tree, node) in wanted:
                        if (tree, node) not in drawn:
                            drawn[tree, node] = _features(seed, tree, node, d, m)
                        yield tree, node, drawn[tree, node], x[i], y[i], weights[i, tree]

    def values(batches):
        found: dict = {}
        for tree, node, features, x, _, _ in grouped(batches):
            for place, f in enumerate(features):
                v = np.unique(x[:, f])
                old = found.get((tree, node, place, f))
                if old is not None:
                    v = np.unique(np.concatenate([old, v]))
                found[tree, node, place, f] = v if len(v) <= most else np.concatenate([v[: most - 1], v[-1:]])
        yield from _rows(found)

    def _rows(found: dict):
        keys = list(found)
        for at in range(0, len(keys), 4096):
            some = keys[at : at + 4096]
            columns = [pa.array([k[j] for k in some], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([found[k].tolist() for k in some], pa.list_(pa.float64()))], names=["tree", "node", "place", "feature", "v"])

    ddl = "tree int, node long, place int, feature int, v array<double>"
    seen = rows.mapInArrow(values, ddl).groupBy("tree", "node", "feature").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))).alias("v"))
    cuts = rows.sparkSession.sparkContext.broadcast(_cuts(seen, t, seed))

    def counts(batches):
        total: dict = {}
        for tree, node, features, x, y, w in grouped(batches):
            key = (tree, node, -1, -1)
            total[key] = total.get(key, 0) + np.bincount(y, w, classes)
            for place, f in enumerate(features):
                cut = cuts.value.get((tree, node, f))
                if cut is not None:
                    cell = np.searchsorted(cut, x[:, f]) * classes + y
                    total[tree, node, place, f] = total.get((tree, node, place, f), 0) + np.bincount(cell, w, (len(cut) + 1) * classes)
        yield from _rows(total)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one (tree, node, feature): class counts (feature -1), or score and threshold of its best split."""
        c, head = 0.0, None
        for b in batches:
            if b.num_rows:
                c = c + matrix(b.column("v")).sum(axis=0)
                head = head or {k: b.column(k).slice(0, 1) for k in ("tree", "node", "place", "feature")}
        if head is None:
            return
        v, f = c, head["feature"][0].as_py()
        if f >= 0:
            v = np.array(_split_of(c, cuts.value[head["tree"][0].as_py(), head["node"][0].as_py(), f], classes, min_leaf))
        yield pa.RecordBatch.from_pydict(head | {"v": lists(v[None])})

    judged = rows.mapInArrow(counts, ddl).groupBy("tree", "node", "feature").applyInArrow(judge, ddl)
    split = F.when((F.col("feature") >= 0) & (F.get("v", 0) < float("inf")), F.struct(F.get("v", 0).alias("score"), "place", F.get("v", 1).alias("threshold"), "feature"))
    nodes = judged.groupBy("tree", "node").agg(F.max(F.when(F.col("feature") < 0, F.col("v"))).alias("own"), F.min(split).alias("best")).collect()
    return {(r["tree"], r["node"]): (np.array(r["own"]), r["best"] and (r["best"]["feature"], r["best"]["threshold"])) for r in nodes}


def forest_fit(
    df: DataFrame, num_trees: int = 50, max_depth: int = 15, min_samples_split: int = 4, min_samples_leaf: int = 2, max_features="sqrt", num_thresholds: int = 16, sample_fraction: float = 1.0, seed: int = 42, bootstrap: str | None = "split", id_: str = "image_id", engine: str = "levels"
) -> DataFrame:
    """Nodes of ``num_trees`` trees from features and label 0 .. C - 1 (all of them present).

    bootstrap: split, exact or poisson weights (bootstrap_weights), or None for every row once. engine ``ml`` returns Spark ML's
    fitted RandomForestClassificationModel instead, with its own stopping rules.
    """
    labels = sorted(r[0] for r in df.select("label").distinct().collect())
    if labels != list(range(len(labels))) or not labels:
        raise ValueError("labels must be 0 .. C - 1")
    if engine == "ml":
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.functions import array_to_vector

        vectors = df.select("label", array_to_vector(F.col("features").cast("array<double>")).alias("features"))
        return RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, minInstancesPerNode=min_samples_leaf, subsamplingRate=sample_fraction, seed=seed).fit(vectors)
    from .sampling import bootstrap_counts, bootstrap_weights

    d, classes = len(df.select("features").first()[0]), len(labels)
    m = subset_size(d, max_features)
    base = df.select(id_, "features", F.col("label").cast("int").alias("label"))
    if bootstrap == "split":
        base = base.join(bootstrap_counts(df.select(id_), id_, num_trees, sample_fraction, seed), id_)
    elif bootstrap:
        w = bootstrap_weights(df.select(id_), id_, num_trees, sample_fraction, seed, bootstrap).groupBy(id_).agg(F.collect_list(F.struct(F.col("tree").cast("int").alias("tree"), F.col("weight").cast("int").alias("weight"))).alias("boots"))
        base = base.join(w, id_)
    else:
        base = base.withColumn("boots", F.array(*[F.struct(F.lit(i).alias("tree"), F.lit(1).alias("weight")) for i in range(num_trees)]))
    rows = base.select("features", "label", "boots").persist()
    done, open_ = [], {(tree, 0): 0 for tree in range(num_trees)}
    try:
        while open_:
            found, children, keys, step = {}, {}, list(open_), max(1, OPEN_AT_ONCE // m)
            for at in range(0, len(keys), step):
                found |= _level(rows, Trees(done, num_trees), num_trees, keys[at : at + step], d, classes, num_thresholds, min_samples_leaf, m, seed)
            for key, depth in open_.items():
                c, best = found[key]
                prediction, n = int(np.argmax(c)), c.sum()
                if depth >= max_depth or n < min_samples_split or (c > 0).sum() < 2 or best is None:
                    done.append((*key, True, prediction, -1, 0.0))
                    continue
                f, threshold = best
                done.append((*key, False, prediction, f, threshold))
                children[key[0], 2 * key[1] + 1] = children[key[0], 2 * key[1] + 2] = depth + 1
            open_ = children
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(done, NODES)


def tree_fit(df: DataFrame, max_depth: int = 15, min_samples_split: int = 4, min_samples_leaf: int = 2, max_features="sqrt", num_thresholds: int = 16, seed: int = 42, id_: str = "image_id") -> DataFrame:
    """Nodes of one tree on all rows."""
    return forest_fit(df, 1, max_depth, min_samples_split, min_samples_leaf, max_features, num_thresholds, seed=seed, bootstrap=None, id_=id_)
