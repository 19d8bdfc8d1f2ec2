"""Hard negatives: rotated one-bit codes bound every inner product, and only what the bounds leave is scored."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import lists, matrix
from ._shared import stash, table
from ._text import U64, release

#: A task compares so many anchors with so many rows.
ROWS, ANCHORS = 1 << 17, 1 << 14
#: With little data a task gets fewer rows, but so many at least.
LEAST_ROWS = 1 << 11
#: Rows that are bounded at once.
AT_ONCE = 1 << 14
#: Bits of a rotated anchor's components.
QUERY_BITS = 6
#: Bounds are widened by so much of the norms' product, for rounding.
SLACK = 1e-9
#: One-bit codes of a vector: each of what the ones before leave.
LEVELS = 4
CODED = "vec_id long, label long, v array<long>, code array<long>, along array<double>, across double"


@lru_cache(maxsize=2)
def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def encode(v: np.ndarray, seed: int, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, along, across) of each vector.

    A code has the signs of the rotated components as bits; along is the vector's length along that direction (their
    alignment times its norm). What is left is coded in the same way, ``levels`` times; across is the length of the last rest.
    """
    n, d = v.shape
    rest = v.astype(np.float64) @ rotation(d, seed).T
    code, along = [], np.zeros((n, levels))
    for j in range(levels):
        signs = np.zeros((n, -(-d // 64) * 64), np.uint8)
        signs[:, :d] = rest >= 0
        along[:, j] = np.abs(rest).sum(axis=1) / np.sqrt(d)
        rest = rest - np.where(rest >= 0, 1, -1) * (along[:, j] / np.sqrt(d))[:, None]
        code.append(np.packbits(signs, axis=1, bitorder="little").view(U64))
    return np.concatenate(code, axis=1), along, np.sqrt((rest**2).sum(axis=1))


class Anchor:
    """An anchor as the codes are asked about it: its rotated components in QUERY_BITS bits, by bit planes."""

    def __init__(self, v: np.ndarray, seed: int):
        self.v, self.norm = v, float(np.sqrt((v.astype(np.float64) ** 2).sum()))
        self.d = d = len(v)
        turned = rotation(d, seed) @ v.astype(np.float64)
        self.low = turned.min()
        self.step = (turned.max() - self.low) / (2**QUERY_BITS - 1) or 1.0
        steps = np.rint((turned - self.low) / self.step).astype(np.int64)
        self.total = float((self.low + self.step * steps).sum())
        self.error = float(np.sqrt(((turned - self.low - self.step * steps) ** 2).sum()))
        bits = np.zeros((QUERY_BITS, -(-d // 64) * 64), np.uint8)
        bits[:, :d] = (steps[None, :] >> np.arange(QUERY_BITS)[:, None]) & 1
        self.planes = np.packbits(bits, axis=1, bitorder="little").view(U64)

    def bounds(self, code: np.ndarray, along: np.ndarray, across: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest inner product that each coded row can have with the anchor.

        A row is its parts along its codes' directions and a rest. The anchor's parts along those come from popcounts, up to
        the error of its bits; the rest is across the last direction, so its product is bounded by the rest's length times
        that of the anchor across it (Cauchy-Schwarz).
        """
        words, middle = len(self.planes[0]), 0.0
        for j in range(along.shape[1]):
            own = code[:, j * words : (j + 1) * words]
            count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.float64)
            chosen = self.low * count(own) + self.step * sum(2.0**k * count(own & p) for k, p in enumerate(self.planes))
            mine = (2 * chosen - self.total) / np.sqrt(self.d)
            middle = middle + along[:, j] * mine
        rest = np.sqrt(np.maximum(self.norm**2 - np.maximum(np.abs(mine) - self.error, 0) ** 2, 0))
        lengths = along.sum(axis=1)
        half = lengths * self.error + across * rest + SLACK * (lengths + across) * self.norm
        return middle - half, middle + half


class Coded:
    """The rows of a task as arrays."""

    def __init__(self, t: pa.Table):
        t = t.sort_by("own_vec_id").combine_chunks()
        self.id, self.label = t["own_vec_id"].to_numpy(), t["own_label"].to_numpy()
        ints = matrix(t["own_v"].combine_chunks(), np.int64)
        self.code = matrix(t["own_code"].combine_chunks(), np.int64).view(U64)
        self.along, self.across = matrix(t["own_along"].combine_chunks()), t["own_across"].to_numpy()
        top = float((ints.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
        self.v = ints.astype(np.float32 if top < 2**23 else np.float64 if top < 2**52 else np.int64)  # products stay whole numbers

    def scores(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The integer inner products of some rows with v."""
        exact = float((v.astype(np.float64) ** 2).sum())
        kind = self.v.dtype if exact < (2**23 if self.v.dtype == np.float32 else 2**52) else np.dtype(np.int64)
        return (self.v[at].astype(kind, copy=False) @ v.astype(kind)).astype(np.int64)


def best(score: np.ndarray, id_: np.ndarray, n: int) -> np.ndarray:
    """The places of the n highest scores, of equals those of the smallest ids."""
    return np.lexsort((id_, -score))[:n]


def _positives(rows: Coded, anchor: Anchor, id_: int, label: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the first n other rows of the anchor's label among these."""
    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(0, len(rows.id), AT_ONCE):
        own = a + np.flatnonzero((rows.label[a : a + AT_ONCE] == label) & (rows.id[a : a + AT_ONCE] != id_))
        if len(own):
            low, high = anchor.bounds(rows.code[own], rows.along[own], rows.across[own])
            floor = np.sort(low)[-n] if len(own) >= n else -np.inf  # n rows reach this at least
            floor = max(floor, scores.min()) if len(scores) == n else floor
            own = own[high >= floor]
            ids, scores = np.concatenate([ids, rows.id[own]]), np.concatenate([scores, rows.scores(own, anchor.v)])
            first = best(scores, ids, n)
            ids, scores = ids[first], scores[first]
    return ids, scores


def _negatives(rows: Coded, anchor: Anchor, label: int, tops: np.ndarray, n: int, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each positive score, (ids, scores) of the first n rows of other labels between ``low`` and ``high`` percent of it."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in tops]
    for a in range(0, len(rows.id), AT_ONCE):
        own = a + np.flatnonzero(rows.label[a : a + AT_ONCE] != label)
        if not len(own):
            continue
        least, most = anchor.bounds(rows.code[own], rows.along[own], rows.across[own])
        asked = np.zeros(len(own), dtype=bool)
        for top, (_, scores) in zip(tops.tolist(), found):
            floor = low * top / 100 if len(scores) < n else max(low * top / 100, scores.min())
            asked |= (most >= floor - SLACK * abs(floor)) & (least <= high * top / 100 + SLACK * abs(top))
        own = own[asked]
        score = rows.scores(own, anchor.v)
        for i, top in enumerate(tops.tolist()):
            fit = (100 * score >= low * top) & (100 * score <= high * top)
            ids, scores = np.concatenate([found[i][0], rows.id[own[fit]]]), np.concatenate([found[i][1], score[fit]])
            first = best(scores, ids, n)
            found[i] = ids[first], scores[first]
    return found


def coded_rows(rows: DataFrame, seed: int) -> DataFrame:
    """rows (vec_id, label, v) with their codes, written once. Shorter vectors end in zeros."""
    d = rows.agg(F.max(F.size("v"))).first()[0] or 1
    d = max(d, 1)

    def run(batches):
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("v"), np.int64)
                code, along, across = encode(v, seed)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), lists(np.ascontiguousarray(code).view(np.int64), pa.int64()), lists(along), pa.array(across)], names=["vec_id", "label", "v", "code", "along", "across"])
        release()

    padded = F.when(F.size("v") < d, F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("v")))).otherwise(F.col("v"))
    return stash(rows.select("vec_id", "label", padded.alias("v")).mapInArrow(run, CODED))


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def mine_hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, seed: int = 42) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id, label, v array<long>).

    Anchors are the rows whose vec_id is divisible by ``every``; scores are integer inner products with the anchor, higher
    first, of equals the smaller vec_id. An anchor's positives are its first ``positives`` other rows of its label; for each of
    them the first ``negatives`` rows of other labels follow that score from ``low`` to ``high`` percent of it.

    Every anchor is compared with every row, in blocks: a task has up to ANCHORS anchors and ROWS rows, whatever their
    number. Each keeps its first few, and those meet by a window over them. The codes' bounds hold always, so nothing is missed.

    Null vec_id, label or vector, or a null component: the row takes no part. Rows of one vec_id count once: that of the least
    label and vector. Vectors of unequal lengths: missing components are zero. An anchor without other rows of its label,
    or a positive without fitting rows, has no rows here. Empty table: no rows. Other columns are not read.
    """
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v")).where(fit)
    one = own.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    coded = coded_rows(one, seed)
    is_anchor = F.pmod("vec_id", F.lit(every)) == 0
    counts = coded.agg(F.count("*").alias("n"), F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-counts["n"] // ROWS), min(slots, counts["n"] // LEAST_ROWS))
    sides = max(1, -(-counts["anchors"] // ANCHORS))
    shard, side = F.pmod(F.xxhash64("vec_id"), F.lit(shards)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(sides))
    renamed = coded.select("vec_id", *[F.col(c).alias(f"own_{c}") for c in coded.columns], shard.alias("own_shard"))  # both sides come from one table
    every_side = renamed.select(*[f"own_{c}" for c in coded.columns], "own_shard", _each(sides).alias("own_side")).groupBy("own_shard", "own_side")

    def against(asked: DataFrame):
        dealt = asked.select("*", side.alias("side"), _each(shards).alias("shard"))
        return dealt.groupBy("shard", "side").cogroup(every_side)

    def first_positives(asked: pa.Table, group: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if len(asked) and len(group):
            held, v = Coded(group), matrix(asked["v"].combine_chunks(), np.int64)
            for i, (id_, label) in enumerate(zip(asked["vec_id"].to_pylist(), asked["label"].to_pylist())):
                ids, scores = _positives(held, Anchor(v[i], seed), id_, label, positives)
                for column, values in zip(out, (np.full(len(ids), id_), np.full(len(ids), label), ids, scores)):
                    column.append(values)
            release()
        return pa.table({k: pa.array(np.concatenate(c) if c else [], pa.int64()) for k, c in zip(("vec_id", "label", "positive_id", "positive_score"), out)})

    anchors = coded.where(is_anchor).select("vec_id", "label", "v")
    near = against(anchors).applyInArrow(first_positives, "vec_id long, label long, positive_id long, positive_score long")
    nth = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("positive_score"), "positive_id"))
    near = near.withColumn("nth", nth).where(F.col("nth") <= positives)
    listed = near.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("p"))  # ``positives`` at most
    asked = stash(anchors.join(listed, "vec_id").select("vec_id", "label", "v", F.col("p.positive_id").alias("ids"), F.col("p.positive_score").alias("tops")))

    def first_negatives(asked: pa.Table, group: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if len(asked) and len(group):
            held, v = Coded(group), matrix(asked["v"].combine_chunks(), np.int64)
            for i, (id_, label, ids, tops) in enumerate(zip(*[asked[c].to_pylist() for c in ("vec_id", "label", "ids", "tops")])):
                found = _negatives(held, Anchor(v[i], seed), label, np.array(tops, np.int64), negatives, low, high)
                for positive, top, (other, score) in zip(ids, tops, found):
                    for column, values in zip(out, (np.full(len(other), id_), np.full(len(other), positive), other, np.full(len(other), top), score)):
                        column.append(values)
            release()
        names = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
        return pa.table({k: pa.array(np.concatenate(c) if c else [], pa.int64()) for k, c in zip(names, out)})

    far = against(asked).applyInArrow(first_negatives, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return far.withColumn("rank", place).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def integer_rows(embeddings: DataFrame, scale: int = 256, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, v): components times ``scale``, rounded down; the label of every relabel_every-th vec_id moves on by one.

    Rows with a null label or vector, or with a null or non-finite component, are left out."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: c)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fit = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    label = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return fit.select("vec_id", label.alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mine_hard_negatives of embeddings; nulls, ties and repeated rows as stated there."""
    out = mine_hard_negatives(integer_rows(table(spark, sf_dir, "embeddings")))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM (
  SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score) WHERE rank <= 5
"""
