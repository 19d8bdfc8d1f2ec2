"""SimHash near-dedup: 64-bit fingerprints, meet-in-the-middle ball hashing, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, ceil, comb, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import answered, aside, clear, own_tables, placed, quoted, restored, skew_join, stash, stash_texts, table, with_fields
from ._text import U64, Words, grams, mix, release, slices, within

SEED = 42
#: Variants that a task holds at once.
VARIANTS_AT_ONCE = 1 << 19
#: Shingles whose bits a task counts at once.
BITS_AT_ONCE = 1 << 15
#: Edges that a task joins at once.
EDGES_AT_ONCE = 1 << 16
#: Pairs that a task makes at once.
PAIRS_AT_ONCE = 1 << 16
#: Of so many texts that share a variant all pairs are compared at once; of more, chains first, then what these leave apart.
FEW = 32
#: Variants are dealt by their first bits: so many at least, and so many that a part gets about PART_ROWS fingerprints.
PREFIX = 6
PART_ROWS = 1 << 22
#: Near-duplicate documents: shingles of so many words, so similar, found with such a probability at that similarity.
SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.95


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of k words, lower-cased A-Z, joined by a space; of all words if they are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        some = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 4, carry: tuple = ()) -> DataFrame:
    """The columns ``carry`` of docs, and fp: the fingerprint's 64 bits as a long."""

    def run(batches):
        for b in (part for batch in batches for part in slices(batch)):
            fps = [fingerprint(shingle_hashes(t.as_py(), k)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array(np.array(fps, np.uint64).view(np.int64))], names=[*carry, "fp"])
        release()

    narrow = docs.select(*map(quoted, carry), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, with_fields("", narrow, carry, "fp long"))


def _flips(bits: int, most: int) -> np.ndarray:
    """Masks of all ways to flip up to ``most`` of ``bits`` bits."""
    masks = frontier = np.zeros(1, np.uint64)
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    for _ in range(min(most, bits)):
        frontier = np.unique((frontier[:, None] ^ one[None, :]).reshape(-1))
        masks = np.unique(np.concatenate([masks, frontier]))
    return masks


def _prefix_bits(fps: DataFrame, n: int, bits: int, half: int) -> int:
    """How many leading bits deal the variants out: more with the data, and more again where fingerprints crowd."""
    b = min(PREFIX, bits)
    while b < min(bits, 30) and n * len(_flips(b, half)) >> b > PART_ROWS:
        b += 2
    while b < min(bits, 30):
        most = fps.groupBy("tab", F.shiftrightunsigned("fp", bits - b)).count().agg(F.max("count")).first()[0] or 0
        if most <= PART_ROWS:
            break
        b += 2
    return b


def _dealt(fps: DataFrame, radius: int, bits: int, tables: int, meet: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]], *more: str) -> DataFrame:
    """The distinct pairs (u, v) that meet(x, node, *more, prefix, b, bits, half) makes of the fingerprints of a part.

    fps: tab (0 .. tables - 1), fp, node and ``more`` (longs); only fingerprints of one tab meet. Every fingerprint's variants
    within half the radius meet: two fingerprints within the radius share one. Variants are dealt by their first bits, so the
    shuffle carries a fingerprint once for each way to flip up to half the radius of those (22 ways of 6 bits, 254 of 22),
    and the part that owns a run of variants makes them there, some at a time. With more data, more bits deal: a part gets
    some PART_ROWS fingerprints at every size.
    """
    if radius % 2:
        raise ValueError("radius must be even: variants are taken within half of it")
    half = radius // 2
    b = _prefix_bits(fps, fps.count() // tables, bits, half)
    ways = F.array(*[F.lit(int(m)).cast("int") for m in _flips(b, half)])
    own = F.shiftrightunsigned(F.col("fp"), bits - b).cast("int") if b else F.lit(0)
    own = own.bitwiseAND((1 << b) - 1)
    part = F.explode(F.transform(ways, lambda m: F.col("tab").cast("long") * (1 << b) + own.bitwiseXOR(m)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        x, *rest = (group[c].to_numpy() for c in ("fp", "node", *more))
        for u, v in meet(x.view(np.uint64), *rest, group["part"][0].as_py() & ((1 << b) - 1), b, bits, half):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        release()

    slots = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fps.select(part.alias("part"), "fp", "node", *more).withColumn("slot", F.pmod("part", F.lit(slots)).cast("int"))  # parts in turn, so evenly
    return dealt.repartitionById(slots, F.col("slot")).groupBy("slot", "part").applyInArrow(run, "u long, v long").distinct()


def links(fps: DataFrame, radius: int = 4, bits: int = 64, tables: int = 1) -> DataFrame:
    """(u, v): pairs of nodes whose fingerprints (as in _dealt) differ in ``radius`` or fewer of ``bits`` bits, enough to connect
    all such pairs. Those that share a variant are within the radius of each other, hence chains stand for all their pairs."""
    return _dealt(fps, radius, bits, tables, _chained)


def candidates(fps: DataFrame, radius: int, bits: int, tables: int) -> DataFrame:
    """(u, v), u < v: all pairs of nodes whose fingerprints (as in _dealt) differ in ``radius`` or fewer bits, but in a crowd: where
    more than FEW share a variant, only its chains, and (u, u) for each of them, for crossing() to go on."""
    return _dealt(fps, radius, bits, tables, _paired)


def crossing(fps: DataFrame, radius: int, bits: int, tables: int) -> DataFrame:
    """(u, v), u < v: all pairs of nodes of different ``root`` (a column of fps) whose fingerprints (as in _dealt) differ in
    ``radius`` or fewer bits, however many meet. Where all are different this is quadratic; a task makes PAIRS_AT_ONCE at once."""
    return _dealt(fps, radius, bits, tables, _crossed, "root")


def _meetings(x: np.ndarray, at: np.ndarray, prefix: int, b: int, bits: int, half: int):
    """(z, at): variants with these first ``b`` bits, in order, each as often as fingerprints share it (two at least), and their
    places in x; some at a time. at: the places of fingerprints that have such variants."""
    if len(at) < 2:
        return
    own = x[at]
    flips = np.bitwise_count((own >> U64(bits - b)) ^ U64(prefix)) if b else np.zeros(len(own), np.uint8)
    rest = [_flips(bits - b, half - j) for j in range(half + 1)]
    if sum(int((flips == j).sum()) * len(rest[j]) for j in range(half + 1)) > VARIANTS_AT_ONCE and b < bits:
        for q in range(1 << min(2, bits - b)):
            wider = b + min(2, bits - b)
            longer = (prefix << (wider - b)) | q
            some = np.bitwise_count((own >> U64(bits - wider)) ^ U64(longer)) <= half
            yield from _meetings(x, at[some], longer, wider, bits, half)
        return
    low = U64((1 << (bits - b)) - 1)
    z, y = [], []
    for j in range(half + 1):
        mine = flips == j
        z.append(((own[mine] & low)[:, None] ^ rest[j][None, :]).reshape(-1))
        y.append(np.repeat(at[mine], len(rest[j])))
    z, y = np.concatenate(z), np.concatenate(y)
    by = np.argsort(z, kind="stable")
    z = z[by]
    same = np.zeros(len(z) + 1, dtype=bool)
    same[1:-1] = z[1:] == z[:-1]
    met = np.flatnonzero(same[:-1] | same[1:])
    if len(met):
        yield z[met] | U64(prefix << (bits - b)), y[by[met]]


def _chains(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the nodes y that share a variant z, each with the one before it and with the first, as rows, each pair once."""
    order = np.lexsort((y, z))
    z, y = z[order], y[order]
    new = np.ones(len(z), dtype=bool)
    new[1:] = z[1:] != z[:-1]
    lead = y[np.flatnonzero(new)][np.cumsum(new) - 1]
    at = np.flatnonzero(~new)
    pairs = np.concatenate([np.stack([y[at - 1], y[at]], axis=1), np.stack([lead[at], y[at]], axis=1)])
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _chained(x: np.ndarray, node: np.ndarray, *part):
    """Chains of the nodes that meet in the part's variants, each pair once."""
    found = [_chains(z, node[at]) for z, at in _meetings(x, np.arange(len(x)), *part)]
    if found:
        pairs = np.unique(np.concatenate(found), axis=0)
        yield np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def _owns(z: np.ndarray, x: np.ndarray, y: np.ndarray, half: int) -> np.ndarray:
    """Whether z is the one of the variants that x and y share where the two are paired: the smaller of both, with the lower
    half of the bits flipped in which they differ."""
    differ = x ^ y
    n, flipped = np.bitwise_count(differ), np.minimum(x, y)
    for j in range(1, half + 1):
        low = differ & (~differ + U64(1))
        flipped = np.where(n >= 2 * j, flipped ^ low, flipped)
        differ = differ ^ low
    return z == flipped


def _owned(z: np.ndarray, x: np.ndarray, half: int):
    """(i, j): places of the pairs of fingerprints x that are paired in the variant z (in order) that they share; some at a time."""
    i = np.arange(len(z))
    for k in range(1, len(z)):
        i = i[: np.searchsorted(i, len(z) - k)]
        i = i[z[i] == z[i + k]]
        if not len(i):
            return
        mine = i[_owns(z[i], x[i], x[i + k], half)]
        if len(mine):
            yield mine, mine + k


def _paired(x: np.ndarray, node: np.ndarray, prefix: int, b: int, bits: int, half: int):
    """What candidates() makes of a part."""
    for z, at in _meetings(x, np.arange(len(x)), prefix, b, bits, half):
        first = np.flatnonzero(np.concatenate([[True], z[1:] != z[:-1]]))
        size = np.diff(np.append(first, len(z)))
        few = np.repeat(size <= FEW, size)
        y, own = node[at[few]], x[at[few]]
        for i, j in _owned(z[few], own, half):
            yield np.minimum(y[i], y[j]), np.maximum(y[i], y[j])
        if not few.all():
            crowd = node[at[~few]]
            pairs, each = _chains(z[~few], crowd), np.unique(crowd)
            yield np.concatenate([pairs[:, 0], each]), np.concatenate([pairs[:, 1], each])


def _products(a: np.ndarray, b: np.ndarray):
    """(k, i, j): for each k all i below a[k] with all j below b[k]; PAIRS_AT_ONCE at a time."""
    ends = np.cumsum(a * b)
    for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS_AT_ONCE):
        n = np.arange(at, min(at + PAIRS_AT_ONCE, int(ends[-1])))
        k = np.searchsorted(ends, n, side="right")
        n = n - (ends[k] - a[k] * b[k])
        yield k, n // b[k], n % b[k]


def _crossed(x: np.ndarray, node: np.ndarray, root: np.ndarray, prefix: int, b: int, bits: int, half: int):
    """What crossing() makes of a part: nodes of one fingerprint and root are one unit, so pairs within a root are not made."""
    by = np.lexsort((root, x))
    x, node, root = x[by], node[by], root[by]
    unit = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (root[1:] != root[:-1])]))
    members, root, x = np.diff(np.append(unit, len(x))), root[unit], x[unit]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    units, x = np.diff(np.append(first, len(x))), x[first]

    def made(f, g):
        for k, i, j in _products(units[f], units[g]):
            p, q = first[f[k]] + i, first[g[k]] + j
            apart = (root[p] != root[q]) & ((f[k] != g[k]) | (i < j))
            p, q = p[apart], q[apart]
            for k, i, j in _products(members[p], members[q]):
                u, v = node[unit[p[k]] + i], node[unit[q[k]] + j]
                yield np.minimum(u, v), np.maximum(u, v)

    own = np.flatnonzero((x >> U64(bits - b) == U64(prefix)) & (units > 1)) if b else np.flatnonzero(units > 1)
    yield from made(own, own)
    for z, at in _meetings(x, np.arange(len(x)), prefix, b, bits, half):
        for i, j in _owned(z, x[at], half):
            yield from made(at[i], at[j])


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): the stars of what these edges connect, each node with the smallest that it reaches; without roots' own rows."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (differ := root[a] != root[b]).any():
        x, y = root[a[differ]], root[b[differ]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    some = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[some], nodes[root[some]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b), b smaller, that connect the same nodes: each task gives the stars of its own, EDGES_AT_ONCE at a time."""

    def run(batches):
        held, n = [np.zeros((2, 0), np.int64)], 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("a", "b")]))
            n += batch.num_rows
            if n > EDGES_AT_ONCE:
                held = [np.stack(_forest(*np.concatenate(held, axis=1)))]
                n = held[0].shape[1]
                if 2 * n > EDGES_AT_ONCE:  # most of them are needed
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b"])
                    held, n = [np.zeros((2, 0), np.int64)], 0
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _forest(*np.concatenate(held, axis=1))], names=["a", "b"])
        release()

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v; no nulls) can reach.

    Each task first joins what its own edges connect. What is left goes to tasks of EDGES_AT_ONCE edges, which join theirs; one such
    task's stars are the result, however few tasks there were before. With more edges, large-star and small-star rounds: every round hangs neighbours on
    the smallest neighbour, by map-side minima and joins, until the edges are stars: every node is hung on one other at
    most, and none on one that is hung itself. Each round starts from files in the shared folder, and the last round's go.
    Minima of few nodes are broadcast within Spark's limit; else Spark deals the rows of a hot node over tasks.
    """
    e = stash(_contracted(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a != b")))
    while True:
        tasks = max(1, -(-e.count() // EDGES_AT_ONCE))
        e = stash(_contracted(e.coalesce(tasks)), replaces=e)
        if tasks == 1:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        ends = e.select(F.col("a").alias("node"), "b", F.lit(False).alias("top")).union(e.select(F.col("b"), F.lit(None).cast("long"), F.lit(True)))
        stars = stash(ends.groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max("top").alias("top")))
        if stars.where("low != high OR low IS NOT NULL AND top").isEmpty():
            return stars.select("node", F.coalesce("low", "node").alias("root"))
        low = stars.select(F.col("node").alias("a"), F.least("node", "low").alias("m"))
        both = e.union(e.select(F.col("b"), F.col("a")))
        large = stash(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        low = stash(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = stash(_contracted(small.where("a != b").distinct()), replaces=e)


def near_duplicate_groups(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, root (the group's key), component_id (smallest doc_id reachable) of each row of docs (doc_id, text).

    Null or empty text: fingerprint zero, linked like any other. Null doc_id: the row takes part, its group's id is the
    smallest id that is not null (null if there is none). Repeated rows: one fingerprint, a row each. Very long texts are
    read whole. Empty table: no rows. Other columns are not read.
    """
    marked = stash_texts(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, ("doc_id",)))
    fps = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("lead")))
    roots = components(links(fps.select(F.lit(0).alias("tab"), "fp", F.col("fp").alias("node")), radius))
    rooted = stash(skew_join(fps, roots.withColumnRenamed("node", "fp"), "fp").select("fp", "lead", F.coalesce("root", "fp").alias("root")))
    low = rooted.groupBy("root").agg(F.min("lead").alias("component_id"))
    return skew_join(marked, skew_join(rooted.select("fp", "root"), low, "root"), "fp").select("doc_id", "fp", "root", "component_id")


def plan_tables(n: int, similarity: float = SIMILARITY, recall: float = RECALL, radius: int = 4) -> tuple[int, int]:
    """(bits, tables): how long fingerprints are, and how many of them, for n texts.

    Fingerprints are so long that a text meets about one other by chance in a table, and so many that texts of this
    similarity come within the radius in one of them with probability ``recall``. A bit differs with the angle between
    the shingle sets: acos(2s / (1 + s)) / pi.
    """
    bits = next((b for b in range(24, 64, 2) if n * sum(comb(b, j) for j in range(radius + 1)) <= 2**b), 64)
    p = acos(2 * similarity / (1 + similarity)) / pi
    near = sum(comb(bits, j) * p**j * (1 - p) ** (bits - j) for j in range(radius + 1))
    return bits, max(1, ceil(log(1 - recall) / log(1 - near)))


def shingle_sets(column, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash): the distinct shingles of k words (lower-cased A-Z) of each text, in order; of all its words if they are fewer."""
    w = Words(column, lower=True)
    ok = within(w.row, k)
    row, h = w.row[: len(ok)][ok], grams(w.hash, k)[ok]
    count = np.diff(w.first)
    for n in range(1, k):  # short texts
        some = np.flatnonzero(count == n)
        if len(some):
            at = w.first[some]
            row, h = np.concatenate([row, some]), np.concatenate([h, mix(np.sum([w.hash[at + j] * U64(2 * j + 3) for j in range(n)], axis=0, dtype=U64) + U64(n))])
    by = np.lexsort((h, row))
    row, h = row[by].astype(np.int64), h[by]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def sketches(docs: DataFrame, bits: int, tables: int, carry: tuple = (), k: int = SHINGLE) -> DataFrame:
    """The columns ``carry`` of docs, node (a hash of its set of shingles) and sketch: a fingerprint of ``bits`` bits a table."""
    words = -(-bits * tables // 64)

    def run(batches):
        for b in (part for batch in batches for part in slices(batch)):
            row, h = shingle_sets(b.column("text"), k)
            n = b.num_rows
            count = np.bincount(row, minlength=n)
            full = np.flatnonzero(count)
            node, ones = np.zeros(n, np.uint64), np.zeros((n, 64 * words), np.int32)
            if len(full):
                starts = (np.cumsum(count) - count)[full]
                node[full] = mix(np.add.reduceat(mix(h + U64(1)), starts) + count[full].astype(U64))
            for a in range(0, len(h), BITS_AT_ONCE):
                some, own = row[a : a + BITS_AT_ONCE], h[a : a + BITS_AT_ONCE]
                first = np.flatnonzero(np.diff(some, prepend=-1))
                for j in range(words):
                    bits_ = np.unpackbits(mix(own ^ U64(0x9E3779B97F4A7C15 * (2 * j + 3) % 2**64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ones[some[first], 64 * j : 64 * j + 64] += np.add.reduceat(bits_, first, axis=0, dtype=np.int32)
            above = 2 * ones > count[:, None]
            fps = np.zeros((n, tables, 64), np.uint8)
            fps[:, :, :bits] = above[:, : bits * tables].reshape(n, tables, bits)
            flat = np.packbits(fps.reshape(-1, 64), axis=1, bitorder="little").view(np.int64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * tables + 1, tables), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array(node.view(np.int64)), lists], names=[*carry, "node", "sketch"])
        release()

    narrow = docs.select(*map(quoted, carry), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, with_fields("", narrow, carry, "node long, sketch array<long>"))


def similar_pairs(pairs: DataFrame, texts: DataFrame, similarity: float, k: int = SHINGLE) -> DataFrame:
    """The pairs (u, v) of nodes whose sets of shingles have this Jaccard similarity or more; texts: (node, text), one row a node."""

    def run(batches):
        for b in (part for batch in batches for part in slices(batch)):
            row, h = shingle_sets(b.column("text"), k)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))], names=["node", "own"])
        release()

    sets = stash_texts(texts.select("node", "text").mapInArrow(run, "node long, own array<long>"))
    both = skew_join(skew_join(pairs, sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u", "inner"), sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v", "inner")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= F.lit(similarity) * (F.size("a") + F.size("b") - shared)).select("u", "v")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, radius: int = 4) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest doc_id (nulls last), of equal rows one.

    Near duplicates: sets of five-word shingles with a Jaccard similarity of ``similarity`` or more, and what such pairs
    connect. Candidates come from several fingerprints a text by ball hashing (plan_tables): all pairs within the radius in
    one of them, but for those in a crowd that are joined already. They are compared
    exactly; a pair at the threshold is found with probability ``recall``, a closer one with more. Before that, pairs
    whose fingerprints together are 4 standard deviations beyond the threshold's go.

    Null, empty and wordless texts are one group. Null doc_id: after all others. Repeated rows: one; of rows with one
    doc_id and text but other columns that differ, that whose JSON of them has the smallest XXH64. Very long texts are read whole. Empty table:
    no rows. Other columns come along whatever their names and types.
    """
    keyed = aside(docs).withColumn("_id", F.coalesce("doc_id", F.lit(2**63 - 1)))
    keyed = placed(keyed)  # so that texts are not shuffled
    mark = own_tables()
    bits, tables = plan_tables(keyed.count(), similarity, recall, radius)
    ties = keyed.select("_id", F.xxhash64("_id", F.coalesce("text", F.lit(""))).alias("_row"), F.xxhash64(F.to_json("_others")).alias("_tie"), "_at", "text")
    marked = stash_texts(sketches(ties, bits, tables, ("_id", "_row", "_tie", "_at")))
    nodes = stash(marked.groupBy("node").agg(F.min(F.struct("_id", "_row", "_tie", "_at")).alias("best"), F.any_value("sketch").alias("sketch")))
    fps = nodes.where("node != 0").select("node", F.posexplode("sketch").alias("tab", "fp"))
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("sketch").alias(f"{name}_sketch"))
    differ = F.aggregate(F.zip_with("u_sketch", "v_sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    p = acos(2 * similarity / (1 + similarity)) / pi
    most = bits * tables * p + 4 * (bits * tables * p * (1 - p)) ** 0.5

    def similar(found: DataFrame) -> DataFrame:
        pairs = stash(skew_join(skew_join(found, side("u"), "u", "inner"), side("v"), "v", "inner").where(differ <= most).select("u", "v"))
        asked = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct().join(nodes, "node").select("node", "best._at")
        texts = answered(keyed.select("_part", "_at", "text"), asked, "node").where("node IS NOT NULL")
        return similar_pairs(pairs, texts, similarity)

    found = stash(candidates(fps, radius, bits, tables))
    roots = components(similar(found.where("u != v")))
    crowd = found.where("u = v").select(F.col("u").alias("node"))
    if not crowd.isEmpty():  # pairs that chains left apart
        crowd = skew_join(crowd, roots, "node").select("node", F.coalesce("root", "node").alias("root"))
        left = crossing(stash(skew_join(fps, crowd, "node", "inner")), radius, bits, tables)
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(similar(left)))
    rooted = skew_join(nodes.select("node", "best"), roots, "node").select(F.coalesce("root", "node").alias("root"), "best")
    best = stash(rooted.groupBy("root").agg(F.min("best").alias("best")).select("best._at", F.lit(True).alias("_best")))
    clear(docs.sparkSession, mark, best)
    return restored(answered(keyed.select("_part", "_at", "text", "_others"), best, "_best").where("_best"), docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of documents; nulls, ties and repeated rows as in near_duplicate_groups."""
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
