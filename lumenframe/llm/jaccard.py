"""N-gram Jaccard join: documents that share a prefix of rare shingles meet as groups, are filtered, expanded and verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import matrix
from ._blocks import ask, codes_of, from_ipc, parts_of, to_blocks, with_answers
from ._shared import skew_join, stash, table
from ._text import U64, Words, grams, mix, release, within
from .simhash import components

#: Bits by which keys of shingles exceed what their number needs: few meet by chance.
SPARE_BITS = 6
#: Words of 64 bits of a set's parities.
PARITY_WORDS = 8
#: Entries of one shingle that a task compares; more are dealt over the pairs of so large slices.
SLICE = 2048
#: Pairs that a task looks at together.
PAIRS_AT_ONCE = 1 << 20


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of k words, repeats included; of all words of a text that has fewer. In the order of the texts."""
    ok = within(words.row, k)
    row, h = words.row[: len(ok)][ok].astype(np.int64), grams(words.hash, k)[ok]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if not len(short):
        return row, h
    whole = np.array([mix(np.array([int(sum(int(x) * (2 * j + 3) for j, x in enumerate(words.hash[words.first[i] : words.first[i + 1]])) % 2**64) + int(count[i])], dtype=object).astype(U64))[0] for i in short.tolist()], U64)
    row, h = np.concatenate([row, short]), np.concatenate([h, whole])
    by = np.argsort(row, kind="stable")
    return row[by], h[by]


def distinct_in_rows(row: np.ndarray, h: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """The places of the distinct (row, hash), by row, then ``order``, then hash. order must be the same for equal hashes."""
    by = np.argsort(h, kind="stable")
    for key in (*order[::-1], row):
        key = key[by]
        by = by[np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")]  # 16 bits: a radix sort
    new = np.ones(len(by), dtype=bool)
    new[1:] = (row[by][1:] != row[by][:-1]) | (h[by][1:] != h[by][:-1])
    return by[new]


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    """So many first elements of a set, in one order of all elements, hold one of each set that is similar enough."""
    return size + (-percent * size // 100) + 1


def _key_bits(n: int) -> int:
    return min(64, max(32, int(n).bit_length() + SPARE_BITS))


def _frequency_class(keys: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """0: the key occurs once; otherwise four classes for each doubling of its occurrences."""
    own, group = np.unique(keys, return_inverse=True)
    n = np.bincount(group, columns[0], len(own))
    return np.where(n > 1, np.minimum(np.floor(4 * np.log2(np.maximum(n, 2))), 255), 0).astype(np.uint8)[group]


def _keys_of(h: np.ndarray, bits: int) -> np.ndarray:
    return h & ~U64((1 << (64 - bits)) - 1) if bits < 64 else h


def marked_sets(blocks: DataFrame, k: int, percent: int) -> DataFrame:
    """A row for each text with words: doc_id, block_id, place (in the block), size, node (a hash of its set), group (of its
    prefix and size), tokens and places (those of the prefix that occur elsewhere), parity.

    All sets are ordered by how often a shingle occurs, rare ones first, then by hash: blocks ask the owners of their
    shingles' keys. Shingles that occur nowhere else can't make a document meet another, and are not sent on.
    """
    words = lambda t: Words(t["text"], lower=True)

    def size(batches):
        total = 0
        for batch in batches:
            for payload in batch.column("payload"):
                total += sum(len(x.as_py() or "") for x in from_ipc(payload.as_py())["text"])
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    bits = _key_bits(blocks.select("payload").mapInArrow(size, "n long").agg(F.sum("n")).first()[0] or 0)

    def emit(t: pa.Table):
        keys, n = np.unique(_keys_of(shingles(words(t), k)[1], bits), return_counts=True)
        return keys, [n.astype(np.uint32)]

    asked = with_answers(blocks, ask(blocks, emit, _frequency_class, ["u4"], parts_of(blocks), name="classes"))
    schema = "doc_id long, block_id long, place int, size long, node long, group long, tokens array<long>, places array<int>, parity array<long>"

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                t = from_ipc(batch.column("payload")[i].as_py())
                yield mark(t, batch.column("block_id")[i].as_py(), codes_of(batch.column("classes")[i].as_py()))
                release()

    def mark(t: pa.Table, block: int, classes: np.ndarray) -> pa.RecordBatch:
        row, h = shingles(words(t), k)
        own = _keys_of(h, bits)
        code = classes[np.searchsorted(np.unique(own), own)] if len(own) else own.astype(np.uint8)
        by = distinct_in_rows(row, h, code)
        row, h, code = row[by], h[by], code[by]
        size = np.bincount(row, minlength=t.num_rows)
        full = np.flatnonzero(size)
        first = np.searchsorted(row, full)
        at = np.arange(len(row)) - np.repeat(first, size[full])
        inside = at < prefix_length(size, percent)[row]
        node, group = np.zeros((2, len(full)), U64)
        if len(full):
            node = mix(np.add.reduceat(mix(h + U64(1)), first) + size[full].astype(U64))
            group = mix(np.add.reduceat(np.where(inside, mix(h ^ U64(0x5851F42D4C957F2D)), U64(0)), first) ^ mix(size[full].astype(U64)))
        bit = (mix(h ^ U64(0x2545F4914F6CDD1D)) >> U64(48)).astype(np.int64) % (64 * PARITY_WORDS)
        number = np.repeat(np.arange(len(full)), size[full])
        odd = np.zeros((len(full), 64 * PARITY_WORDS), np.uint8)
        for a in range(0, len(full), 1 << 12):  # some texts at a time
            lo, hi = np.searchsorted(number, [a, a + (1 << 12)])
            n = min(1 << 12, len(full) - a)
            odd[a : a + n] = np.bincount((number[lo:hi] - a) * 64 * PARITY_WORDS + bit[lo:hi], minlength=n * 64 * PARITY_WORDS).reshape(n, -1) & 1
        parity = np.packbits(odd, axis=1, bitorder="little").view(np.int64).reshape(-1)
        sent = np.flatnonzero(inside & (code > 0))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(number[sent], minlength=len(full)))]), pa.int32())
        columns = [t["doc_id"].combine_chunks().take(pa.array(full)), pa.array(np.full(len(full), block)), pa.array(full, pa.int32()), pa.array(size[full], pa.int64()), pa.array(node.view(np.int64)), pa.array(group.view(np.int64))]
        columns += [pa.ListArray.from_arrays(ends, pa.array(h[sent].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(at[sent], pa.int32()))]
        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * PARITY_WORDS, pa.int32()), pa.array(parity)))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "block_id", "place", "size", "node", "group", "tokens", "places", "parity"])

    return stash(asked.select("block_id", "payload", "classes").mapInArrow(run, schema))


def _slices(entries: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """entries of the tokens of ``asked`` (token, n), with cell: up to SLICE of a token have one cell, others one for each pair of slices."""
    n = F.ceil(F.col("n") / SLICE).cast("long")  # few tokens are broadcast within Spark's limit
    own = F.pmod(F.xxhash64(by), n)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: F.least(j, own) * n + F.greatest(j, own))
    return entries.join(asked.select("token", "n"), "token").withColumn("cell", F.explode(pairs)).drop("n")


def _by_token(group: pa.Table, *order: str) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """The first place of each (token, cell) of a part, with the end at last; the columns in the order of (token, cell, *order); that order."""
    c = {k: group[k].combine_chunks().to_numpy() for k in ("token", "cell", "size", "at", *order)}
    by = np.lexsort(tuple(c[k] for k in (*order[::-1], "cell", "token")))
    c = {k: v[by] for k, v in c.items()}
    new = np.ones(len(by), dtype=bool)
    new[1:] = (c["token"][1:] != c["token"][:-1]) | (c["cell"][1:] != c["cell"][:-1])
    return np.append(np.flatnonzero(new), len(by)), c, by


def needed(total, percent: int):
    """So many elements two similar sets share that have ``total`` together."""
    return -(-percent * total // (100 + percent))


def _may_link(size_a, size_b, at_a, at_b, percent: int) -> np.ndarray:
    """Whether sets of these sizes, whose first common element is at these places, can be similar enough."""
    fits = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
    return fits & (np.minimum(size_a - at_a, size_b - at_b) >= needed(size_a + size_b, percent))


def _in_parts(df: DataFrame, run, schema: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("part", F.pmod(F.xxhash64("token", "cell"), F.lit(n)).cast("int")).repartitionById(n, F.col("part")).groupBy("part").applyInArrow(run, schema)


def neighbours(cells: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each group b one before it, by size, and one that comes first of a token; those it shares most tokens with."""

    def run(group: pa.Table) -> pa.Table:
        cuts, c, _ = _by_token(group, "size", "group")
        number = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        at = np.arange(len(number))
        first = cuts[number]
        pairs = []
        for kind, other in enumerate((np.maximum(at - 1, 0), first)):
            some = np.flatnonzero((other >= first) & (other < at))
            a, b = other[some], some
            ok = _may_link(c["size"][a], c["size"][b], c["at"][a], c["at"][b], percent)
            pairs.append(np.stack([c["group"][a[ok]], c["group"][b[ok]], np.full(int(ok.sum()), kind)], axis=1))
        pairs, n = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        release()
        return pa.table({"a": np.ascontiguousarray(pairs[:, 0]), "b": np.ascontiguousarray(pairs[:, 1]), "kind": np.ascontiguousarray(pairs[:, 2]), "n": n.astype(np.int64)})

    shared = _in_parts(cells, run, "a long, b long, kind long, n long").groupBy("kind", "b", "a").agg(F.sum("n").alias("n"))
    return shared.groupBy("kind", "b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b").distinct()


def unjoined(cells: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(u, v): nodes of different components that share a token and, by their sizes, its places and their parities, can be similar.

    nearest: for each node only the one whose parities differ least; else all such pairs.
    """

    def run(group: pa.Table) -> pa.Table:
        cuts, c, by = _by_token(group, "root", "node")
        parity = matrix(group["parity"].combine_chunks(), np.int64)[by].view(U64)
        found, held = [np.zeros((0, 3), np.int64)], 0
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            starts = np.flatnonzero(np.append(True, c["root"][lo + 1 : hi] != c["root"][lo : hi - 1])) + lo
            ends = np.append(starts[1:], hi)
            own = np.repeat(np.arange(len(starts)), ends - starts)
            for i in range(lo, hi if nearest else int(starts[-1])):
                j = np.arange(ends[own[i - lo]], hi)  # the places after the own component
                if nearest:
                    j = np.concatenate([np.arange(lo, starts[own[i - lo]]), j])
                j = j[_may_link(c["size"][i], c["size"][j], c["at"][i], c["at"][j], percent)]
                total = c["size"][i] + c["size"][j]
                differ = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64)
                ok = np.flatnonzero(differ <= total - 2 * needed(total, percent))
                if len(ok):
                    ok = ok[[np.argmin(differ[ok])]] if nearest else ok
                    found.append(np.stack([np.full(len(ok), c["node"][i]), c["node"][j[ok]], differ[ok]], axis=1))
                    held += len(ok)
                    if held > PAIRS_AT_ONCE:
                        found, held = [np.unique(np.concatenate(found), axis=0)], 0
        pairs = np.unique(np.concatenate(found), axis=0)
        if not nearest:
            pairs = np.unique(np.sort(pairs[:, :2], axis=1), axis=0)
            pairs = np.concatenate([pairs, np.zeros((len(pairs), 1), np.int64)], axis=1)
        release()
        return pa.table({k: np.ascontiguousarray(pairs[:, i]) for i, k in enumerate(("u", "v", "differ"))})

    pairs = _in_parts(cells, run, "u long, v long, differ long")
    return pairs.groupBy("u").agg(F.min(F.struct("differ", "v")).alias("m")).select("u", "m.v") if nearest else pairs.select("u", "v").distinct()


def similar(pairs: DataFrame, nodes: DataFrame, blocks: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes that are similar enough: first by sizes and parities, then by their sets, made from the texts.

    pairs and what is left of them are written first: few of them are then broadcast within Spark's limit, and nodes aren't shuffled.
    A set element that only one of two sets has turns one parity, so differing parities are at most as many as such elements.
    """
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("size").alias(f"{name}_size"), F.col("parity").alias(f"{name}_parity"))
    first = stash(pairs.select("u", "v").join(side("u"), "u"))
    both = first.join(side("v"), "v")
    total = F.col("u_size") + F.col("v_size")
    need = F.ceil(F.lit(percent) * total / F.lit(100 + percent))
    differ = F.aggregate(F.zip_with("u_parity", "v_parity", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    left = stash(both.where((100 * F.least("u_size", "v_size") >= percent * F.greatest("u_size", "v_size")) & (differ <= total - 2 * need)).select("u", "v"))
    wanted = left.select(F.col("u").alias("node")).union(left.select(F.col("v").alias("node"))).distinct()
    if left.isEmpty():
        return left
    places = wanted.join(nodes.select("node", "block_id", "place"), "node").groupBy("block_id").agg(F.collect_list(F.struct("place", "node")).alias("own"))  # some of a block's rows

    def sets(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = sorted((r["place"], r["node"]) for r in batch.column("own")[i].as_py())
                texts = from_ipc(batch.column("payload")[i].as_py())["text"].combine_chunks().take(pa.array([p for p, _ in own]))
                row, h = shingles(Words(texts, lower=True), k)
                by = distinct_in_rows(row, h)
                ends = np.searchsorted(row[by], np.arange(len(own) + 1))
                yield pa.RecordBatch.from_arrays([pa.array([x for _, x in own], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[by].view(np.int64)))], names=["node", "own"])
                release()

    made = stash(blocks.join(places.hint("merge"), "block_id").select("payload", "own").mapInArrow(sets, "node long, own array<long>"))
    named = lambda name, as_: made.select(F.col("node").alias(name), F.col("own").alias(as_))
    held = left.join(named("u", "x"), "u").join(named("v", "y"), "v")
    shared = F.size(F.array_intersect("x", "y"))
    return held.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("u", "v")


def jaccard_groups(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) of each row of docs (doc_id, text).

    A document's set: its distinct runs of k words (A-Z lower-cased); of all its words if they are fewer. Two link when
    100 * intersection >= percent * union.

    Documents of one set are one node; nodes of one size and prefix are one group. Groups that share a shingle of their
    prefixes meet, are filtered by size and place, expanded to their members, and those verified on whole sets. First
    each group meets the one beside it and the first one that it shares most with, each member the first of its group; that
    joins what is alike. Twice then each member meets the one of another component that it may be most similar to. In the end
    all members of groups that share a shingle and are still in different components are compared: no link between
    components is lost, and pairs within one are not asked for.

    Null, empty and wordless texts: size 0, linked with nothing, component_id is the own doc_id. Null doc_id: the row takes
    part, its component's id is the smallest that is not null. Repeated rows: a row each. Very long texts are read whole. Empty
    table: no rows. Other columns are not read. Shingles are 64-bit hashes.
    """
    blocks = to_blocks(docs)
    marked = marked_sets(blocks, k, percent)
    keep = F.struct("block_id", "place", "size", "group", "parity")
    nodes = stash(marked.groupBy("node").agg(F.min("doc_id").alias("lead"), F.min(keep).alias("r")).select("node", "lead", "r.*"))
    tokens = marked.where(F.size("tokens") > 0).groupBy("group").agg(F.any_value(F.struct("size", "tokens", "places")).alias("r"))
    entries = stash(tokens.select("group", "r.size", F.explode(F.arrays_zip("r.tokens", "r.places")).alias("t")).select(F.col("t.tokens").alias("token"), "group", "size", F.col("t.places").alias("at")))
    cells = _slices(entries, entries.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "group")

    first = stash(nodes.groupBy("group").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    named = lambda name, as_: first.select(F.col("group").alias(name), F.col("first").alias(as_))
    across = neighbours(cells, percent).join(named("a", "u"), "a").join(named("b", "v"), "b").select("u", "v")
    inside = skew_join(nodes.select("node", "group"), first.where("n > 1"), "group", "inner").where("node != first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    roots = stash(components(similar(stash(across.union(inside)), nodes, blocks, k, percent)))

    for nearest in (True, True, False):
        rooted = stash(nodes.select("node", "group").join(roots, "node", "left").select("node", "group", F.coalesce("root", "node").alias("root")))
        members = stash(skew_join(entries, rooted, "group", "inner").select("token", "node", "root", "size", "at"))
        open_ = stash(members.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("a != b"))
        if open_.isEmpty():  # all that share a token are joined
            break
        met = stash(_slices(members, open_, "node"))
        rest = stash(unjoined(met.join(nodes.select("node", "parity"), "node"), percent, nearest))
        more = stash(similar(rest, nodes, blocks, k, percent))
        if not more.isEmpty():
            roots = stash(components(roots.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")).union(more)))
    ids = stash(skew_join(nodes.select("node", "lead"), roots, "node").select("node", "lead", F.coalesce("root", "node").alias("root")))
    low = ids.groupBy("root").agg(F.min("lead").alias("component_id"))
    by_node = skew_join(ids.select("node", "root"), low, "root").select("node", "component_id")
    linked = skew_join(marked.select("doc_id", "node", F.col("size").alias("n_shingles")), by_node, "node").select("doc_id", "n_shingles", "component_id")
    wordless = docs.where(F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"\A[\x20\x09-\x0D]*\z")).select(F.col("doc_id").cast("long").alias("doc_id"))
    return linked.unionByName(wordless.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of documents; nulls, ties and repeated rows as in jaccard_groups."""
    return jaccard_groups(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) r USING (doc_id)
"""
