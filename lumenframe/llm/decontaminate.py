"""Benchmark decontamination by winnowing: k-gram fingerprints are joined, hits are extended to whole shared spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import answered, aside, clear, own_tables, placed, restored, skew_join, stash, stash_texts, table
from ._text import ALNUM_WORD, U64, Words, grams, release, slices, within

WINDOW = 10
K = 5
#: Items that one task compares with a text at once; a text that meets more is compared in several rows.
ITEMS_AT_ONCE = 64


def winnow(h: np.ndarray, row: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the smallest k-gram (the rightmost of equals) of every ``w`` consecutive k-grams of a text.

    Any span of w + k - 1 words that two texts share has the same smallest k-gram in both.
    """
    g = grams(h, k)
    ok = within(row, w + k - 1)
    n = len(ok)
    if not n or not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, at = g[w - 1 : w - 1 + n].copy(), np.full(n, w - 1, np.int64)
    for j in range(w - 2, -1, -1):
        less = g[j : j + n] < best
        best[less] = g[j : j + n][less]
        at[less] = j
    picked = np.unique((np.arange(n) + at)[ok])
    return picked, g[picked]


def prints(words: Words, lengths: list[int], window: int, k: int, items: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint): distinct fingerprints of texts for spans of each of ``lengths`` words, or of items for their own.

    An item of fewer words than a window is one span of its length, with one fingerprint: the hash of all its words.
    """
    n = np.diff(words.first)
    own, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for length in lengths:
        kk = k if length == window else length
        at, g = winnow(words.hash, words.row, kk, length - kk + 1)
        row = words.row[at].astype(np.int64)
        if items:
            mine = (n[row] >= window) if length == window else (n[row] == length)
            row, g = row[mine], g[mine]
        g = g ^ U64(length)
        by = np.lexsort((g, row))
        row, g = row[by], g[by]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
        own.append(row[new])
        keys.append(g[new])
    return np.concatenate(own), np.concatenate(keys)


def shared_spans(text: Words, items: Words, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, end): the maximal runs of words that one text shares with each item, if a window or a whole shorter item is in them.

    Equal fingerprints give the alignments of text and item; along each, all words are compared.
    """
    n_items = np.diff(items.first)
    pairs = []
    for length in sorted({window, *(int(x) for x in n_items if 0 < x < window)}):
        kk = k if length == window else length
        at, g = winnow(items.hash, items.row, kk, length - kk + 1)
        mine = (n_items[items.row[at]] >= window) if length == window else (n_items[items.row[at]] == length)
        at, g = at[mine], g[mine]
        by = np.argsort(g, kind="stable")
        at, g = at[by], g[by]
        p, h = winnow(text.hash, text.row, kk, length - kk + 1)
        lo, hi = np.searchsorted(g, h), np.searchsorted(g, h, side="right")
        count = hi - lo
        q = at[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        item = items.row[q].astype(np.int64)
        pairs.append(np.unique(np.stack([item, np.repeat(p, count) - (q - items.first[item])], axis=1), axis=0))
    item, shift = np.unique(np.concatenate(pairs), axis=0).T if pairs else np.zeros((2, 0), np.int64)
    n = n_items[item]
    line = np.repeat(np.arange(len(item)), n)
    q = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    p = q + shift[line]
    inside = (p >= 0) & (p < len(text))
    equal = np.zeros(len(line), dtype=bool)
    equal[inside] = text.hash[p[inside]] == items.hash[items.first[item[line[inside]]] + q[inside]]
    new = equal.copy()
    new[1:] &= ~equal[:-1] | (line[1:] != line[:-1])
    end = equal.copy()
    end[:-1] &= ~equal[1:] | (line[1:] != line[:-1])
    a, b = np.flatnonzero(new), np.flatnonzero(end) + 1
    long = b - a >= np.minimum(n[line[a]], window)
    a, b = a[long], b[long]
    return item[line[a]], p[a], p[a] + (b - a)


def _words(column) -> Words:
    return Words(column, ALNUM_WORD, lower=True)


def _lengths(window: int):
    def run(batches):
        for b in (part for batch in batches for part in slices(batch)):
            n = np.diff(_words(b.column("text")).first)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(n[n > 0], window), pa.int32())], names=["n"])
        release()

    return run


def _prints(name: str, lengths: list[int], window: int, k: int, items: bool):
    def run(batches):
        for b in (part for batch in batches for part in slices(batch)):
            row, g = prints(_words(b.column("text")), lengths, window, k, items)
            yield pa.RecordBatch.from_arrays([b.column(name).take(pa.array(row)), pa.array(g.view(np.int64))], names=[name, "gram"])
        release()

    return run


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(_at, n_hit, items) of the rows of docs that hold a window of the benchmark; items: their distinct ids, sorted.

    docs: a table of placed(). Only texts that met a fingerprint of the benchmark are shuffled.
    """
    mark = own_tables()
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = stash(items.select(F.xxhash64("item_id", F.col("text").isNull(), "text").alias("_item"), "item_id", "text"))
    lengths = sorted(r["n"] for r in items.mapInArrow(_lengths(window), "n int").distinct().collect())  # at most ``window`` values
    right = stash_texts(items.select("_item", "text").mapInArrow(_prints("_item", lengths, window, k, True), "_item long, gram long"))
    left = docs.select("_at", "text").mapInArrow(_prints("_at", lengths, window, k, False), "_at long, gram long")
    # fingerprints of a small benchmark go to every task if Spark's limit for that allows it; else both sides are shuffled
    met = stash_texts(left.join(right, "gram").select("_at", "_item").distinct())
    runs = met.groupBy("_at").agg(F.ceil(F.count("*") / ITEMS_AT_ONCE).alias("runs"))
    own = met.join(runs, "_at").join(items, "_item").groupBy("_at", F.pmod(F.xxhash64("_item"), "runs").alias("run")).agg(F.collect_list(F.struct("item_id", "text")).alias("items"))

    def compare(batches):
        for b in batches:
            for i in range(b.num_rows):
                asked = b.column("items")[i].as_py()
                item, a, z = shared_spans(_words(b.column("text").slice(i, 1)), _words(pa.array([x["text"] for x in asked], pa.string())), window, k)
                spans = [{"a": x, "z": y} for x, y in sorted(set(zip(a.tolist(), z.tolist())))]
                found = sorted({asked[j]["item_id"] for j in set(item.tolist())})
                if found:
                    yield pa.RecordBatch.from_arrays([b.column("_at").slice(i, 1), pa.array([spans], pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))), pa.array([found], pa.list_(pa.string()))], names=["_at", "spans", "items"])
        release()

    texts = answered(docs.select("_part", "_at", "text"), runs, "runs").where("runs IS NOT NULL").select("_at", "text")
    spans = skew_join(own.select("_at", "items"), texts, "_at", "inner").select("_at", "text", "items").mapInArrow(compare, "_at long, spans array<struct<a: long, z: long>>, items array<string>")
    merged = spans.groupBy("_at").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))
    covered = F.aggregate("spans", start, lambda s, x: F.struct(F.greatest(s["end"], x["z"]).alias("end"), (s["hit"] + F.greatest(x["z"] - F.greatest(s["end"], x["a"]), F.lit(0))).alias("hit")))
    out = stash_texts(merged.select("_at", covered["hit"].alias("n_hit"), "items"))
    clear(docs.sparkSession, mark, out)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased. A window is ``window`` consecutive words
    of one item; an item of fewer words, but not none, is one window. Words inside any occurrence of a window are hit.
    Winnowing keeps the smallest k-gram of every window - k + 1, so that each shared window has a fingerprint in
    common; texts and items meet by a join on fingerprints, and each text is then compared with the items that it met:
    hits are extended to maximal equal runs, and count if they hold a window. Words are compared by 64-bit hashes.

    Null text: no words. Null doc_id: a row like all others. Null item_id: the text "null"; equal ids count once. Repeated
    rows: a row each. Very long texts are read whole. Empty tables: no rows, or no hits. Other columns are not read.
    """
    rows = placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))

    def count(batches):
        for b in (part for batch in batches for part in slices(batch)):
            yield pa.RecordBatch.from_arrays([b.column("_at"), b.column("doc_id"), pa.array(np.diff(_words(b.column("text")).first), pa.int64())], names=["_at", "doc_id", "n_words"])
        release()

    counted = rows.select("_at", "doc_id", "text").mapInArrow(count, "_at long, doc_id long, n_words long")
    hits = contaminated_texts(rows, benchmark, window, k)
    ids = F.array_join("items", ",")
    return counted.join(hits, "_at", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(ids, F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows that hold a benchmark window. Null and wordless texts stay.

    All else as in contamination; other columns come along whatever their names.
    """
    rows = placed(aside(docs).select("text", "_others"))
    hits = contaminated_texts(rows, benchmark, window).withColumn("_hit", F.lit(True))
    return restored(answered(rows, hits, "_hit").where("_hit IS NULL"), docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contamination of documents by benchmark, a row each; nulls, ties and repeated rows as stated there."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k FROM (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, i + unnest(range(0, n)) AS i FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
