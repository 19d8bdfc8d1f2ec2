"""Target-distribution importance resampling: documents are drawn by how much likelier their n-grams are in a target text."""

from __future__ import annotations

import zlib
from math import floor, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import aside, restored, stash, table, with_fields
from ._text import ALNUM_WORD, U64, Words, release, slices, within

SEED = 42
#: n-grams that are looked up at once.
AT_ONCE = 1 << 17
#: Row numbers of a partition, below which monotonically_increasing_id holds the partition.
PLACE_BITS = 33

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position of ``data`` as one number (a view)."""
    return np.ndarray((len(data) - 7,), np.dtype("<u8"), data, strides=(1,))


def xxhash64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the runs of bytes; those under 32 bytes all at once. ``data`` has eight bytes more than the runs need."""
    eight = words_at(data)
    h = U64((seed + int(P5)) % 2**64) + length.astype(U64)
    for at in (0, 8, 16):
        some = np.flatnonzero((length >= at + 8) & (length < 32))
        h[some] = _turn(h[some] ^ (_turn(eight[start[some] + at] * P2, 31) * P1), 27) * P1 + P4
    some = np.flatnonzero((length & 4 > 0) & (length < 32))
    four = eight[start[some] + (length[some] & ~7)] & U64(0xFFFFFFFF)
    h[some] = _turn(h[some] ^ (four * P1), 23) * P2 + P3
    for j in range(3):
        some = np.flatnonzero((length & 3 > j) & (length < 32))
        h[some] = _turn(h[some] ^ (data[start[some] + (length[some] & ~3) + j].astype(U64) * P5), 11) * P1
    h = (h ^ (h >> U64(33))) * P2
    h = (h ^ (h >> U64(29))) * P3
    h ^= h >> U64(32)
    for i in np.flatnonzero(length >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + length[i]].tobytes(), seed)
    return h


class Interned:
    """The distinct runs of bytes of a batch, in an open-addressed table of NumPy columns.

    A run's slot is looked for from its XXH64 on, slot by slot; a slot is its own if key, length and bytes agree. at and
    length: where the run's bytes are in ``data``; bucket and count: its bucket and how often it was interned. The table
    doubles before more than half of it is taken.
    """

    def __init__(self, data: np.ndarray, buckets: int, bits: int = 12):
        self.data, self.buckets, self.eight = data, buckets, words_at(data)
        self._make(bits)

    def _make(self, bits: int) -> None:
        n = 1 << bits
        self.key, self.at, self.length = np.zeros(n, U64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.bucket, self.count, self.taken = np.zeros(n, np.int64), np.zeros(n, np.int64), 0

    def grow(self, more: int) -> np.ndarray | None:
        """Makes room for ``more`` runs; the new slot of each old one if slots moved."""
        bits = len(self.key).bit_length() - 1
        if 2 * (self.taken + more) <= len(self.key):
            return None
        while 2 * (self.taken + more) > 1 << bits:
            bits += 1
        old = np.flatnonzero(self.at >= 0)
        key, at, length, bucket, count = (c[old] for c in (self.key, self.at, self.length, self.bucket, self.count))
        moved = np.zeros(len(self.key), np.int64)
        self._make(bits)
        moved[old] = slot = self._place(key, at, length)[0]
        self.bucket[slot], self.count[slot] = bucket, count
        return moved

    def intern(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The slot of each run (their starts differ); grow() has made room."""
        slot, new = self._place(xxhash64(self.data, start, length), start, length)
        fresh, raw = slot[new], self.data.data
        self.bucket[fresh] = [zlib.crc32(raw[a : a + n]) % self.buckets for a, n in zip(start[new].tolist(), length[new].tolist())]
        np.add.at(self.count, slot, 1)
        return slot

    def _place(self, key: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each run, the runs that took a new slot)."""
        mask = len(self.key) - 1
        slot, left, new = (key & U64(mask)).astype(np.int64), np.arange(len(key)), []
        while len(left):
            s = slot[left]
            free = self.at[s] < 0
            first = left[free]
            self.at[s[free]] = start[first]  # of several that want one slot the last stays
            first = first[self.at[s[free]] == start[first]]
            self.key[slot[first]], self.length[slot[first]] = key[first], length[first]
            new.append(first)
            own = (self.key[s] == key[left]) & (self.length[s] == length[left])
            own[own] = self._same_bytes(start[left[own]], self.at[s[own]], length[left[own]])
            left = left[~own]
            slot[left] = (slot[left] + 1) & mask
        new = np.concatenate(new) if new else left
        self.taken += len(new)
        return slot, new

    def _same_bytes(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        same = np.ones(len(a), dtype=bool)
        for j in range(0, int(length.max(initial=0)), 8):
            some = np.flatnonzero(same & (length > j) & (a != b))
            if not len(some):
                break
            differ = self.eight[a[some] + j] ^ self.eight[b[some] + j]
            unused = np.maximum(8 - (length[some] - j), 0).astype(U64) * U64(8)
            same[some] = differ << unused == 0
        return same


def interned(column: pa.Array, most: int, buckets: int) -> tuple[Interned, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The runs of 1 .. ``most`` words of texts: their table, how many words each text has, and (text, slot) of each run."""
    w = Words(column, ALNUM_WORD, lower=True, hashed=False)
    length = w.end - w.start
    start = np.cumsum(length + 1) - (length + 1)
    total = int(length.sum()) + len(length)
    data, filled = np.full(total + 8, 0x20, np.uint8), np.ones(total, dtype=bool)
    filled[start + length] = False
    data[:total][filled] = w.data[ALNUM_WORD[w.data]]  # the words of all texts, a space after each
    found, at = Interned(data, buckets), []
    for n in range(1, most + 1):
        first = np.flatnonzero(within(w.row, n))
        for a in range(0, len(first), AT_ONCE):
            some = first[a : a + AT_ONCE]
            moved = found.grow(len(some))
            if moved is not None:
                at = [(row, moved[slot]) for row, slot in at]
            at.append((w.row[some], found.intern(start[some], start[some + n - 1] + length[some + n - 1] - start[some])))
    return found, np.diff(w.first), at


def bucket_counts(docs: DataFrame, most: int, buckets: int) -> np.ndarray:
    """How many n-grams of docs fall into each bucket; ``buckets`` rows a task at most, and as many on the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in (part for batch in batches for part in slices(batch)):
            t = interned(b.column("text"), most, buckets)[0]
            some = np.flatnonzero(t.at >= 0)
            np.add.at(total, t.bucket[some], t.count[some])
            release()
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full], pa.int64())], names=["bucket", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in sums:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much likelier each bucket is in the target, one added to each count; rounded down."""
    s, t, b = float(source.sum()), float(target.sum()), len(source)
    return np.array([floor(1000 * log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(source.tolist(), target.tolist())], np.int64)


def importance_weights(docs: DataFrame, gains: np.ndarray, most: int, carry: tuple = ()) -> DataFrame:
    """The columns ``carry`` of docs, n_words, n_features and weight: the floored mean of the gains of a text's n-grams (none: 0)."""
    buckets = len(gains)

    def run(batches):
        for b in (part for batch in batches for part in slices(batch)):
            t, n_words, at = interned(b.column("text"), most, buckets)
            gain = gains[t.bucket]
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for row, slot in at:
                n += np.bincount(row, minlength=b.num_rows)
                np.add.at(total, row, gain[slot])
            made = [pa.array(x, pa.int64()) for x in (n_words, n, total // np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], *made], names=[*carry, "n_words", "n_features", "weight"])
            release()

    narrow = docs.select(*carry, *[] if "text" in carry else [F.col("text").cast("string").alias("text")])
    return narrow.mapInArrow(run, with_fields("", narrow, carry, "n_words long, n_features long, weight long"))


def gumbel_score(seed: int) -> Column:
    """weight plus 1000 times a Gumbel draw of doc_id, rounded down: the highest scores are a draw without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, target: DataFrame, seed: int, most: int, buckets: int, carry: tuple) -> DataFrame:
    gains = bucket_gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))
    return importance_weights(docs, gains, most, carry).withColumn("score", gumbel_score(seed))


def ranked_weights(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, most: int = 1, buckets: int = 10000) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of docs (doc_id, text).

    Features are all runs of 1 .. ``most`` words (letters, digits and other characters over ASCII, A-Z lower-cased), each in
    the bucket of its CRC-32. rank counts the drawn ones from 1 in the order of score (highest first), doc_id, then
    weight and n_features: ``percent`` of the rows with at least ``least_words`` words. Others have none. Rows are ordered
    by a range partitioning, written once; a row's rank is its place there after the counts of the partitions before.

    Null or empty text: no features, weight 0. Null doc_id: drawn as the empty id, after all others of a score. Repeated
    rows have equal scores and ranks that follow each other. Very long texts are read whole. No target, or one without words:
    all buckets have none. Empty table: no rows. Other columns are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scored(narrow, target, seed, most, buckets, ("doc_id",)).withColumn("_in", F.col("n_words") >= least_words)
    order = [F.desc("_in"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stash(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", PLACE_BITS), F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.count(F.when(F.col("_in"), 1)).alias("_ins"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.floor(F.sum("_ins").over(Window.partitionBy()) * percent / 100).alias("_most"))
    rank = F.col("_before") + place + 1
    return placed.withColumn("_part", part).join(offsets, "_part").select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_in") & (rank <= F.col("_most")), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, most: int = 1, buckets: int = 10000) -> DataFrame:
    """The drawn rows of docs, whole: those that ranked_weights ranks, with whatever other columns they have.

    The last drawn row's score and ties decide in one more pass over the texts, which are not shuffled; of rows that are
    equal to it in doc_id, weight and n_features, as many as are drawn stay.
    """
    ranks = ranked_weights(docs, target, percent, least_words, seed, most, buckets)
    drawn = ranks.where("rank IS NOT NULL")
    last = drawn.orderBy(F.desc("rank")).first()
    if last is None:
        return docs.limit(0)
    key = ("score", "doc_id", "weight", "n_features")
    equal = F.lit(True)
    for c in key:
        equal &= F.col(c).eqNullSafe(F.lit(last[c]))
    n_equal = drawn.where(equal).count()
    rows = scored(aside(docs), target, seed, most, buckets, ("doc_id", "text", "_others")).where(F.col("n_words") >= least_words)
    earlier, ties = F.lit(False), F.lit(True)
    for c in key:
        own, its = F.col(c), F.lit(last[c])
        if c == "doc_id":
            its = F.lit(2**63 - 1) if last[c] is None else its
            own = F.coalesce(own, F.lit(2**63 - 1))
        earlier |= ties & (own < its if c == "doc_id" else own > its)
        ties &= own == its
    return restored(rows.where(earlier).unionByName(rows.where(ties).limit(n_equal)), docs.columns)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of documents, with the benchmark's texts as the target; nulls,
    ties and repeated rows as in ranked_weights."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return ranked_weights(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH RECURSIVE step(b, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
dn AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL),
bn AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY ALL),
words AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM (SELECT word FROM dn UNION SELECT word FROM bn)),
placed AS (SELECT word, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 17)::BIGINT),
    lambda c, y: xor(c // 256, crc.t[xor(c % 256, y) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM words, crc),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM dn JOIN placed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM bn JOIN placed USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n, floor(sum(n * gain) / sum(n)) AS weight FROM dn JOIN placed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM d LEFT JOIN weights USING (doc_id)),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, floor(10 * count(*) OVER () / 100) AS most FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank FROM scored LEFT JOIN ranks USING (doc_id)
"""
