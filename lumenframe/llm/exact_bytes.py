"""Byte-level substring dedup: suffix arrays over shards of possibly repeated text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import answer_keys, codes_of, deal, distinct, from_ipc, parts_of, send_keys, to_blocks, with_answers
from ._shared import stash, table
from ._text import BASE, BYTE_CODE, U64, cover, mix, powers, release, string_bytes
from .suffix import Scratch, suffix_order

LENGTH = 200
#: Anchors are runs of so many bytes, the smallest by hash in each window of LENGTH.
ANCHOR = 100
#: An anchor with so many segments in all blocks together is split: its windows are dealt one by one.
CROWD = 1 << 14
#: Whole groups of one anchor make a shard, up to so many bytes of text; a larger group is a shard of its own. Half of what
#: Scratch holds in memory: a shard ends once it is over, so at twice that nearly every one went through files.
SHARD = 1 << 19
_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
_STRIDE = 1 << 19


class Segments:
    """The windows of a batch of texts, in runs that share their anchor.

    start, windows: first window and number of windows of each segment (its text is windows + LENGTH - 1 bytes);
    key: hash of the anchor; content: hash of the segment's bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
        found = [self._some(data, offsets, a, min(a + _STRIDE, len(data) - length + 1), length, anchor) for a in range(0, max(0, len(data) - length + 1), _STRIDE)]
        cat = lambda i, t: np.concatenate([f[i] for f in found]) if found else np.zeros(0, t)
        self.start, self.windows, self.key, self.content = cat(0, np.int64), cat(1, np.int64), cat(2, U64), cat(3, U64)

    @staticmethod
    def _some(data, offsets, lo, hi, length, anchor):
        """Segments of the windows that start in lo:hi."""
        text = data[lo : hi + length - 1]
        n = len(text)
        prefix = np.zeros(n + 1, U64)
        np.cumsum(BYTE_CODE[text] * powers(n)[:n], out=prefix[1:])
        inverse = powers(n, _INVERSE)
        grams = mix((prefix[anchor:] - prefix[: n - anchor + 1]) * inverse[: n - anchor + 1])
        # the smallest of each window, the leftmost of equals: the low bits of the compared value are the place
        place = U64((1 << 20) - 1)
        value = (grams & ~place) | np.arange(len(grams), dtype=U64)
        w = length - anchor + 1
        padded = np.full(-(-len(value) // w) * w, ~U64(0))
        padded[: len(value)] = value
        rows = padded.reshape(-1, w)
        left = np.minimum.accumulate(rows, axis=1).reshape(-1)
        right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        count = hi - lo
        best = (np.minimum(right[:count], left[w - 1 : w - 1 + count]) & place).astype(np.int64)
        # windows inside one text only
        texts = slice(int(np.searchsorted(offsets, lo, side="right")) - 1, int(np.searchsorted(offsets, hi)))
        a, z = np.maximum(offsets[:-1][texts] - lo, 0), np.minimum(offsets[1:][texts] - length + 1 - lo, count)
        n_own = np.maximum(z - a, 0)
        s = np.repeat(a, n_own) + _ramp(n_own)
        best = best[s]
        new = np.ones(len(s), dtype=bool)
        new[1:] = (best[1:] != best[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(new)
        start, windows = s[first], np.diff(np.append(first, len(s)))
        end = start + windows + length - 1
        content = mix(((prefix[end] - prefix[start]) * inverse[start]) ^ (windows.astype(U64) * BASE))
        # the smallest hashes crowd at the low end: mixed again, they spread over all parts
        return start + lo, windows, mix(grams[best[first]] + BASE), content


class Units:
    """What a block sends of its texts: each distinct segment with its anchor's key, or, of crowded anchors, each distinct window.

    key, start, size, windows: of each unit; often: it occurs more than once in the block; place: unit of each occurrence,
    the occurrences being at starts, so many windows wide.
    """

    def __init__(self, segments: Segments, data: np.ndarray, codes: np.ndarray, anchor_of: np.ndarray, length: int):
        code = codes[anchor_of]
        plain, crowded = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        n = segments.windows[crowded]
        single = np.repeat(segments.start[crowded], n) + _ramp(n)
        own = _window_hashes(data, single, length)
        keys = np.concatenate([segments.key[plain], own])
        content = np.concatenate([mix(segments.key[plain] ^ (segments.content[plain] * BASE)), own])
        self.starts = np.concatenate([segments.start[plain], single])
        self.wide = np.concatenate([segments.windows[plain], np.ones(len(single), np.int64)])
        first, place = distinct(content)
        order = np.argsort(keys[first], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.place, first = rank[place], first[order]
        self.key, self.start, self.windows = keys[first], self.starts[first], self.wide[first]
        self.size = self.windows + length - 1
        self.often = np.bincount(self.place, minlength=len(first)) > 1


def _window_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` bytes from each start on, some at a time."""
    out = np.empty(len(starts), U64)
    pw = powers(length)[:length]
    for a in range(0, len(starts), 1 << 14):
        own = BYTE_CODE[data[starts[a : a + (1 << 14), None] + np.arange(length)[None, :]]]
        out[a : a + (1 << 14)] = mix((own * pw).sum(axis=1, dtype=U64) + STEP_OF_WINDOWS)
    return out


#: Keys of single windows are apart from those of anchors.
STEP_OF_WINDOWS = U64(0xA0761D6478BD642F)


def _anchors(t: pa.Table, length: int, anchor: int):
    data, offsets = string_bytes(t["text"])
    segments = Segments(data, offsets, length, anchor)
    first, anchor_of = distinct(segments.key)
    return data, offsets, segments, segments.key[first], anchor_of


def _repeated_anchors(keys, columns) -> np.ndarray:
    """0: one segment has this anchor, no window of it can repeat. 1: several. 2: CROWD or more."""
    segments, _ = columns
    _, group = distinct(keys)
    total = np.bincount(group, weights=segments)[group] if len(group) else np.zeros(0)
    return np.where(total >= CROWD, 2, total > 1).astype(np.uint8)


def _deflate(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[len(a) for a in arrays]], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _inflate(blob: bytes, dtypes: list[str]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, k, 8)
    at, out = 8 * (k + 1), []
    for size, dtype in zip(sizes.tolist(), dtypes):
        out.append(np.frombuffer(raw, dtype, size, at))
        at += size * np.dtype(dtype).itemsize
    return out


def repeated_windows(texts: list[bytes], length: int, scratch: Scratch | None = None) -> np.ndarray:
    """Mask over the bytes of the texts, laid end to end: where a window of ``length`` bytes starts that starts elsewhere too."""
    scratch = scratch or Scratch()
    sizes = np.array([len(x) for x in texts], np.int64)
    total = int(sizes.sum()) + len(sizes)
    laid, at = scratch.array(total, np.uint16), 0
    for x in texts:  # a 0 closes each text
        laid[at : at + len(x)] = np.frombuffer(x, np.uint8).astype(np.uint16) + 1
        at += len(x) + 1
    order, common = suffix_order(laid, length, scratch)
    met = scratch.array(total, np.uint8)
    for a, b in scratch.slices(total):
        long = a + np.flatnonzero(np.asarray(common[a:b]) >= length)
        met[order[long]] = 1
        met[order[long - 1]] = 1
    return met


def _shards(some: np.ndarray, group: np.ndarray, sizes: list[int]) -> Iterator[list[int]]:
    """The texts ``some``, whole groups together, in shards of some SHARD bytes."""
    shard, held, last = [], 0, None
    for i in some[np.argsort(group[some], kind="stable")].tolist():
        if held >= SHARD and group[i] != last:
            yield shard
            shard, held = [], 0
        shard.append(i)
        held, last = held + sizes[i], group[i]
    if shard:
        yield shard


def _by_suffixes(length: int):
    """For each block: its units whose windows start elsewhere too, and which of them do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}  # texts, told apart by their bytes
        anchors, copies, asked = [], [], []
        for b in batches:
            for block, blob in zip(b.column("block_id").to_pylist(), b.column("blob")):
                keys, entry, sizes, often, texts = _inflate(blob.as_py(), ["u8", "u4", "u4", "u1", "u1"])
                raw, ends = texts.tobytes(), np.cumsum(sizes, dtype=np.int64).tolist()
                own = np.empty(len(keys), np.int64)
                for j, (z, n, key, twice) in enumerate(zip(ends, sizes.tolist(), keys.tolist(), often.tolist())):
                    text = raw[z - n : z]
                    i = known.setdefault(text, len(known))
                    if i == len(anchors):
                        anchors.append(key)
                        copies.append(0)
                    copies[i] += 1 + twice
                    own[j] = i
                asked.append((block, entry, own))
        flags: list[np.ndarray | None] = [np.ones(len(x) - length + 1, np.uint8) if copies[i] > 1 else None for x, i in known.items()]
        # different texts with one anchor may share windows
        _, group = distinct(np.array(anchors, np.uint64))
        shared = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        texts = list(known)
        for some in _shards(np.flatnonzero(shared), group, [len(x) for x in texts]):
            mask, at = repeated_windows([texts[i] for i in some], length), 0
            for i in some:
                if flags[i] is None:
                    flags[i] = np.asarray(mask[at : at + len(texts[i]) - length + 1]).copy()
                at += len(texts[i]) + 1
            release()
        for block, entry, own in asked:
            hit = [j for j, i in enumerate(own.tolist()) if flags[i] is not None and flags[i].any()]
            if hit:
                found = [flags[own[j]] for j in hit]
                blob = _deflate(entry[hit], np.array([len(f) for f in found], np.uint32), np.concatenate(found).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([blob], pa.binary())], names=["block_id", "blob"])

    return run


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, with_bytes: bool = True) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else, in any text or the same one.

    Equal windows have equal anchors (their smallest ``anchor``-byte run by hash), so texts are dealt to shards by
    anchors: a shard holds segments (runs of windows with one anchor) whose anchor comes more than once, of each block one
    copy, and no repeat crosses shards. Crowded anchors are split by whole windows. In a shard equal texts are found by
    their bytes, and those that share an anchor with other texts go into its suffix order, by external induced sorting
    with queues on disk, which gives the common prefixes of neighbours: windows with a common prefix of ``length`` are
    repeats. So hashes only choose what is compared, but for equal segments of one block, which meet by a 64-bit hash.

    One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_bytes, kept (binary: what is
    left may not be UTF-8). Null or empty text: 0 bytes. Null doc_id, repeated rows: rows like all others, so equal
    long rows lose all they share. Very long texts: whole. Empty table: no rows. Other columns are not read.
    """
    blocks = to_blocks(docs)
    parts = parts_of(blocks)

    def anchors(t: pa.Table):
        _, _, segments, keys, anchor_of = _anchors(t, length, anchor)
        return keys, [np.bincount(anchor_of, minlength=len(keys)).astype(np.uint32), np.zeros(len(keys), np.uint8)]

    answered = answer_keys(send_keys(blocks, anchors, parts), _repeated_anchors, ["u4", "u1"], parts, "anchors")
    shift = U64(64 - parts.bit_length() + 1)

    def units(payload: bytes, blobs: list):
        t = from_ipc(payload)
        data, offsets, segments, _, anchor_of = _anchors(t, length, anchor)
        return t, data, offsets, Units(segments, data, codes_of(blobs), anchor_of, length)

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, data, _, own = units(batch.column("payload")[i].as_py(), batch.column("anchors")[i].as_py())
                part = (own.key >> shift).astype(np.int64) if parts > 1 else np.zeros(len(own.key), np.int64)
                cuts = np.searchsorted(part, np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    some = slice(cuts[p], cuts[p + 1])
                    texts = np.concatenate([data[a : a + n] for a, n in zip(own.start[some].tolist(), own.size[some].tolist())])
                    blob = _deflate(own.key[some], np.arange(cuts[p], cuts[p + 1], dtype=np.uint32), own.size[some].astype(np.uint32), own.often[some].astype(np.uint8), texts)
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), batch.column("block_id").slice(i, 1), pa.array([blob], pa.binary())], names=["part", "block_id", "blob"])
                release()

    asked = with_answers(blocks, answered)
    sent = asked.mapInArrow(send, "part int, block_id long, blob binary")
    replies = deal(sent, parts).applyInArrow(_by_suffixes(length), "block_id long, blob binary")
    found = stash(replies.groupBy("block_id").agg(F.collect_list("blob").alias("found")))

    def finish(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield make(*units(batch.column("payload")[i].as_py(), batch.column("anchors")[i].as_py()), batch.column("found")[i].as_py() or [])
                release()

    def make(t: pa.Table, data: np.ndarray, offsets: np.ndarray, own: Units, blobs: list[bytes]) -> pa.RecordBatch:
        marks, flags = np.full(len(own.key), -1, np.int64), [np.zeros(0, np.uint8)]
        at = 0
        for blob in blobs:
            entry, windows, found = _inflate(blob, ["u4", "u4", "u1"])
            marks[entry] = at + np.cumsum(windows, dtype=np.int64) - windows
            flags.append(found)
            at += len(found)
        flags = np.concatenate(flags)
        hit = np.flatnonzero(marks[own.place] >= 0) if len(own.place) else np.zeros(0, np.int64)
        ramp = _ramp(own.wide[hit])
        places = np.repeat(own.starts[hit], own.wide[hit]) + ramp
        gone = cover(places[flags[np.repeat(marks[own.place[hit]], own.wide[hit]) + ramp] > 0], length, len(data))
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        opens = offsets[:-1][offsets[:-1] < len(data)]
        edge[opens] = gone[opens]
        sums = np.concatenate([[0], np.cumsum(gone)])
        spans = np.concatenate([[0], np.cumsum(edge)])
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        columns = {
            "doc_id": t["doc_id"].combine_chunks(),
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "n_removed": pa.array(np.diff(sums[offsets]), pa.int64()),
            "n_spans": pa.array(np.diff(spans[offsets]), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
        if with_bytes:
            columns["kept"] = pa.array(kept, pa.binary())
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    return with_answers(blocks, answered, found).select("payload", "anchors", "found").mapInArrow(finish, schema)


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0 .. counts[0] - 1, 0 .. counts[1] - 1, ..."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeated_bytes of documents, a row each; nulls, ties and repeated rows as stated there."""
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), with_bytes=False)


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
win AS (SELECT doc_id, i, md5(h[2 * i + 1:2 * i + 400]) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM n WHERE n >= 200)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
st AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM rep),
isl AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM st),
sp AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM isl GROUP BY doc_id, g),
gap AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM sp UNION ALL SELECT doc_id, 0, min(a) FROM sp GROUP BY doc_id),
tot AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM sp GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(h[2 * a + 1:2 * coalesce(b, n)], '' ORDER BY a) AS k FROM gap JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM n LEFT JOIN tot USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
