"""Substring dedup over words: fixed-block anchors find where passages may repeat, whole windows decide."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._blocks import ask, distinct, finish, ids_of, parts_of, to_blocks, with_answers
from ._shared import table
from ._text import STEP, Words, cover, grams, mix, within


def _anchor_entries(words: Words, block: int):
    """Each distinct rolling run of ``block`` words: is it a reference block somewhere here, is it here twice."""
    starts = np.flatnonzero(within(words.row, block))
    keys = grams(words.hash, block)[starts]
    aligned = (starts - words.first[words.row[starts]]) % block == 0
    first, group = distinct(keys)
    n = len(first)
    flags = (np.bincount(group[aligned], minlength=n) > 0) + 2 * (np.bincount(group, minlength=n) > 1)
    return keys[first], flags.astype(np.uint8), starts, group


def _anchors_met(keys, columns):
    """1: a reference block that some other window equals."""
    _, group = distinct(keys)
    n = int(group.max()) + 1 if len(group) else 0
    met = np.bincount(group[(columns[0] & 1) > 0], minlength=n) > 0
    twice = (np.bincount(group, minlength=n) > 1) | (np.bincount(group[(columns[0] & 2) > 0], minlength=n) > 0)
    return (met & twice)[group].astype(np.uint8)


def _window_entries(words: Words, ids: np.ndarray, anchors: np.ndarray, window: int, block: int):
    """Windows that hold a met anchor: distinct keys, each with its first occurrence in this block."""
    _, _, at, group = _anchor_entries(words, block)
    met = np.zeros(len(words) + 1, dtype=np.int64)
    met[at[anchors[group] > 0] + 1] = 1
    met = np.cumsum(met)
    ok = within(words.row, window)
    starts = np.flatnonzero(ok & (met[window - block + 1 :][: len(ok)] > met[: len(ok)])) if len(ok) else np.zeros(0, np.int64)
    keys, more = grams(words.hash, window)[starts], grams(mix(words.hash + STEP), window)[starts]
    doc = ids[words.row[starts]]
    place = (starts - words.first[words.row[starts]]).astype(np.int64)
    first, group = distinct(keys, doc, place, also=more)
    return keys, more, doc, place, starts, first, group


def _earliest(keys, columns):
    """1: no equal window starts earlier in any block."""
    more, doc, place = columns
    first, group = distinct(keys, doc, place, also=more)
    return ((doc == doc[first][group]) & (place == place[first][group])).astype(np.uint8)


def repeated_words(words: Words, ids: np.ndarray, anchors: np.ndarray, leaders: np.ndarray, window: int, block: int) -> np.ndarray:
    """Mask of the words to remove."""
    keys, _, doc, place, starts, first, group = _window_entries(words, ids, anchors, window, block)
    if not len(keys):
        return np.zeros(len(words), dtype=bool)
    lead = first[group]
    keep = (leaders[group] > 0) & (doc == doc[lead]) & (place == place[lead])
    return cover(starts[~keep], window, len(words))


def remove_repeated_passages(docs: DataFrame, window: int = 20, block: int = 10, with_text: bool = True) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that starts earlier (smaller doc_id, then earlier start).

    Any window of ``window`` >= 2 * ``block`` - 1 words holds one whole non-overlapping reference block of its
    earliest occurrence, so its every other occurrence holds a rolling run equal to it. Round one indexes the
    reference blocks and probes them with all rolling runs; round two extends hits to whole windows and finds the
    earliest of each; the union of removed windows are the maximal exact repeats.

    One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, with_text, kept (words joined by one space).
    Null or empty text: no words. Null doc_id: later than all others. Rows with one doc_id and equal text start at the
    same place, so neither is earlier. Very long texts are read whole. Empty table: no rows. Other columns of docs are not
    read. Windows are compared by 128 bits of their words.
    """
    if window < 2 * block - 1:
        raise ValueError("window must be at least 2 * block - 1 words")
    blocks = to_blocks(docs)
    parts = parts_of(blocks)
    anchors = ask(blocks, lambda t: (lambda e: (e[0], [e[1]]))(_anchor_entries(Words(t["text"]), block)), _anchors_met, ["u1"], parts, name="anchors")

    def windows(t: pa.Table, met: np.ndarray):
        keys, more, doc, place, _, first, _ = _window_entries(Words(t["text"]), ids_of(t), met, window, block)
        return keys[first], [more[first], doc[first], place[first]]

    asked = with_answers(blocks, anchors)
    leaders = ask(asked, windows, _earliest, ["u8", "i8", "i8"], parts, ["anchors"], name="leaders")

    def make(t: pa.Table, met: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
        words = Words(t["text"])
        gone = repeated_words(words, ids_of(t), met, lead, window, block)
        n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
        kept = []
        for i, text in enumerate(t["text"]):
            own = (text.as_py() or "").encode().split()
            if n_removed[i]:
                own = compress(own, ~gone[words.first[i] : words.first[i + 1]])
            kept.append(b" ".join(own))
        sha = [hashlib.sha256(k).hexdigest() for k in kept]
        columns = [t["doc_id"].combine_chunks(), pa.array(np.diff(words.first), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns, names = [*columns, pa.array(kept, pa.binary()).cast(pa.string())], [*names, "kept"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return finish(with_answers(blocks, anchors, leaders), make, schema, ["anchors", "leaders"])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeated_passages of documents, a row each; nulls, ties and repeated rows as stated there."""
    return remove_repeated_passages(table(spark, sf_dir, "documents"), with_text=False)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d),
win AS (SELECT doc_id, i, list_aggregate(w[i:i + 19], 'string_agg', ' ') AS k FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
covered AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS i FROM dup),
gone AS (SELECT doc_id, count(*) AS n_removed FROM covered GROUP BY doc_id),
kept AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.i) AS s FROM t ANTI JOIN covered c ON t.doc_id = c.doc_id AND t.i = c.i GROUP BY t.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(gone.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
