"""Line dedup within a word-edit bound: deletion neighbourhoods joined by hashed keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import answered, aside, clear, own_tables, placed, restored, skew_join, stash, stash_texts, table
from ._text import BASE, STEP, U64, Words, mix, powers, release, slices

#: Lines one word edit apart are repeats if that is at most a fifth of the longer one's words, so if it has 5 or more.
LEAST_WORDS = 5
#: Bytes of text that a task splits into words at once.
AT_ONCE = 1 << 20
SPACE_RUN = r"[\x20\x09-\x0D]+"
INVERSE = U64(pow(int(BASE), -1, 1 << 64))


class Lines:
    """The lines of a batch of texts that hold words: row, number in the text, and their words' span."""

    def __init__(self, column):
        self.words = w = Words(column)
        breaks = np.flatnonzero(w.data == 0x0A)
        line_of_word = np.searchsorted(breaks, w.start)
        new = np.ones(len(w), dtype=bool)
        new[1:] = (line_of_word[1:] != line_of_word[:-1]) | (w.row[1:] != w.row[:-1])
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.append(self.first, len(w)))
        self.row = w.row[self.first]
        self.number = line_of_word[self.first] - np.searchsorted(breaks, w.offsets[:-1])[self.row]
        self.at = np.arange(len(w)) - np.repeat(self.first, self.count)

    def prefix(self) -> np.ndarray:
        """Sums of the words' hashes times powers of BASE, counted from the start of their line."""
        h = self.words.hash
        out = np.zeros(len(h) + 1, dtype=U64)
        np.cumsum(h * powers(int(self.count.max()) + 1 if len(self.count) else 1)[self.at], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, skip: np.ndarray, take: np.ndarray) -> np.ndarray:
        """A hash of ``take`` words of each line from its word ``skip`` on."""
        a = self.first + skip
        sums = (prefix[a + take] - prefix[a]) * powers(int(skip.max()) + 1 if len(skip) else 1, INVERSE)[skip]
        return mix(sums ^ (take.astype(U64) * STEP))

    def whole(self) -> np.ndarray:
        return self.runs(self.prefix(), np.zeros_like(self.count), self.count)

    def ends(self, quarters: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
        """(key, line) of what an edit leaves whole, once for partners of up to a line's length, once for longer ones.

        Of two lines one word edit apart, the longer with c words, the edit leaves the first c // 2 or the last c // 2
        words of both whole, and with ``quarters`` the first or the last half of what remains as well. A line of n words is
        the longer one (c = n) or the shorter (c = n + 1). The key holds c. Lines for which c is too small have none.
        """
        prefix, out = self.prefix(), []
        for c in (self.count, self.count + 1):
            line = np.flatnonzero(c >= LEAST_WORDS)
            half, none = c // 2, np.zeros_like(c)
            more = (c - half) // 2 if quarters else none
            kept = [(half + more, none), (half, more), (more, half), (none, half + more)] if quarters else [(half, none), (none, half)]
            for salt, (front, back) in enumerate(kept, 1):
                key = self.runs(prefix, none, front) + self.runs(prefix, self.count - back, back) * STEP
                out.append((mix(key ^ (c * 8 + salt).astype(U64) * BASE)[line], line))
        return out

    def variants(self):
        """Key of each line of LEAST_WORDS words or more without each word, the word's place, the line."""
        prefix = self.prefix()
        line = np.repeat(np.arange(len(self.first)), self.count)
        w = np.flatnonzero(self.count[line] >= LEAST_WORDS)
        line = line[w]
        start = self.first[line]
        left = prefix[w] - prefix[start]
        right = (prefix[start + self.count[line]] - prefix[w + 1]) * INVERSE
        return mix((left + right) ^ ((self.count[line] - 1).astype(U64) * STEP)), self.at[w], line


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _lines(batches):
    """Every line with words: _at, _doc, number, w, a hash of its words, and h0 .. h3, the keys of its halves."""
    for b in (part for batch in batches for part in slices(batch, limit=AT_ONCE)):
        lines = Lines(b.column("text"))
        row, columns = pa.array(lines.row), []
        for key, line in lines.ends():
            out, none = np.zeros(len(lines.row), np.int64), np.ones(len(lines.row), dtype=bool)
            out[line], none[line] = key.view(np.int64), False
            columns.append(pa.array(out, pa.int64(), mask=none))
        yield pa.RecordBatch.from_arrays([b.column("_at").take(row), b.column("_doc").take(row), _long(lines.number), _long(lines.whole()), *columns], names=["_at", "_doc", "number", "w", "h0", "h1", "h2", "h3"])
    release()


def _candidate_lines(batches):
    """The lines of each text whose numbers are in ``wanted``, as their words joined by a space."""
    for b in (part for batch in batches for part in slices(batch, limit=AT_ONCE)):
        docs, numbers, texts = [], [], []
        for doc, text, wanted in zip(b.column("_doc").to_pylist(), b.column("text").to_pylist(), b.column("wanted").to_pylist()):
            own = text.split("\n")
            docs += [doc] * len(wanted)
            numbers += wanted
            texts += [b" ".join(own[i].encode().split()).decode() for i in wanted]
        column = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([_long(Lines(column).whole()), pa.array(docs, pa.int64()), pa.array(numbers, pa.int64()), column], names=["w", "_doc", "number", "line"])
    release()


def _quarters(batches):
    for b in (part for batch in batches for part in slices(batch, "line", AT_ONCE)):
        ends = Lines(b.column("line")).ends(quarters=True)
        yield pa.RecordBatch.from_arrays([b.column("w").take(pa.array(np.concatenate([line for _, line in ends]))), _long(np.concatenate([key for key, _ in ends]))], names=["w", "end"])
    release()


def _variants(batches):
    """(key, place) of each line and its deletion variants; place 0: the whole line, i + 1: without word i."""
    for b in (part for batch in batches for part in slices(batch, "line", AT_ONCE)):
        lines = Lines(b.column("line"))
        key, place, line = lines.variants()
        row = pa.array(np.concatenate([lines.row, lines.row[line]]))
        columns = [_long(np.concatenate([lines.whole(), key])), pa.array(np.concatenate([np.zeros(len(lines.row), np.int64), place + 1]), pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, *[b.column(c).take(row) for c in ("_doc", "number", "w")]], names=["key", "place", "_doc", "number", "w"])
    release()


def within_an_edit(a: list[str], b: list[str]) -> bool:
    """Whether one word replaced, inserted or deleted, or none, makes b of a."""
    if abs(len(a) - len(b)) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[at + 1 :] == b[at + 1 :] or a[at:] == b[at + 1 :] or a[at + 1 :] == b[at:]


def _verified(batches):
    for b in batches:
        ok = [within_an_edit(x.split(" "), y.split(" ")) for x, y in zip(b.column("line").to_pylist(), b.column("other").to_pylist())]
        yield b.select(["w"]).filter(pa.array(ok, pa.bool_()))
    release()


def _sharing(ends: DataFrame) -> DataFrame:
    """The lines w of ends (w, end; a line has an end once) that share one with another line."""
    shared = ends.groupBy("end").agg(F.count("*").alias("lines")).where("lines > 1").select("end")
    return skew_join(ends, shared, "end", "inner").select("w").distinct()


def near_earlier(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """(w): distinct lines with an earlier one that is not equal but one word edit away.

    distinct: w, lead (_doc, number, _at of the first occurrence), h0 .. h3. Lines that share neither half with another
    line drop out first, then those that share no three quarters: they have no neighbour. The others emit the key of every
    variant with one word deleted, and of the whole line. Equal keys: without the word at their places, the lines are
    equal. Two lines without words of the same place differ in one word; a line without a word is one insertion away from
    a whole line. With different places two edits may lie between them; if it is one after all, they also meet at equal
    places under another key. So each line is compared, word by word, with the earliest of its neighbours at every key:
    never all pairs of a group.
    """
    halves = distinct.select("w", F.explode(F.array("h0", "h1", "h2", "h3")).alias("end")).where("end IS NOT NULL")
    leads = skew_join(_sharing(halves), distinct.select("w", "lead"), "w", "inner")
    wanted = leads.groupBy("lead._at").agg(F.collect_set("lead.number").alias("wanted"))  # of one document
    own = answered(docs.select("_part", "_at", "_doc", "text"), wanted, "wanted").where("wanted IS NOT NULL").select("_doc", "text", "wanted")
    lines = stash_texts(own.mapInArrow(_candidate_lines, "w long, _doc long, number long, line string").dropDuplicates(["w"]))
    close = _sharing(lines.mapInArrow(_quarters, "w long, end long"))
    entries = stash(lines.join(close.hint("merge"), "w", "left_semi").mapInArrow(_variants, "key long, place int, _doc long, number long, w long"))
    first = stash(entries.groupBy("key", "place").agg(F.min(F.struct("_doc", "number", "w")).alias("first"), F.count("*").alias("lines")))
    of_key = first.groupBy("key").agg(F.min("first").alias("any_first"), F.min(F.when(F.col("place") == 0, F.col("first"))).alias("whole_first"), F.sum("lines").alias("all_lines")).where("all_lines > 1")
    best = first.join(of_key.hint("merge"), "key").select("key", "place", F.when(F.col("place") == 0, F.col("any_first")).otherwise(F.least("whole_first", "first")).alias("best"))
    met = skew_join(entries, best, ["key", "place"], "inner").where(F.struct("_doc", "number") > F.struct("best._doc", "best.number"))
    pairs = met.select("w", F.col("best.w").alias("o")).distinct()
    both = skew_join(skew_join(pairs, lines.select("w", "line"), "w", "inner"), lines.select(F.col("w").alias("o"), F.col("line").alias("other")), "o", "inner")
    return both.select("w", "line", "other").mapInArrow(_verified, "w long").distinct()


def _dedup(docs: DataFrame) -> DataFrame:
    """docs (_doc, text and others) with gone: the numbers of the lines to remove, or null."""
    spark, docs = docs.sparkSession, placed(docs)  # so that texts are not shuffled
    mark = own_tables()
    lines = stash_texts(docs.select("_at", "_doc", "text").mapInArrow(_lines, "_at long, _doc long, number long, w long, h0 long, h1 long, h2 long, h3 long"))
    distinct = lines.groupBy("w").agg(F.min(F.struct("_doc", "number", "_at")).alias("lead"), F.count("*").alias("times"), *[F.any_value(f"h{i}").alias(f"h{i}") for i in range(4)])
    distinct = stash(distinct)
    near = near_earlier(distinct, docs).withColumn("near", F.lit(True))
    judged = distinct.select("w", "lead", "times").join(near.hint("merge"), "w", "left").where("times > 1 OR near").select("w", F.struct("lead._doc", "lead.number").alias("lead"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = skew_join(lines.select("_at", "_doc", "number", "w"), stash(judged), "w", "inner").where(F.col("near") | (F.struct("_doc", "number") > F.col("lead")))
    gone = stash(gone.groupBy("_at").agg(F.collect_set(F.col("number").cast("int")).alias("gone")))  # of one document
    clear(spark, mark, gone)
    return answered(docs, gone, "gone")


def _narrowed(docs: DataFrame, *more) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.coalesce(doc_id, F.lit(2**63 - 1)).alias("_doc"), text.alias("text"), *more)


def _left_text() -> tuple:
    """Of a row of _dedup: its number of lines, and the text without the lines that go."""
    breaks = F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    kept = lambda own: F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("gone")), lambda i: F.get(own, i))
    # an array of one array: the text is split once, not for every line
    left = F.get(F.transform(F.array(F.split("text", "\n")), lambda own: F.array_join(kept(own), "\n")), 0)
    return F.coalesce(breaks + 1, F.lit(0)).cast("long"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)


def dedup_lines(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Remove every line for which an earlier one (smaller doc_id, then line) is equal or one word edit away.

    Lines end at \\n; words are [^\\x20\\x09-\\x0D]+, and lines are compared by their words. A word edit replaces, inserts or
    deletes one word, and counts where the longer line has LEAST_WORDS words or more, so that it changes a fifth of them
    at most. Lines without words stay. Equal lines meet by a 64-bit hash; see near_earlier for the others.

    One row per row of docs: doc_id, n_lines, n_removed (lines), kept_sha256 and, with_text, text (lines left, joined
    by \\n) and n_words (words left). Null text: no lines, sha of the empty string, text null. Null doc_id: later than
    all others. Rows with the same doc_id: lines with equal numbers are not earlier than each other. Repeated rows: a row
    each. Very long texts are read whole. Empty table: no rows. Other columns are not read.
    """
    n_lines, left = _left_text()
    out = _dedup(_narrowed(docs, F.col("doc_id").cast("long").alias("doc_id"))).withColumns({"n_lines": n_lines, "text": left})
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), SPACE_RUN), lambda x: x != "")).cast("long")
    columns = ["doc_id", "n_lines", F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")]
    return out.select(*columns, *(["text", words.alias("n_words")] if with_text else []))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the texts that dedup_lines leaves, and n_chars to match; documents that lose all their words go.

    Null and wordless texts stay as they are. All else as in dedup_lines; other columns come along whatever their names.
    """
    inner = aside(docs)
    lines = _dedup(_narrowed(inner, "_others")).withColumn("text", _left_text()[1]).where(F.col("gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    left = restored(lines, docs.columns)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_lines of documents, a row each; nulls, ties and repeated rows as stated there."""
    return dedup_lines(table(spark, sf_dir, "documents"), with_text=False)


OP10_SQL = r"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS no, ls[i] AS line, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw)),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, no) AS ord FROM l),
v AS (SELECT ord, 0 AS pos, array_to_string(w, ' ') AS k FROM o WHERE len(w) > 0
  UNION ALL SELECT ord, i AS pos, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') FROM (SELECT ord, w, unnest(range(1, len(w) + 1)) AS i FROM o WHERE len(w) >= 5)),
m AS (SELECT ord, pos, min(ord) OVER (PARTITION BY k) AS any_first, min(CASE WHEN pos = 0 THEN ord END) OVER (PARTITION BY k) AS whole_first, min(ord) OVER (PARTITION BY k, pos) AS place_first FROM v),
gone AS (SELECT DISTINCT ord FROM m WHERE (pos = 0 AND any_first < ord) OR (pos > 0 AND least(whole_first, place_first) < ord)),
kept AS (SELECT doc_id, count(*) AS n_lines, count(gone.ord) AS n_removed, string_agg(line, chr(10) ORDER BY no) FILTER (gone.ord IS NULL) AS s FROM o LEFT JOIN gone USING (ord) GROUP BY doc_id)
SELECT raw.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM raw LEFT JOIN kept USING (doc_id)
"""
