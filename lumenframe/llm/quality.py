"""Quality rules with cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import aside, restored, salted_join, skew_join, stash, table

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
GRAM = 5
#: A line goes where more documents of one host than this hold it.
MOST_DOCS_A_HOST = 10
#: A document is depleted with fewer words left, or a smaller share of its words.
LEAST_WORDS = 10
LEAST_SHARE = 0.3


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words to docs (text); drops text. Null text: zeros."""
    keep = [f"`{c}`" for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    s1 = docs.select(
        *keep,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN)).alias("_w"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    s2 = s1.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    none = F.array().cast("array<bigint>")
    # hashes of the windows of a text; only a text in which one comes twice is sorted
    at = lambda i, j: F.get("_h", i + j)
    s3 = s2.select(*keep, *counts, F.when(F.size("_h") < GRAM, none).otherwise(F.transform(F.sequence(F.lit(0), F.size("_h") - GRAM), lambda i: F.xxhash64(*[at(i, j) for j in range(GRAM)]))).alias("_g"))
    pairs = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    s4 = s3.select(*keep, *counts, F.when(F.size("_g") != F.size(F.array_distinct("_g")), pairs).alias("_s"))
    same = lambda x, j: F.get("_s", j)["g"] == x["g"]
    met = F.transform("_s", lambda x, j: F.when(F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)), x["i"]))
    s5 = s4.select(*keep, *counts, F.sort_array(F.filter(met, lambda x: x.isNotNull())).alias("_at"))
    steps = F.transform("_at", lambda x, j: F.least(F.lit(GRAM), F.coalesce(F.get("_at", j + 1) - x, F.lit(GRAM))))
    total = F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return s5.select(*keep, *counts, total.alias("n_repeat_words"))


def _norm(line):
    return F.regexp_replace(F.regexp_replace(F.btrim(F.lower(line), F.lit(SPACES)), SPACE_RUN, " "), "[0-9]+", "0")


def _host_line(source, line):
    """A line on its host, as a hash; null for a line without words."""
    text = _norm(line)
    return F.when(text != "", F.xxhash64(source.isNull(), source, text))


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", "text")


def frequent_lines(docs: DataFrame, most_docs: int = MOST_DOCS_A_HOST) -> DataFrame:
    """(_key, host_line, words, often): the distinct lines of each document, and whether over ``most_docs`` documents of its host hold them.

    Lines are compared lower-cased, trimmed, with runs of white space as one space and runs of digits as one 0. words:
    of all lines of the document that compare equal. A line counts once a document, before it is shuffled.
    """
    line = docs.select("_key", "source", F.explode(F.split("text", "\n")).alias("line")).select("_key", _host_line(F.col("source"), F.col("line")).alias("host_line"), F.size(F.split(_norm(F.col("line")), " ")).cast("long").alias("words"))
    lines = stash(line.where("host_line IS NOT NULL").groupBy("_key", "host_line").agg(F.sum("words").alias("words")))
    often = lines.groupBy("host_line").agg(F.count("*").alias("docs")).where(F.col("docs") > most_docs).select("host_line", F.lit(True).alias("often"))
    return salted_join(lines, often, "host_line", "_key")


def quality_rules(docs: DataFrame, most_docs: int = MOST_DOCS_A_HOST, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, the base counts, n_left (words left), base_failed, kept for each row of docs (doc_id, text, source).

    Words are [^\\x20\\x09-\\x0D]+. base_failed: fewer than ``least_words`` words, or over a fifth of them in repeated
    five-word windows. kept: not base_failed, and not depleted by the removal of lines frequent on its host.
    Null text: no words, fails. Null source: a host of its own. Rows with equal doc_id, source and text count as one
    document for line frequency and get a row each; null doc_id: told apart by source and text. Very long texts are read
    whole. Empty table: no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    docs = docs.withColumn("_key", _key())
    base = base_counts(docs.select("doc_id", "_key", "text"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    shares = frequent_lines(docs, most_docs).groupBy("_key").agg(F.sum("words").alias("total"), F.sum(F.when(F.col("often"), F.col("words")).otherwise(0)).alias("gone"))
    joined = skew_join(base, shares, "_key")
    left = F.coalesce(F.floor(F.col("n_words") * (F.col("total") - F.col("gone")) / F.col("total")), F.lit(0)).cast("long")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), left.alias("n_left")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_left") >= least_words) & (F.col("n_left") >= least_share * F.col("n_words"))
    )


def apply_quality_rules(docs: DataFrame, most_docs: int = MOST_DOCS_A_HOST, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """docs with the lines that are frequent on their host removed from their texts, without the documents that are depleted by it.

    A document is depleted if fewer than ``least_words`` words, or a smaller share than ``least_share`` of them, are left.
    Null text: depleted. All else as in quality_rules; other columns come along whatever their names.
    """
    inner = aside(docs).select("doc_id", "text", "_others", F.col("_others").getField("source").cast("string").alias("source")).withColumn("_key", _key())
    gone = frequent_lines(inner.select("_key", "source", "text"), most_docs).where("often").groupBy("_key").agg(F.collect_set("host_line").alias("gone"))  # of one document
    words = lambda t: F.size(F.filter(F.split(t, SPACE_RUN), lambda x: x != ""))
    left = F.filter(F.split("text", "\n"), lambda x: ~F.coalesce(F.array_contains("gone", _host_line(F.col("source"), x)), F.lit(False)))
    cleaned = skew_join(inner, gone, "_key").withColumn("_before", words(F.col("text"))).withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    return restored(cleaned.withColumn("_left", words(F.col("text"))).where((F.col("_left") >= least_words) & (F.col("_left") >= least_share * F.col("_before"))), docs.columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality_rules of documents: a row each, with nulls, ties and repeated rows as stated there."""
    return quality_rules(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + unnest(range(0, 5)) AS i FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
n AS (SELECT doc_id, source, regexp_replace(regexp_replace(trim(lower(line), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g') AS line FROM l),
c AS (SELECT doc_id, line, len(string_split(line, ' ')) AS words, count(*) OVER (PARTITION BY doc_id, line) AS own,
  source FROM n WHERE line <> ''),
f AS (SELECT source, line FROM c GROUP BY source, line HAVING count(DISTINCT doc_id) > 10),
s AS (SELECT c.doc_id, sum(words) AS total, coalesce(sum(words) FILTER (f.line IS NOT NULL), 0) AS gone
  FROM c LEFT JOIN f ON c.line = f.line AND c.source IS NOT DISTINCT FROM f.source GROUP BY c.doc_id),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(floor(len(w) * (total - gone)::DOUBLE / total), 0)::BIGINT AS n_left
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_left >= 10 AND n_left >= 0.3::DOUBLE * n_words AS kept FROM b
"""
