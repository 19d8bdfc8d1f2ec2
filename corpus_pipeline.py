"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, with
any extra ones (put aside as one struct, so that names can't clash). An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm._shared import clear, own_tables, stash, table
from lumenframe.llm.decontaminate import drop_contaminated
from lumenframe.llm.langid import reject_unknown_language
from lumenframe.llm.lines import drop_repeated_lines
from lumenframe.llm.mixing import emit_mix
from lumenframe.llm.simhash import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with some confidence stay. A null text, or one without a letter, goes; nulls in
    other columns don't matter (a row without doc_id or lang is not learned from). Repeated rows share their fate."""
    return reject_unknown_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, but for one word edit, go, and documents that lose all their words so. Null and
    wordless texts stay as they are; a null doc_id comes last; rows of one doc_id don't dedupe each other's equal line
    numbers. n_chars follows the text."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays: that of the
    smallest doc_id (null last); of repeated rows one. Null and wordless texts are one group."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go. A null text has no words and stays."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document that is left as often as it is taken, its number in ``copy``; those that are not taken go.
    Null or wordless text: nothing to take; null source: a source of its own; repeated rows: drawn each."""
    return emit_mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: A trained network and fingerprints are beyond SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all stages over documents. A stage's tables go once its result is written, and that once the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        step = own_tables()
        docs = stash(stage(spark, docs, sf_dir), replaces=docs)
        clear(spark, step, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
