"""Shared folder, salted joins and other plumbing of the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


#: Spark's own limit (spark.sql.sources.bucketing.maxBuckets).
MOST_BUCKETS = 100_000
#: Rows of an Arrow batch where whole texts go to Python: JVM and worker each hold a batch of them.
TEXT_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode one of our own where it is unset."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None)
    if at is None:
        at = sc.getCheckpointDir()
    if at is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


class Tables(list):
    """The paths of tables that one step of a query wrote; ``outer``: those of the step that it is part of."""

    outer: Tables | None = None


#: All tables that are left, and those of the step that this thread is in: queries in other threads have their own.
_WRITTEN: list[str] = []
_STEP: ContextVar[Tables | None] = ContextVar("lumenframe_step", default=None)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> bool:
    spark.sql(f"DROP TABLE IF EXISTS {path.rpartition('/')[2]}")
    files, at = _at(spark, path)
    return bool(files.delete(at, True))


def forget(spark: SparkSession) -> int:
    """Deletes what stash wrote for results that are no longer needed; how many tables that were."""
    n = 0
    while _WRITTEN:
        n += _delete(spark, _WRITTEN.pop())
    _STEP.set(None)
    return n


#: Settings that writes of this library hold just now: how many writes, and the values before the first one.
_HELD: dict[str, list] = {}
_HOLDING = Lock()


@contextmanager
def _setting(spark: SparkSession, key: str, value):
    """The session's setting while a table is written, the former one afterwards; writes of other threads share it."""
    with _HOLDING:
        held = _HELD.setdefault(key, [0, spark.conf.get(key, None)])
        held[0] += 1
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        with _HOLDING:
            held[0] -= 1
            if not held[0]:
                del _HELD[key]
                if held[1] is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, held[1])


def stash_texts(df: DataFrame) -> DataFrame:
    """stash of what Python makes of whole texts: they go to it by TEXT_ROWS rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    with _setting(df.sparkSession, key, min(now, TEXT_ROWS) if now > 0 else TEXT_ROWS):
        return stash(df)


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Python TEXT_ROWS rows at most: for results of Python that the caller writes, when
    stash_texts can't hold the setting. A lower one stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def stash(df: DataFrame, replaces: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages start from files, not from lineage.

    replaces: an earlier stash that nothing needs once this one is written; it is deleted. by: the table is bucketed by
    this column, as many buckets as the session has shuffle partitions, so that joins on it don't shuffle the table; a
    task should hold few of its values, as each may be a file.
    The table stays until the driver ends or forget() is called.
    """
    spark = df.sparkSession
    name = f"stash_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    if by:
        n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
        df.write.bucketBy(n, by).option("path", path).saveAsTable(name)
        out = spark.table(name)
    else:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    files, at = _at(spark, path)
    files.deleteOnExit(at)
    _WRITTEN.append(path)
    if _STEP.get() is not None:
        _STEP.get().append(path)
    out._stashed = path
    if replaces is not None and getattr(replaces, "_stashed", None) in _WRITTEN:
        _WRITTEN.remove(replaces._stashed)
        _delete(spark, replaces._stashed)
    return out


def placed(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder with two more columns: _part, the task that wrote a row, and _at, the row's number.

    One file a task, bucketed by _part: what is found out about rows later comes to them (answered), so that their texts
    are not shuffled. Numbers are stored, so that they don't change if a task runs again. Equal rows have numbers of their own.
    All rows of a task are of one bucket: with a writer open for it, Spark doesn't sort whole texts by bucket first.
    """
    with _setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", 1):
        return stash(df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), by="_part")


def answered(rows: DataFrame, answers: DataFrame, column: str) -> DataFrame:
    """rows (all rows of a table of placed(), any of its columns) with ``column`` of answers (one row an _at), or null.

    Only _at and the answers are shuffled. The answers of a part are one list in the order of its rows, as long as one
    task's file has rows, and a row takes its own by its number in the file.
    """
    each = skew_join(rows.select("_part", "_at"), answers.select("_at", column), "_at")
    lists = each.groupBy("_part").agg(F.array_sort(F.collect_list(F.struct("_at", column))).alias("_answers"))
    own = F.get("_answers", F.col("_at").bitwiseAND(F.lit(2**33 - 1)).cast("int"))
    return rows.join(lists.hint("shuffle_hash"), "_part").withColumn(column, own[column]).drop("_answers")


def own_tables() -> Tables:
    """From now on the tables that this thread writes belong to a step of their own, until clear()."""
    step = Tables()
    step.outer = _STEP.get()
    _STEP.set(step)
    return step


def clear(spark: SparkSession, step: Tables, *but: DataFrame) -> None:
    """Ends the step and deletes its tables but for these, which the step around it gets; no other query's."""
    kept = {getattr(df, "_stashed", None) for df in but}
    for path in step:
        if path in kept:
            if step.outer is not None:
                step.outer.append(path)
        elif path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(spark, path)
    _STEP.set(step.outer)


def quoted(column: str) -> str:
    """A column's name as Spark parses it, whatever is in it."""
    return "`" + column.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: str, salts: int = 16, how: str = "left") -> DataFrame:
    """Join ``big`` to ``small`` (one row a key) on ``key``; a hot key of ``big`` is dealt over ``salts`` tasks by ``spread``."""
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [key, "_salt"], how).drop("_salt")


def skew_join(big: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join by a sort-merge join: both sides may grow with the data, and Spark deals a hot key's partition over tasks."""
    return big.join(small.hint("merge"), on, how)


def aside(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _others): all other columns of docs as one struct, so that their names can't clash.

    Any names do: with spaces, dots or quotes, or those that an operator uses itself.
    """
    others = [F.col(quoted(c)) for c in docs.columns if c != "text"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*others).alias("_others"))


def restored(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that were put aside, with the present text."""
    return df.select(*[F.col("text") if c == "text" else F.col("_others").getField(c).alias(c) for c in columns])


def with_fields(schema: str, df: DataFrame, carry: tuple, last: str = "") -> StructType:
    """The schema ``schema``, then the columns ``carry`` of df as they are, then ``last``."""
    head, tail = (StructType.fromDDL(x) if x else StructType() for x in (schema, last))
    return StructType([*head.fields, *[StructField(c, df.schema[c].dataType) for c in carry], *tail.fields])
