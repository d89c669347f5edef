"""What the corpus operators share: words, written tables, checked broadcasts and running totals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which the smaller side of a join is sent to every executor.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A temporary folder of this machine takes its place only where the setting is missing and the
    session runs on one machine (tests); on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


#: For each scratch that is open, the paths of the tables that were written inside.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are removed at its end, so that a run takes the room of one step and not of all of them.
    What is read later must be written inside with ``stays``: it belongs to what is around. Spark removes shuffled files when
    the driver has collected what refers to them, so it is asked to."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        spark._jvm.System.gc()


def written(df: DataFrame, label: str = "table", stays: bool = False) -> DataFrame:
    """df, computed once and kept as a Parquet table in the shared folder: lineage ends there, and
    a lost executor costs only the reading of files again. ``stays``: see scratch."""
    path = f"{shared_dir(df.sparkSession)}/tracklens/{label}-{uuid.uuid4().hex}"
    if len(_SCRATCH) > stays:
        _SCRATCH[-1 - stays].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(df: DataFrame, other: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """df joined with a table that is usually small: broadcast if it is counted at up to ``limit``
    rows, else joined by shuffle. ``other`` should be a written table, as it is counted first."""
    return df.join(F.broadcast(other) if other.limit(limit + 1).count() <= limit else other, on, how)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, with as many underscores before each as no column of ``df`` begins with: columns to work with that clash with none."""
    most = max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0)
    return [f"{'_' * (most + 1)}{name}" for name in names]


def word_count(text: Column) -> Column:
    """Number of words (null: 0), inside the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text (null is a text of its own)."""
    return [F.xxhash64(text).alias("key1"), F.xxhash64(F.lit("tracklens"), text).alias("key2")]


def running_total(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same ``keys`` up to and with this one.

    Rows are ordered by (bucket, order); ``bucket`` cuts a key's rows into ordered ranges, so that
    no task sorts more than one range, however large the key. The sums of the ranges, one row for
    each, are added up first. df is read twice: give a written table.
    """
    keys = list(keys)
    by = [*keys, bucket]
    sums = df.groupBy(*by).agg(F.sum(value).alias("_sum"))
    ranges = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.coalesce(F.sum("_sum").over(ranges), F.lit(0)).alias("_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return join_small(df, written(before, "ranges"), same).withColumn(name, F.col("_before") + F.sum(value).over(inside)).drop("_before", *[f"_{c}" for c in by])
