"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.session import scratch_path

# White space that separates words: U+0020 and U+0009 to U+000D (fixed values).
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t-\\r]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# Whether Spark deletes the shuffle files of a query at its end, in place of whenever the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: ContextVar[list[str]] = ContextVar("passing")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there and survives lost executors. The shuffle files
    of the write go with its end."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _passing.get([]).append(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_alone(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` returns, ``kept``. The tables kept while it ran go once that is written: it must hand out nothing else that
    reads them."""
    outer = _passing.set([])
    try:
        df, passed = build(), _passing.get()
    finally:
        _passing.reset(outer)
    out = kept(df, name)
    for path in passed:
        handle = out.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        handle.getFileSystem(out.sparkSession._jsc.hadoopConfiguration()).delete(handle, True)
    return out


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once, even where ``body`` uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words between ``SPACES``; no word for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN, -1), "")


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` minus columns that an operator is about to add (names compare without case, as Spark's do)."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
