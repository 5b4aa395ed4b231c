"""Finding a value in run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymill.plans.indexing import by_number, first_n


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Whole log files with name (file stem), modification time and content."""
    return spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("name"),
        F.unix_micros("modificationTime").alias("mtime"), "path", F.col("content").cast("string").alias("content"),
    )


def extract_from_logs(logs: DataFrame, patterns: Sequence[str], limit: int | None = None) -> DataFrame:
    """Per name, capture 1 of the newest log in which any pattern matches.

    ``logs`` has name, mtime, path and content; patterns are tried in order,
    and only the newest ``limit`` logs of a name are searched. The content is
    reduced to the capture before anything is shuffled.
    """
    found = F.lit(None).cast("string")
    for pattern in reversed(list(patterns)):
        found = F.when(F.col("content").rlike(pattern), F.regexp_extract("content", pattern, 1)).otherwise(found)
    slim = logs.select("name", "mtime", "path", found.alias("found"))
    if limit is not None:
        slim = first_n(slim, ["name"], by_number(F.col("mtime"), F.col("path"), descending=True), limit)
    newest = F.struct("mtime", "path")
    return slim.groupBy("name").agg(
        F.count(F.lit(1)).alias("searched"), F.max_by("found", F.when(F.col("found").isNotNull(), newest)).alias("value"))
