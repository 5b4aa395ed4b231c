"""Shard inventories: completeness and selection."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

SHARD_NAME = r"^(?:(.*)/)?([^/]+)-([0-9]{5})-of-([0-9]{5})\.[A-Za-z0-9]+$"


def parse_shards(files: DataFrame, path: str = "path") -> DataFrame:
    """Rows named ``prefix-IIIII-of-NNNNN.ext`` with dir, prefix, shard and total."""
    part = lambda i: F.regexp_extract(path, SHARD_NAME, i)
    return files.where(F.col(path).rlike(SHARD_NAME)).withColumns(
        {"dir": part(1), "prefix": part(2), "shard": part(3).cast("int"), "total": part(4).cast("int")})


def shard_completeness(files: DataFrame, path: str = "path") -> DataFrame:
    """One row per (dir, prefix, total): counts of missing, duplicate and out-of-range indexes, and the status.

    Indexes are first reduced to one row per (group, index), so a group's copies
    never meet in one task; which indexes are missing is a separate
    anti join, :func:`missing_shards`.
    """
    group = ["dir", "prefix", "total"]
    per_index = parse_shards(files, path).groupBy(*group, "shard").agg(F.count(F.lit(1)).alias("copies"))
    inside = F.col("shard") < F.col("total")
    counts = per_index.groupBy(*group).agg(
        F.sum("copies").alias("files"), (F.col("total") - F.count_if(inside)).alias("missing"),
        F.count_if(F.col("copies") > 1).alias("duplicates"), F.count_if(~inside).alias("out_of_range"))
    clean = (F.col("missing") == 0) & (F.col("duplicates") == 0) & (F.col("out_of_range") == 0)
    return counts.withColumn("complete", clean)


def missing_shards(files: DataFrame, path: str = "path") -> DataFrame:
    """The missing indexes of every group, one row each."""
    group = ["dir", "prefix", "total"]
    present = parse_shards(files, path).select(*group, "shard").distinct()
    wanted = present.select(*group).distinct().withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("total") - 1)))
    return wanted.join(present, [*group, "shard"], "left_anti")


def the_complete_group(files: DataFrame, path: str = "path") -> tuple[str, str, int]:
    """The only complete group; none or several is an error."""
    found = shard_completeness(files, path).where("complete").select("dir", "prefix", "total").limit(2).collect()
    if len(found) != 1:
        raise ValueError("no complete shard group" if not found else "several complete shard groups")
    return tuple(found[0])


def select_split(shards: DataFrame, spec: str, split: str = "split", shard: str = "shard", length: str = "shard_length") -> tuple[DataFrame, DataFrame]:
    """The shards a split spec names and a one-row table with their sample count.

    ``train`` takes a whole split (an unknown name is an error), ``train-{3..7}``
    a range of its shards, also written as a file pattern
    ``data-train-{0003..0007}.tar``; ``…|500`` fixes the sample count. The range
    becomes a predicate on the shard number, so a later read touches only those files.
    """
    text, _, count = spec.partition("|")
    match = re.fullmatch(r"(.*?)-?\{(\d+)\.\.(\d+)\}(?:\.\w+)*", text)
    if match:
        prefix, low, high = match.group(1), int(match.group(2)), int(match.group(3))
        chosen = shards.where(F.col(shard).between(low, high))
        if prefix:
            chosen = chosen.where(F.col(split).isin(prefix, prefix.rsplit("-", 1)[-1]))
    else:
        chosen = shards.where(F.col(split) == text)
        if chosen.limit(1).count() == 0:
            raise ValueError(f"unknown split {text!r}")
    samples = F.lit(int(count)) if count else F.sum(length)
    return chosen, chosen.agg(F.count(F.lit(1)).alias("shards"), samples.cast("bigint").alias("num_samples"))
