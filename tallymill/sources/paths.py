"""Labels from paths and dense class indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymill.plans.indexing import Running, by_number, running

IMAGE_EXTENSIONS = ("png", "jpg", "jpeg")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of every file below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/") + "/"
    relative = F.regexp_replace("path", "^.*?" + _quoted(prefix), "")
    return files.select(relative.alias("path"), F.col("length").alias("size"))


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def label_from_path(path: Column, leaf_only: bool = True) -> Column:
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.regexp_extract(folder, r"([^/]*)$", 1) if leaf_only else F.translate(folder, "/", "_")


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions])


def path_label_index(files: DataFrame, extensions: Sequence[str] = IMAGE_EXTENSIONS, leaf_only: bool = True, path: str = "path") -> DataFrame:
    """Files with an allowed extension and the label taken from their folder."""
    return files.where(has_extension(F.col(path), extensions)).withColumn("label", label_from_path(F.col(path), leaf_only))


def natural_key(text: Column) -> Column:
    """Sort key in which digit runs of any length compare as numbers: lower case, each run behind its number of digits
    (six places), without leading zeros."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    padded = F.transform(parts, lambda p: F.when(
        p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 6, "0"), digits(p))).otherwise(p))
    return F.array_join(padded, "")


def class_map(df: DataFrame, label: str) -> DataFrame:
    """(label, idx): the distinct labels in natural order, numbered from 0."""
    labels = df.select(F.col(label).alias("label")).where("label IS NOT NULL").distinct().withColumn("_key", natural_key(F.col("label")))
    # Distinct labels are metadata, but can be many: numbered through the cell plan.
    out = running(labels, [], by_number(F.col("_key"), F.col("label")), {"idx": Running("index")})
    return out.select("label", (F.col("idx") - 1).cast("int").alias("idx"))


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """A ``.txt`` class map: line number is the index. One small file, read whole by one task."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\n")).alias("idx", "label"))
    return lines.select(F.trim("label").alias("label"), "idx")


def apply_class_map(df: DataFrame, mapping: DataFrame, label: str) -> DataFrame:
    """Adds ``idx``; rows whose label is not in the map are dropped."""
    return df.join(mapping.select(F.col("label").alias("_l"), "idx"), F.col(label) == F.col("_l")).drop("_l")


def dropped_count(df: DataFrame, mapping: DataFrame, label: str) -> DataFrame:
    """How many rows :func:`apply_class_map` drops, per unknown label."""
    missing = df.join(mapping.select(F.col("label").alias("_l")), F.col(label) == F.col("_l"), "left_anti")
    return missing.groupBy(label).agg(F.count(F.lit(1)).alias("dropped"))
