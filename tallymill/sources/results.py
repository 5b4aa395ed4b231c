"""Result tables as CSV: reading, resuming, upserting, writing predictions and splits."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import batched

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymill.missing import blank_to_null
from tallymill.session import scratch_path

# The identity columns of a result file.
IDENTITY = ("name", "run_dir", "checkpoint")
TRAILING = ("eval_time_s", "error")


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows, columns matched by name, absent ones NULL, first-seen column order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def load_results(spark: SparkSession, paths: Sequence[str], schema=None, blanks_are_null: bool = True) -> DataFrame:
    """Result CSVs united by column name, each row tagged with its file in ``_source_csv``; nothing is deduplicated.

    Files (or globs) are read one scan per distinct header, not one per file.
    Only the first line of each file is looked at on the driver side, through a
    distributed text scan.
    """
    if not paths:
        raise ValueError("no result files given")
    # A header is the line with the smallest offset: CSV files start with it.
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value"),
        F.monotonically_increasing_id().alias("line"))
    # The metadata column has the path encoded; the reader takes it plain ("+" stands for itself there).
    plain = F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))
    heads = lines.where("at = 0").groupBy(plain.alias("file")).agg(F.min_by("value", "line").alias("header"))
    groups = heads.groupBy("header").agg(F.collect_list("file").alias("files")).orderBy("header").collect()
    frames = []
    for group in groups:
        reader = spark.read.option("header", True)
        reader = reader.schema(_subset(schema, group["header"])) if schema else reader
        frame = reader.csv(sorted(group["files"])).withColumn("_source_csv", F.col("_metadata.file_path"))
        frames.append(frame)
    out = union_by_name(frames)
    if blanks_are_null:
        texts = [f.name for f in out.schema if f.dataType.simpleString() == "string"]
        out = out.withColumns({c: blank_to_null(out[f"`{c}`"]) for c in texts})
    return out


def _subset(schema, header: str):
    from pyspark.sql.types import StringType, StructField, StructType

    known = {f.name: f for f in schema}
    names = [n.strip() for n in next(csv.reader([header]))]
    return StructType([known.get(n, StructField(n, StringType())) for n in names])


def metric_columns(frame: DataFrame, args: Sequence[str]) -> list[str]:
    fixed = {*IDENTITY, *args, *TRAILING, "_source_csv"}
    return sorted(c for c in frame.columns if c not in fixed)


def upsert_results(existing: DataFrame, new: DataFrame, errors: DataFrame, mapping: DataFrame, args: Sequence[str] = ()) -> DataFrame:
    """Existing rows whose name is in neither ``new`` nor ``errors``, then the new rows, then one row per failure.

    ``errors`` is (name, error), ``mapping`` is (name, run_dir). Columns:
    identity, args, sorted union of the metrics, time and error.
    """
    touched = new.select("name").union(errors.select("name")).distinct()
    kept = existing.join(touched, "name", "left_anti")
    failed = errors.select("name", "error").join(mapping.select("name", "run_dir"), "name", "left")
    out = union_by_name([kept, new, failed])
    metrics = metric_columns(out, args)
    absent = [c for c in (*IDENTITY, *args, *TRAILING) if c not in out.columns]
    out = out.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else out
    return out.select(*[f"`{c}`" for c in (*IDENTITY, *args, *metrics, *TRAILING)])


def done_names(results: DataFrame) -> DataFrame:
    """Names with a finished row: not blank, and no error (files without an error column: every named row)."""
    keep = F.coalesce(F.trim("name"), F.lit("")) != ""
    if "error" in results.columns:
        keep = keep & (F.coalesce(F.trim("error"), F.lit("")) == "")
    return results.where(keep).select("name")


def pending(mapping: DataFrame, results: Sequence[DataFrame], skip_names: Sequence[str] = ()) -> DataFrame:
    """Rows of ``mapping`` that still need work."""
    out = mapping.where(~F.col("name").isin(list(skip_names))) if skip_names else mapping
    if not results:
        return out
    done = reduce(lambda a, b: a.union(b), [done_names(r) for r in results])
    return out.join(done, "name", "left_anti")


def existing_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The given paths that exist; the others are ignored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        handle = jvm.org.apache.hadoop.fs.Path(path)
        if handle.getFileSystem(conf).exists(handle):
            out.append(path)
    return out


def replace_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrites ``path`` with a result that may itself read ``path``: staged first, then swapped in."""
    spark = df.sparkSession
    staged = scratch_path(spark, "stage")
    df.write.format("parquet").save(staged)
    writer = spark.read.parquet(staged).write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def separate_columns(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Array columns as ``col_0 … col_{k-1}``; an array of length 1 keeps its column name."""
    out = []
    for c in df.columns:
        k = sizes.get(c)
        if k is None:
            out.append(F.col(f"`{c}`"))
        elif k == 1:
            out.append(F.get(c, 0).alias(c))
        else:
            out += [F.get(c, i).alias(f"{c}_{i}") for i in range(k)]
    return df.select(*out)


def write_predictions(df: DataFrame, path: str, fmt: str, sizes: dict[str, int] | None = None, mode: str = "errorifexists") -> None:
    """Prediction rows as ``csv``, ``parquet`` or ``json``. With ``sizes`` arrays become separate columns,
    otherwise CSV stores an array as its JSON text."""
    if fmt not in ("csv", "parquet", "json"):
        raise ValueError(f"unknown format {fmt!r}")
    if sizes:
        df = separate_columns(df, sizes)
    if fmt == "csv":
        arrays = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
        df = df.withColumns({c: F.to_json(c) for c in arrays}) if arrays else df
        df.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def write_split(df: DataFrame, root: str, split: str | Column = "split", force: bool = False) -> None:
    """One directory per split. Existing splits are an error unless ``force``, which replaces only the splits written."""
    spark = df.sparkSession
    if isinstance(split, Column):
        df = df.withColumn("split", split)
    elif split != "split":
        df = df.withColumnRenamed(split, "split")
    if not force:
        # Any number of splits, a bounded number of names at a time.
        for names in batched((r["split"] for r in df.select("split").distinct().toLocalIterator()), 10_000):
            taken = existing_files(spark, [f"{root.rstrip('/')}/split={s}" for s in names])
            if taken:
                raise FileExistsError(f"splits already written: {taken}")
    writer = df.write.partitionBy("split").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(root)
