"""Tables and splits that appear whole or not at all.

Data goes to a folder of its own per commit, and one small pointer file names what counts. A commit writes its folder,
then replaces the pointer by a rename, which the file system does at once: a reader sees the old state or the new one,
and a commit that stops anywhere leaves at most a folder that nobody reads. Folders that two commits have left behind
are removed by the next one, so a reader that began before a commit can finish.

Splits share one pointer. It names an index, a table of (split, version) that Spark derives from the last one, so any
number of splits changes in one step and no list of them passes through the driver.

Layout: ``<root>/_current`` (text), ``<root>/data/<version>``, ``<root>/index/<version>``. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

POINTER = "_current"
KEPT = 2


def _files(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    return handle, handle.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> list[str]:
    """Versions by commit, the one that counts first; empty before the first commit."""
    handle, fs = _files(spark, f"{root}/{POINTER}")
    if not fs.exists(handle):
        return []
    stream = fs.open(handle)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
    finally:
        stream.close()


def _point(spark: SparkSession, root: str, versions: list[str]) -> None:
    """Replaces the pointer in one rename."""
    target, fs = _files(spark, f"{root}/{POINTER}")
    draft, _ = _files(spark, f"{root}/{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray("\n".join(versions), "utf-8"))
    finally:
        out.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)


def _remove(spark: SparkSession, folder: str, keep: set[str]) -> None:
    """Removes the version folders that nothing names any more."""
    handle, fs = _files(spark, folder)
    if fs.exists(handle):
        for entry in fs.listStatus(handle):
            if entry.getPath().getName() not in keep:
                fs.delete(entry.getPath(), True)


def _write(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = None) -> None:
    writer = df.write.format(fmt)
    (writer.partitionBy(by) if by else writer).save(path)


def commit_table(df: DataFrame, root: str, fmt: str = "parquet") -> str:
    """Makes ``df`` the content of the table below ``root`` (``df`` may read that table) and returns its version."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    past = current(spark, root)
    _write(df, f"{root}/data/{version}", fmt)
    _point(spark, root, [version, *past[:KEPT - 1]])
    _remove(spark, f"{root}/data", {version, *past[:KEPT - 1]})
    return version


def read_table(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame | None:
    """The committed table, or None before the first commit."""
    versions = current(spark, root)
    return spark.read.format(fmt).load(f"{root}/data/{versions[0]}") if versions else None


def _index(spark: SparkSession, root: str, versions: list[str]) -> DataFrame | None:
    return spark.read.parquet(f"{root}/index/{versions[0]}") if versions else None


def commit_splits(df: DataFrame, root: str, split: str | Column = "split", force: bool = False) -> str:
    """Writes the splits that ``df`` has, all in one step. A split that exists is an error unless ``force``, which replaces it."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df = df.withColumn("split", split) if isinstance(split, Column) else df.withColumnRenamed(split, "split")
    past = current(spark, root)
    index = _index(spark, root, past)
    if index is not None and not force:
        taken = index.join(df.select("split").distinct(), "split", "left_semi").select("split").orderBy("split").limit(20).collect()
        if taken:
            raise FileExistsError(f"splits already written: {[r['split'] for r in taken]}")
    _write(df, f"{root}/data/{version}", by="split")
    # A folder per split was written; its names are the new part of the index.
    new = spark.read.schema(df.schema).parquet(f"{root}/data/{version}").select(F.col("split").cast("string")).distinct().withColumn("version", F.lit(version))
    whole = new if index is None else index.join(new, "split", "left_anti").unionByName(new)
    _write(whole, f"{root}/index/{version}")
    _point(spark, root, [version, *past[:KEPT - 1]])
    used = {r["version"] for v in (version, *past[:KEPT - 1]) for r in spark.read.parquet(f"{root}/index/{v}").select("version").distinct().collect()}
    _remove(spark, f"{root}/data", used)
    _remove(spark, f"{root}/index", {version, *past[:KEPT - 1]})
    return version


def read_splits(spark: SparkSession, root: str) -> DataFrame | None:
    """All committed splits with their ``split`` column, or None before the first commit."""
    index, out = _index(spark, root, current(spark, root)), None
    if index is None:
        return None
    # One entry per commit that still holds a split, not per split.
    for row in index.select("version").distinct().collect():
        data = spark.read.parquet(f"{root}/data/{row['version']}").withColumn("split", F.col("split").cast("string"))
        part = data.join(index.where(F.col("version") == row["version"]), "split", "left_semi")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
