"""Small pieces shared by the streaming jobs: versioned state, batch outputs and sources.

Every write is a folder named by the micro-batch id and replaces that folder,
so a batch that runs again after a failure leaves the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"


def _ids(spark: SparkSession, root: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BATCH}="))


def write_batch(df: DataFrame, root: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{BATCH}={batch}")


def read_between(spark: SparkSession, root: str, after: int | None = None, last: int | None = None) -> DataFrame | None:
    """Output of the batches after ``after`` up to and including ``last``, with its batch id; open ends if ``None``."""
    ids = [i for i in _ids(spark, root) if (after is None or i > after) and (last is None or i <= last)]
    if not ids:
        return None
    return spark.read.option("basePath", root).parquet(*[f"{root}/{BATCH}={i}" for i in ids])


def newest_id(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """The newest batch id below ``root``, or the newest one older than ``before``."""
    ids = [i for i in _ids(spark, root) if before is None or i < before]
    return ids[-1] if ids else None


def read_version(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The newest state version, or the newest one older than ``before``."""
    ids = [i for i in _ids(spark, root) if before is None or i < before]
    return spark.read.parquet(f"{root}/{BATCH}={ids[-1]}") if ids else None


def latest_by_key(log: DataFrame, keys) -> DataFrame:
    """Current rows of an update log: per key the row of the newest batch."""
    values = [c for c in log.columns if c not in {*keys, BATCH}]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("_v"))
    return newest.select(*keys, "_v.*")


def parquet_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_batches(stream: DataFrame, process, checkpoint: str, mode: str = "append", available_now: bool = True, keep: bool = True) -> StreamingQuery:
    """Starts ``process(df, batch_id)`` over the stream; with ``available_now`` it ends with the input at hand.

    ``keep`` holds the micro-batch while it is processed, for jobs that look at it more than once.
    """

    def kept(batch: DataFrame, batch_id: int):
        if not keep:
            process(batch, batch_id)
            return
        batch.persist()
        try:
            process(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(kept)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def drain(query: StreamingQuery) -> None:
    query.awaitTermination()
