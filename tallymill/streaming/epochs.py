"""Epoch reading over a stream: files are read again, epoch after epoch, until every worker has its target.

The stream's source hands out *tickets* (epoch, file), never rows: its offset is the next ticket, so a restart goes on
where the checkpoint stands. A micro-batch opens just the files of its tickets with Spark's own reader, cuts what
exceeds a worker's target, and numbers each worker's rows on from a small table of what the workers have so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from tallymill.plans.indexing import by_number, indexed
from tallymill.streaming.tables import read_version, run_batches, write_batch

SOURCE = "tallymill_tickets"


class TicketReader(SimpleDataSourceStreamReader):
    """Tickets in order of epoch and file number, ``step`` per micro-batch; the offset is the next ticket."""

    def __init__(self, options: dict):
        self.files, self.epochs, self.step = int(options["files"]), int(options["epochs"]), int(options.get("step", "1"))

    def initialOffset(self) -> dict:
        return {"epoch": 0, "file": 0}

    def _place(self, offset: dict) -> int:
        return offset["epoch"] * self.files + offset["file"]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        stop = min(self._place(start) + self.step, self.files * self.epochs)
        end = {"epoch": stop // self.files, "file": stop % self.files} if self.files else start
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(place // self.files, place % self.files) for place in range(self._place(start), self._place(end))])


class Tickets(DataSource):
    """Streaming source of (epoch, file) for ``files`` files over ``epochs`` epochs."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return "epoch long, file long"

    def simpleStreamReader(self, schema) -> TicketReader:
        return TicketReader(self.options)


def epochs_needed(shares: DataFrame, workers: int, target: int) -> int:
    """Epochs after which the worker with the fewest rows has ``target``; ``shares`` is (file, rows). Workers without rows get none."""
    per_worker = shares.where("rows > 0").groupBy(F.col("file") % workers).agg(F.sum("rows").alias("rows"))
    least = per_worker.agg(F.min("rows")).first()[0]
    return math.ceil(target / least) if least else 0


def repeated_files(
    spark: SparkSession, files: DataFrame, root: str, key: str, workers: int, target: int, files_per_batch: int = 1, stop_after: int | None = None,
) -> StreamingQuery:
    """Deals files to workers (file number modulo ``workers``) and reads them, in rounds, until each worker has ``target`` rows.

    ``files`` is (file, path, rows), numbered from 0; a file's rows go in order
    of ``key``. Below ``root``/read are the rows with ``worker``, ``seq`` (the
    worker's count from 0), ``epoch`` and ``file``. A batch that runs again
    replaces its folder. ``stop_after`` bounds the epochs of this run alone.
    """
    epochs = epochs_needed(files, workers, target)
    spark.dataSource.register(Tickets)
    tickets = spark.readStream.format(SOURCE).option("files", files.count()).option("step", files_per_batch).option(
        "epochs", epochs if stop_after is None else min(epochs, stop_after)).load()

    def process(batch: DataFrame, batch_id: int):
        used = read_version(spark, f"{root}/used", batch_id)
        # At most ``files_per_batch`` tickets.
        wanted = batch.withColumn("worker", (F.col("file") % workers).cast("int"))
        if used is not None:
            wanted = wanted.join(used, "worker", "left").where(F.coalesce("given", F.lit(0)) < target).drop("given")
        opened = wanted.join(files.select("file", "path"), "file").collect()
        rows = None
        for t in opened:
            part = spark.read.parquet(t["path"]).withColumns(
                {"worker": F.lit(t["worker"]), "epoch": F.lit(t["epoch"]), "file": F.lit(t["file"])})
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return
        order = by_number(F.col("epoch"), F.col("file"), F.col(key))
        placed = indexed(rows, ["worker"], order, "seq")
        if used is not None:
            placed = placed.join(used, "worker", "left").withColumn("seq", F.col("seq") + F.coalesce("given", F.lit(0))).drop("given")
        write_batch(placed.where(F.col("seq") < target), f"{root}/read", batch_id)
        new = spark.read.parquet(f"{root}/read/batch_id={batch_id}").groupBy("worker").agg(F.count(F.lit(1)).alias("given"))
        both = new if used is None else new.unionByName(used).groupBy("worker").agg(F.sum("given").alias("given"))
        write_batch(both, f"{root}/used", batch_id)

    return run_batches(tickets, process, f"{root}/checkpoint", available_now=False)


def finish(query: StreamingQuery) -> None:
    """Waits until the tickets at hand are used up, then stops the query; its offsets stay in the checkpoint."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
