"""Capped sampling, grouping by four and epoch reading over a stream.

State that crosses micro-batches is a table (counts accepted so far, at most
three waiting rows per key), and each batch is an ordinary distributed plan, so
a hot label never becomes one task's state.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.operators.mixing import four_groups
from tallymill.plans.indexing import by_number, first_n, indexed
from tallymill.plans.sizing import join_null_safe
from tallymill.streaming.tables import read_between, read_version, run_batches, write_batch


def capped_stream(stream: DataFrame, root: str, label: str, key: str, cap: int, total: int | None = None, fits: Column | None = None, available_now: bool = True):
    """Accepts rows as they arrive: at most ``cap`` per label and ``total`` overall. Accepted rows are below ``root``/accepted."""
    spark = stream.sparkSession

    def process(batch: DataFrame, batch_id: int):
        rows = batch.where(fits) if fits is not None else batch
        # One row per label: the state stays small however many rows were accepted.
        used = read_version(spark, f"{root}/used", batch_id)
        left = total
        rows = rows.withColumn("_room", F.lit(cap))
        if used is not None:
            rows = join_null_safe(rows, used, [label])
            rows = rows.withColumn("_room", F.lit(cap) - F.coalesce("_used", F.lit(0))).drop("_used").where("_room > 0")
            left = None if total is None else max(0, total - (used.agg(F.sum("_used")).first()[0] or 0))
        kept = first_n(rows, [label], by_number(F.col(key)), F.col("_room")).drop("_room")
        if left is not None:
            kept = first_n(kept, [], by_number(F.col(key)), left)
        write_batch(kept, f"{root}/accepted", batch_id)
        new = spark.read.parquet(f"{root}/accepted/batch_id={batch_id}").groupBy(label).agg(F.count(F.lit(1)).alias("_used"))
        both = new if used is None else new.unionByName(used).groupBy(label).agg(F.sum("_used").alias("_used"))
        write_batch(both, f"{root}/used", batch_id)

    return run_batches(stream, process, f"{root}/checkpoint", available_now=available_now)


BATCH_GROUPS = 1 << 40


def four_group_stream(stream: DataFrame, root: str, keys: Sequence[str], key: str, label: str, prob: float, seed: int, epoch: int, available_now: bool = True, **layout):
    """Groups of four per key over micro-batches; incomplete groups wait below ``root``/waiting for later rows.

    ``group`` counts within a batch, above the batch id times ``BATCH_GROUPS``, so that a key's ids don't repeat.
    """
    spark = stream.sparkSession
    keys = list(keys)

    def process(batch: DataFrame, batch_id: int):
        rows = batch.select(*keys, key, label)
        waiting = read_version(spark, f"{root}/waiting", batch_id)
        if waiting is not None:
            rows = rows.unionByName(waiting)
        out = four_groups(rows, keys, key, label, prob, seed, epoch, flush=False, **layout)
        out = out.withColumn("group", F.col("group") + F.lit(batch_id * BATCH_GROUPS))
        write_batch(out, f"{root}/all", batch_id)
        stored = spark.read.parquet(f"{root}/all/batch_id={batch_id}")
        write_batch(stored.where("weights IS NOT NULL"), f"{root}/groups", batch_id)
        waits = stored.where("weights IS NULL").select(*keys, F.get("members", 0).alias(key), F.get("labels", 0).alias(label))
        write_batch(waits, f"{root}/waiting", batch_id)

    return run_batches(stream, process, f"{root}/checkpoint", available_now=available_now)


def flushed_groups(spark, root: str, keys: Sequence[str], key: str, label: str) -> DataFrame:
    """All groups so far plus the waiting rows as single-label targets: the result at the end of the input."""
    groups = read_between(spark, f"{root}/groups").drop("batch_id")
    waiting = read_version(spark, f"{root}/waiting")
    y = F.col(label)
    lone = waiting.select(
        *keys, F.lit(None).cast("bigint").alias("group"), F.array(key).alias("members"), F.array(y, y, y, y).alias("labels"), F.array(*[F.lit(w) for w in (1.0, 0.0, 0.0, 0.0)]).alias("weights"))
    return groups.unionByName(lone)


def worker_target(rows: int, workers: int, repeats: float = 1, batch: int | None = None, training: bool = True) -> int:
    """Samples each worker reads per epoch: its share rounded up, then up to whole batches when training."""
    share = max(1, repeats) * rows / workers
    if training or workers > 1:
        share = math.ceil(share)
    if training and batch:
        share = math.ceil(share / batch) * batch
    return int(share)


def epoch_rows(df: DataFrame, key: str, workers: int, target: int) -> DataFrame:
    """Rows dealt to workers in key order, each worker's share repeated until it has ``target`` rows: (worker, seq, key)."""
    dealt = indexed(df.select(key), [], by_number(F.col(key)), "_g").select(
        key, (F.col("_g") % workers).cast("int").alias("worker"), F.floor(F.col("_g") / workers).alias("_i"))
    share = dealt.groupBy("worker").agg(F.count(F.lit(1)).alias("_m"))
    rounds = dealt.join(share, "worker").where(F.col("_i") < target)
    return rounds.withColumn("seq", F.explode(F.sequence(F.col("_i"), F.lit(target - 1).cast("bigint"), F.col("_m")))).select("worker", "seq", key)
