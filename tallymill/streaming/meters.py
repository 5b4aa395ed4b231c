"""Meters and history over a stream of evaluation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def meter_sums(rows: DataFrame, keys: Sequence[str], value: Column, weight: Column, hit: Column, conf: Column, bins: int = 15) -> DataFrame:
    """Mergeable sums per key and confidence bin; the same expression on a batch or a stream."""
    b = F.least(F.floor(conf * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*keys, b.alias(f"_b{bins}")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value * weight).alias("value_sum"), F.sum(weight).alias("weight_sum"),
        F.sum(hit.cast("double")).alias("hit"), F.sum(conf).alias("conf"))


def meter_values(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average, accuracy in percent and calibration error in percent at any time. ``sums`` has one row per key and bin."""
    gap = F.sum(F.abs(F.col("hit") - F.col("conf"))) / F.sum("n")
    return sums.groupBy(*keys).agg(
        (F.sum("value_sum") / F.sum("weight_sum")).alias("avg"), (F.sum("hit") / F.sum("n") * 100).alias("acc"),
        F.sum("n").alias("count"), (gap * 100).alias("ece"))


def history_rows(evals: DataFrame, train: Sequence[str], evaluated: Sequence[str], run: str = "run_id", step: str = "step", lr: str | None = None, at: str | None = None) -> DataFrame:
    """One history row per evaluation: ``train_`` and ``eval_`` prefixed metrics, with the learning rate if there is one."""
    return evals.select(
        run, step, *([at] if at else []), *[F.col(m).alias(f"train_{m}") for m in train], *[F.col(f"{m}").alias(f"eval_{m}") for m in evaluated], *([F.col(lr).alias("lr")] if lr else []))


def append_history(
    stream: DataFrame, root: str, train: Sequence[str], evaluated: Sequence[str], lr: str | None = None, at: str | None = None, delay: str = "1 hour",
    available_now: bool = True,
):
    """Append-only history below ``root``, one row per (run, step).

    Repeats are dropped by the stream's own keyed state, and the file sink
    commits each micro-batch once, so no batch reads the history back. With
    ``at`` (an event time) a key stays in state only until the newest time is
    ``delay`` past it: a repeat within that is dropped, a row that comes later
    still counts as late and is dropped too, and the state doesn't grow with
    the history. Without ``at`` all keys stay.
    """
    rows = history_rows(stream, train, evaluated, lr=lr, at=at)
    if at:
        rows = rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(["run_id", "step"]).drop(at)
    else:
        rows = rows.dropDuplicates(["run_id", "step"])
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", f"{root}/history").option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
