"""Keyed state kept by the stream itself: label caps and groups of four with a timer.

Each label or key has its own small state in the state store (a count, or at most three waiting rows), updated where the
key's rows meet, so no batch reads a state table back. What meets there is small too: before the shuffle every task
keeps only the rows that a label could still accept.
"""

from __future__ import annotations

import contextlib
import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallymill.hashing import uniform
from tallymill.operators.mixing import weighted_fours
from tallymill.plans.indexing import by_number, first_n
from tallymill.streaming.tables import read_between, run_batches, write_batch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside use the state store that keyed processors need; others keep the session's."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def least_per_label(label: str, key: str, cap: int):
    """Keeps, per task and label, the ``cap`` rows of least key: the most that the label can accept of a micro-batch."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = None, None
        for batch in batches:
            schema = batch.schema
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            frame = pd.DataFrame({"l": table.column(label).to_pandas(), "k": table.column(key).to_pandas()})
            rank = frame.sort_values("k", kind="stable").groupby("l", dropna=False, sort=False).cumcount()
            held = table.take(pa.array(sorted(rank.index[rank < cap])))
        if held is not None:
            yield from held.cast(schema).to_batches()

    return keep


class CapProcessor(StatefulProcessor):
    """Accepts rows of least key while a label has room; the state is the label's count so far."""

    def __init__(self, key: str, cap: int):
        self.key, self.cap = key, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        used = self.used.get()[0] if self.used.exists() else 0
        room, chosen = self.cap - used, None
        if room <= 0:
            return
        for frame in rows:
            frame = frame if chosen is None else pd.concat([chosen, frame])
            chosen = frame.sort_values(self.key, kind="stable").head(room)
        if chosen is not None and len(chosen):
            self.used.update((int(used + len(chosen)),))
            yield chosen


def capped_labels(stream: DataFrame, label: str, key: str, cap: int, fits: Column | None = None) -> DataFrame:
    """The streaming rows accepted under a cap per label, those of least ``key`` first within a micro-batch.

    Start it inside :func:`keyed_state`, in append mode.
    """
    rows = stream.where(fits) if fits is not None else stream
    least = rows.mapInArrow(least_per_label(label, key, cap), rows.schema)
    # NULL is a label like any other; state keys are texts.
    named = least.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")))
    return named.groupBy("_label").transformWithStateInPandas(CapProcessor(key, cap), rows.schema, "Append", "None")


def capped_label_stream(
    stream: DataFrame, root: str, label: str, key: str, cap: int, total: int | None = None, fits: Column | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Accepted rows below ``root``/accepted: at most ``cap`` per label by keyed state, and ``total`` overall, applied at the sink."""
    spark = stream.sparkSession

    def process(batch: DataFrame, batch_id: int):
        rows = batch
        if total is not None:
            before = read_between(spark, f"{root}/accepted", None, batch_id - 1) if batch_id else None
            rows = first_n(batch, [], by_number(F.col(key)), max(0, total - (before.count() if before is not None else 0)))
        write_batch(rows, f"{root}/accepted", batch_id)

    with keyed_state(spark):
        return run_batches(capped_labels(stream, label, key, cap, fits), process, f"{root}/checkpoint", available_now=available_now)


class FourProcessor(StatefulProcessor):
    """Groups a key's rows by four in order of arrival; up to three wait in list state until a timer lets them go."""

    def __init__(self, keys: Sequence[str], key: str, label: str, types: StructType, wait_ms: int | None):
        self.keys, self.key, self.label, self.types, self.wait_ms = list(keys), key, label, types, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([self.types[self.key], self.types[self.label]]))
        self.groups = handle.getValueState("groups", StructType([StructField("n", LongType())]))

    def _frame(self, key, parts):
        rows = [(*key, group, [m for m, _ in members], [y for _, y in members]) for group, members in parts]
        return pd.DataFrame(rows, columns=[*self.keys, "group", "members", "labels"]).astype({"group": "Int64"})

    def handleInputRows(self, key, rows, timerValues):
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        had = bool(held)
        done = self.groups.get()[0] if self.groups.exists() else 0
        out = []
        new = []
        for frame in rows:
            new.extend(zip(frame[self.key].tolist(), frame[self.label].tolist()))
            # Frames come unordered within the micro-batch, which is what arrives together.
        for row in sorted(new):
            held.append(row)
            if len(held) == 4:
                out.append((done, held))
                held, done = [], done + 1
        if out:
            self.groups.update((done,))
        if held:
            self.waiting.put([tuple(h) for h in held])
        elif had:
            self.waiting.clear()
        if self.wait_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        if held:
            self.waiting.clear()
            yield self._frame(key, [(None, [h]) for h in held])


def timed_fours(
    stream: DataFrame, keys: Sequence[str], key: str, label: str, prob: float, seed: int, epoch: int, wait_ms: int | None = None, **layout,
) -> DataFrame:
    """Streaming groups of four per ``keys`` with labels and weights; rows not drawn pass through at once.

    Rows of a micro-batch count as arrived in order of ``key``. With ``wait_ms``
    rows that have waited that long without new ones leave as single-label
    targets. Start it inside :func:`keyed_state`, in append mode.
    """
    keys = list(keys)
    rows = stream.select(*keys, key, label)
    drawn = uniform(seed, epoch, "group", F.col(key)) < prob
    members = lambda c: F.array(F.col(c))
    passed = rows.where(~drawn).select(*keys, F.lit(None).cast("bigint").alias("group"), members(key).alias("members"), members(label).alias("labels"))
    types = rows.schema
    schema = StructType([*[types[k] for k in keys], StructField("group", LongType()), passed.schema["members"], passed.schema["labels"]])
    processor = FourProcessor(keys, key, label, types, wait_ms)
    grouped = rows.where(drawn).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if wait_ms is not None else "None")
    return weighted_fours(grouped.unionByName(passed), seed, epoch, **layout)
