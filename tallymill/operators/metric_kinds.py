"""Metrics that are more than sums over rows, for the registry of :mod:`tallymill.operators.metrics`.

Each kind has ``table(scored, group, name)``, which returns (group..., metric, value) from rows with their scores. The
plans keep to bounded groups: two-level metrics meet as one row per class, order statistics and rank sums as one row per
distinct value whose places come from the cell plan, and user aggregates as one state per task and group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType, BinaryType

from tallymill.plans.indexing import Running, by_number, running
from tallymill.plans.percentiles import percentiles

HELD_STATES = 10_000
MERGE_PARTS = 32


def _long(df: DataFrame, group: Sequence[str], name: str, value: Column) -> DataFrame:
    return df.select(*[F.col(f"`{g}`") for g in group], F.lit(name).alias("metric"), value.cast("double").alias("value"))


@dataclass(frozen=True)
class PerClass:
    """A metric of each class, then the mean over the classes that a group has.

    ``sums`` and ``finish`` are as for a metric of sums, within a class; ``by``
    names the class column. Rows without a class belong to none.
    """

    sums: dict[str, Column]
    finish: Callable[[dict[str, Column]], Column]
    by: str = "label"

    def table(self, scored: DataFrame, group: Sequence[str], name: str) -> DataFrame:
        group = list(group)
        inner = scored.where(F.col(self.by).isNotNull()).groupBy(*group, self.by).agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"_s_{k}") for k, v in self.sums.items()])
        value = self.finish({"n": F.col("n"), **{k: F.col(f"_s_{k}") for k in self.sums}})
        return _long(inner.groupBy(*group).agg(F.avg(value).alias("value")), group, name, F.col("value"))


@dataclass(frozen=True)
class Quantile:
    """Interpolated quantile of a per-row value; exact for groups of any size."""

    value: Column
    level: float

    def table(self, scored: DataFrame, group: Sequence[str], name: str) -> DataFrame:
        return _long(percentiles(scored, group, self.value, {"value": self.level}), group, name, F.col("value"))


@dataclass(frozen=True)
class RankArea:
    """Area under the ROC curve by rank sums: the share of (positive, negative) pairs in which the positive scores higher.

    Rows are counted per distinct score first, so ties (half a pair each) and
    repeated scores are one row; NULL in one class means that a class is missing.
    """

    score: Column
    positive: Column

    def table(self, scored: DataFrame, group: Sequence[str], name: str) -> DataFrame:
        group = list(group)
        rows = scored.select(*group, self.score.cast("double").alias("_score"), self.positive.alias("_hit")).where("_score IS NOT NULL AND _hit IS NOT NULL")
        counts = rows.groupBy(*group, "_score").agg(F.count_if("_hit").alias("_p"), F.count_if(~F.col("_hit")).alias("_q"))
        ranked = running(counts, group, by_number(F.col("_score")), {"_below": Running("sum", F.col("_q"))})
        pairs = F.col("_p").cast("double") * (F.col("_below") - F.col("_q") / 2)
        # One row per group, whichever rows are missing.
        area = F.sum(pairs) / F.nullif(F.sum("_p").cast("double") * F.sum("_q"), F.lit(0.0))
        return _long(ranked.groupBy(*group).agg(area.alias("value")), group, name, F.col("value"))


class Mergeable(Protocol):
    """State of a user aggregate, kept as bytes. ``update`` gets None for a new state."""

    def update(self, state: bytes | None, values: dict[str, np.ndarray]) -> bytes: ...

    def merge(self, a: bytes, b: bytes) -> bytes: ...

    def finish(self, state: bytes) -> float | None | dict[str, float | None]: ...


@dataclass(frozen=True)
class UserAggregate:
    """A metric in plain numpy over Arrow batches: ``make()`` gives its :class:`Mergeable` on every worker.

    States are updated batch by batch inside a task, so one state per task and
    group leaves the map side; they merge in two steps, first in
    ``MERGE_PARTS`` shares of a group. Merging has to be associative and
    commutative. ``inputs`` are numbers; NULL arrives as NaN.
    """

    inputs: dict[str, Column]
    make: Callable[[], Mergeable]

    def table(self, scored: DataFrame, group: Sequence[str], name: str) -> DataFrame:
        group, inputs, make = list(group), list(self.inputs), self.make
        rows = scored.select(*[F.col(f"`{g}`") for g in group], *[v.cast("double").alias(f"_in_{k}") for k, v in self.inputs.items()])
        schema = StructType([*[rows.schema[g] for g in group], StructField("_state", BinaryType())])

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aggregate, held, types = make(), {}, []

            def flush():
                columns = list(zip(*held)) if held and group else [() for _ in group]
                batch = pa.RecordBatch.from_arrays(
                    [*[pa.array(c, t) for c, t in zip(columns, types)], pa.array(list(held.values()), pa.binary())], names=[*group, "_state"])
                held.clear()
                return batch

            for batch in batches:
                if not batch.num_rows:
                    continue
                types = [batch.schema.field(k).type for k in range(len(group))]
                keys = list(zip(*[batch.column(k).to_pylist() for k in range(len(group))])) if group else [()] * batch.num_rows
                number = {}
                code = np.array([number.setdefault(k, len(number)) for k in keys])
                order = np.argsort(code, kind="stable")
                cuts = np.searchsorted(code[order], np.arange(len(number) + 1))
                values = {k: batch.column(len(group) + j).to_numpy(zero_copy_only=False) for j, k in enumerate(inputs)}
                for key, k in number.items():
                    mine = order[cuts[k]:cuts[k + 1]]
                    held[key] = aggregate.update(held.get(key), {n: v[mine] for n, v in values.items()})
                if len(held) > HELD_STATES:
                    yield flush()
            if held:
                yield flush()

        def merged(states: pa.Array) -> bytes:
            aggregate, total = make(), None
            for state in states.to_pylist():
                total = state if total is None else aggregate.merge(total, state)
            return total

        def finished(states: pa.Array) -> pa.Array:
            aggregate = make()
            out = []
            for state in states.to_pylist():
                value = aggregate.finish(state)
                out.append(list(value.items()) if isinstance(value, dict) else [("", value)])
            return pa.array(out, pa.map_(pa.string(), pa.float64()))

        for f, given, back in ((merged, pa.Array, bytes), (finished, pa.Array, pa.Array)):
            f.__annotations__ = {"states": given, "return": back}
        merge = F.arrow_udf(merged, "binary")
        states = rows.mapInArrow(partial, schema).withColumn("_part", F.pmod(F.xxhash64("_state"), F.lit(MERGE_PARTS)))
        shares = states.groupBy(*group, "_part").agg(merge("_state").alias("_state"))
        whole = shares.groupBy(*group).agg(merge("_state").alias("_state"))
        named = whole.select(*group, F.explode(F.arrow_udf(finished, "map<string,double>")("_state")).alias("_sub", "value"))
        label = F.when(F.col("_sub") == "", F.lit(name)).otherwise(F.concat(F.lit(f"{name}/"), "_sub"))
        return named.select(*group, label.alias("metric"), "value")


class Shape:
    """Mean, standard deviation and skewness of the values that are present, from power sums about a first guess."""

    def update(self, state, values):
        x = values["x"][~np.isnan(values["x"])]
        if state is None and not len(x):
            return np.zeros(5).tobytes()
        at = self._read(state)
        about = at[4] if at[0] else (float(x[0]) if len(x) else 0.0)
        d = x - about
        return (np.array([*(at[:4] + [len(d), d.sum(), (d ** 2).sum(), (d ** 3).sum()]), about])).tobytes()

    @staticmethod
    def _read(state):
        return np.zeros(5) if state is None else np.frombuffer(state, dtype=np.float64)

    def merge(self, a, b):
        a, b = self._read(a), self._read(b)
        if not a[0] or not b[0]:
            return (a if a[0] else b).tobytes()
        # The sums of b about a's guess.
        s = b[4] - a[4]
        n, m1, m2, m3 = b[:4]
        moved = np.array([n, m1 + n * s, m2 + 2 * s * m1 + n * s * s, m3 + 3 * s * m2 + 3 * s * s * m1 + n * s ** 3])
        return np.array([*(a[:4] + moved), a[4]]).tobytes()

    def finish(self, state):
        n, m1, m2, m3, about = self._read(state)
        if not n:
            return {"mean": None, "std": None, "skew": None}
        mean = m1 / n
        var, third = m2 / n - mean ** 2, m3 / n - 3 * mean * m2 / n + 2 * mean ** 3
        return {"mean": about + mean, "std": float(np.sqrt(max(var, 0.0) * n / (n - 1))) if n > 1 else None, "skew": third / var ** 1.5 if var > 1e-300 else None}
