"""Rules from a user's table: the label of the first needle that a text contains, by one automaton over all needles.

The automaton reads each text once, whatever the number of rules: its states are the needles' prefixes, and a state
knows the first rule among all needles that end there. Texts repeat, so each distinct one is read once and joined back.
Rule tables beyond ``RULES_PER_PASS`` are read in blocks of falling precedence; a text that a block has decided is not
read again.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallymill.plans.indexing import by_number, indexed
from tallymill.plans.sizing import join_null_safe
from tallymill.session import cut_lineage

RULES_PER_PASS = 100_000


class Needles:
    """Automaton over needles; ``first(text)`` is the least number of a needle in the text, or -1."""

    def __init__(self, needles: list[str]):
        self.step: list[dict[str, int]] = [{}]
        self.best: list[int] = [-1]
        for number, needle in enumerate(needles):
            at = 0
            for c in needle:
                after = self.step[at].get(c)
                if after is None:
                    after = self.step[at][c] = len(self.step)
                    self.step.append({})
                    self.best.append(-1)
                at = after
            if self.best[at] < 0:
                self.best[at] = number
        # Breadth first: a state falls back to the longest of its suffixes that is a state, which is nearer to the start.
        self.back = [0] * len(self.step)
        queue = deque(self.step[0].values())
        while queue:
            at = queue.popleft()
            for c, after in self.step[at].items():
                back = self.back[at]
                while back and c not in self.step[back]:
                    back = self.back[back]
                self.back[after] = self.step[back].get(c, 0)
                queue.append(after)
            self.best[at] = self._least(self.best[at], self.best[self.back[at]])

    @staticmethod
    def _least(a: int, b: int) -> int:
        return b if a < 0 else a if b < 0 else min(a, b)

    def first(self, text: str) -> int:
        at, least, step, back = 0, self.best[0], self.step, self.back
        for c in text:
            if least == 0:
                break
            while at and c not in step[at]:
                at = back[at]
            at = step[at].get(c, 0)
            if self.best[at] >= 0:
                least = self._least(least, self.best[at])
        return least


def first_rule(df: DataFrame, column: str, rules: DataFrame, out: str = "label", default: str | None = "unknown", per_pass: int = RULES_PER_PASS) -> DataFrame:
    """``df`` with the label of the rule of least priority whose needle the text contains; ``default`` without one.

    ``rules`` is (needle, label, priority), of equal priorities the least needle
    and then label first. NULL needles match nothing, empty ones every text; a
    NULL text gets ``default``.
    """
    ranked = rules.select("needle", "label", "priority").where("needle IS NOT NULL").withColumn(
        "__rank", F.struct("priority", "needle", "label"))
    ranked = cut_lineage(indexed(ranked, [], by_number(F.col("__rank")), "__no").drop("__rank"))
    total = ranked.count()
    texts = cut_lineage(df.select(F.col(f"`{column}`").alias("__text")).where("__text IS NOT NULL").distinct().withColumn("__rule", F.lit(-1).cast("long")))
    for start in range(0, total, per_pass):
        # One block of rules, bounded, in every task.
        block = [r["needle"] for r in ranked.where(F.col("__no").between(start, start + per_pass - 1)).orderBy("__no").collect()]
        texts = cut_lineage(texts.withColumn("__rule", F.when(F.col("__rule") >= 0, F.col("__rule")).otherwise(_reader(block, start)("__text", "__rule"))))
    labels = ranked.select(F.col("__no").alias("__rule"), F.col("label").alias("__label"))
    found = texts.join(labels, "__rule", "left").select("__text", F.when(F.col("__rule") >= 0, F.col("__label")).otherwise(F.lit(default)).alias(out))
    joined = join_null_safe(df.withColumn("__text", F.col(f"`{column}`")), found, ["__text"]).drop("__text")
    return joined.withColumn(out, F.when(F.col(f"`{column}`").isNull(), F.lit(default)).otherwise(F.col(out)))


def _reader(needles: list[str], start: int):
    held: list[Needles] = []

    def read(texts: pa.Array, rules: pa.Array) -> pa.Array:
        if not held:
            held.append(Needles(needles))
        out = [-1 if rule >= 0 else held[0].first(text) for text, rule in zip(texts.to_pylist(), rules.to_pylist())]
        return pa.array([x + start if x >= 0 else -1 for x in out], pa.int64())

    read.__annotations__ = {"texts": pa.Array, "rules": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, "long")
