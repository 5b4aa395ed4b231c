"""Size-checked handling of small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallymill.session import cut_lineage

BROADCAST_ROWS = 20_000


def pin(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, list | None]:
    """Fix the content of a metadata table so that every later use sees the same rows.

    Up to ``max_rows`` rows come back as a local relation marked for broadcast,
    together with the rows. A larger table is checkpointed and stays
    distributed; the second value is then ``None`` and joins pick their own
    strategy.
    """
    head = df.limit(max_rows + 1).collect()
    if len(head) <= max_rows:
        local = df.sparkSession.createDataFrame(head, df.schema)
        return F.broadcast(local), head
    return cut_lineage(df), None


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys match NULL keys; the right side's keys are dropped."""
    renamed = right.select(
        *[F.col(f"`{k}`").alias(f"__r_{i}") for i, k in enumerate(keys)],
        *[F.col(f"`{c}`") for c in right.columns if c not in keys],
    )
    if not keys:
        raise ValueError("a join needs keys")
    condition = None
    for i, key in enumerate(keys):
        term = left[f"`{key}`"].eqNullSafe(renamed[f"__r_{i}"])
        condition = term if condition is None else condition & term
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{i}" for i in range(len(keys))])
