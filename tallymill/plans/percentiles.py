"""Exact interpolated percentiles that also hold for very large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.plans.indexing import Running, by_number, cell_rows, running
from tallymill.plans.sizing import join_null_safe


def percentiles(df: DataFrame, keys, value: Column, levels: dict[str, float], extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per group with a column per entry of ``levels`` (name -> fraction in [0, 1]) and per aggregate of ``extra``.

    ``percentile`` keeps a group's distinct values in one task. That is fine up
    to the cell size, and then everything is one aggregation; if some group has
    more values, they are counted first (so a value that many rows repeat is
    one row), ranks come from :func:`running` over the counts, and only the
    values next to each cut are aggregated. Both plans interpolate by the same
    formula. NULL values do not count.
    """
    for name, level in levels.items():
        if not 0 <= level <= 1:
            raise ValueError(f"level {name}={level} outside [0, 1]")
    keys, extra = list(keys), extra or {}
    key_cols = [F.col(f"`{k}`") for k in keys]
    number = value.cast("double")
    sizes = df.groupBy(*key_cols).agg(F.count(number).alias("__n"))
    large = sizes.where(F.col("__n") > cell_rows(df)).limit(1).collect()
    rest = [v.alias(n) for n, v in extra.items()]
    if not large:
        return df.groupBy(*key_cols).agg(*[F.percentile(number, F.lit(p)).alias(n) for n, p in levels.items()], *rest)
    data = df.select(*key_cols, number.alias("__v")).where(F.col("__v").isNotNull())
    counts = data.groupBy(*key_cols, "__v").agg(F.count(F.lit(1)).alias("__c"))
    ranked = running(counts, keys, by_number(F.col("__v")), {"__to": Running("sum", F.col("__c"))})
    if keys:
        ranked = join_null_safe(ranked, sizes, keys, "inner")
    else:
        ranked = ranked.withColumn("__n", F.lit(large[0]["__n"]))
    cuts = []
    wanted = F.lit(False)
    for name, level in levels.items():
        at = F.lit(level) * (F.col("__n") - 1)
        below, above = F.floor(at), F.ceil(at)
        is_low, is_high = [(F.col("__to") - F.col("__c") <= rank) & (F.col("__to") > rank) for rank in (below, above)]
        wanted = wanted | is_low | is_high
        lo, hi = F.max(F.when(is_low, F.col("__v"))), F.max(F.when(is_high, F.col("__v")))
        between = F.max(above - at) * lo + F.max(at - below) * hi
        cuts.append(F.when(lo == hi, lo).otherwise(between).alias(name))
    found = ranked.where(wanted).groupBy(*key_cols).agg(*cuts)
    if not keys:
        row = found.first()
        return df.agg(*rest, F.count(F.lit(1)).alias("__all")).select(*extra, *[F.lit(row[n]).alias(n) for n in levels])
    # Every group keeps its row, also one without values.
    return join_null_safe(df.groupBy(*key_cols).agg(*rest, F.count(F.lit(1)).alias("__all")).drop("__all"), found, keys)
