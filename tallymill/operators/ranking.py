"""Ranking, best-of and comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymill.functions.text import signed
from tallymill.plans.indexing import Running, by_number, indexed, running
from tallymill.session import cut_lineage


def average_rank(df: DataFrame, within: Sequence[str], item: str, value: Column, higher_is_better: bool = True) -> DataFrame:
    """Mean over groups of each item's rank, ties sharing the average rank.

    Repeated cells are averaged first with map-side combine, so a group holds one
    row per compared item (a method, a recipe) when it is ranked, not its data rows.
    """
    within = list(within)
    cells = df.groupBy(*within, item).agg(F.avg(value).alias("_v")).where("_v IS NOT NULL")
    order = F.desc("_v") if higher_is_better else F.asc("_v")
    best_first = Window.partitionBy(*within).orderBy(order)
    same = Window.partitionBy(*within, "_v")
    rank = F.rank().over(best_first) + (F.count(F.lit(1)).over(same) - 1) / 2
    return cells.withColumn("_r", rank).groupBy(item).agg(F.avg("_r").alias("mean_rank"), F.count(F.lit(1)).alias("n_groups"))


def shared_order(df: DataFrame, within: Sequence[str], item: str, metrics: dict[str, bool], pinned: Sequence[str] = ()) -> DataFrame:
    """One item order for several metrics (name -> higher is better): pinned prefixes first, then mean rank, then name."""
    parts = [
        average_rank(df, within, item, F.col(f"`{m}`"), higher).select(item, "mean_rank") for m, higher in metrics.items()]
    ranks = parts[0]
    for part in parts[1:]:
        ranks = ranks.unionByName(part)
    mean = ranks.groupBy(item).agg(F.avg("mean_rank").alias("mean_rank"))
    first = F.lit(len(pinned))
    for i, prefix in reversed(list(enumerate(pinned))):
        first = F.when(F.col(item).startswith(prefix), i).otherwise(first)
    # Means are written before they are put in order, as their last bits depend on the order of addition.
    order = by_number(F.col("_first"), F.col("mean_rank"), F.col(item))
    placed = indexed(cut_lineage(mean.withColumn("_first", first)), [], order, "place", 1)
    return placed.withColumn("place", F.col("place").cast("int")).drop("_first")


def best_and_delta(df: DataFrame, group: Sequence[str], method: str, metrics: dict[str, bool], baseline: str) -> DataFrame:
    """Per metric a best flag in the group (every tied row) and the difference to the baseline method's row.

    The group extremes are one aggregate joined back, so a large group is never sorted in one task.
    """
    group = list(group)
    parts = []
    for m, higher in metrics.items():
        pick = F.max if higher else F.min
        parts += [pick(m).alias(f"_best_{m}"), F.max(F.when(F.col(method) == baseline, F.col(m))).alias(f"_base_{m}")]
    extremes = df.groupBy(*group).agg(*parts)
    out = df.join(extremes, group)
    for m in metrics:
        out = out.withColumns({f"{m}_best": F.col(m) == F.col(f"_best_{m}"), f"{m}_delta": F.col(m) - F.col(f"_base_{m}")})
    return out.drop(*[f"_{kind}_{m}" for kind in ("best", "base") for m in metrics])


def with_place(df: DataFrame) -> DataFrame:
    """Position by top1 descending, top5 descending, model."""
    second = F.struct(F.col("top5").isNull().alias("none"), (-F.col("top5")).alias("v"))
    order = by_number(F.col("top1"), second, F.col("model"), descending=True)
    return indexed(df, [], order, "place")


def robustness_diff(base: DataFrame, test: DataFrame) -> DataFrame:
    """Test results next to the base set: signed score differences and places gained, empty without a base row."""
    keys = ["model", "img_size"]
    ref = with_place(base).select(*keys, F.col("top1").alias("_b1"), F.col("top5").alias("_b5"), F.col("place").alias("_bp"))
    out = with_place(test).join(ref, keys, "left")
    gained = F.col("_bp") - F.col("place")
    move = F.when(gained == 0, "0").when(gained > 0, F.concat(F.lit("+"), gained.cast("string"))).otherwise(gained.cast("string"))
    known = lambda col: F.when(F.col("_bp").isNotNull(), col).otherwise("")
    return out.withColumns({
        "top1_diff": known(signed(F.col("top1") - F.col("_b1"))), "top5_diff": known(signed(F.col("top5") - F.col("_b5"))),
        "rank_diff": known(move)}).drop("_b1", "_b5", "_bp")


def relative_to_reference(df: DataFrame, is_reference: Column, value: str) -> DataFrame:
    """``100 * (1 - v / v_ref)``; exactly one reference row must exist."""
    rows = df.where(is_reference).select(value).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("the reference row is missing" if not rows else "several reference rows")
    return df.withColumn("reduction_percent", (F.lit(1.0) - F.col(value) / F.lit(float(rows[0][0]))) * 100)


def best_checkpoints(df: DataFrame, run: str, step: str, metric: str, n: int, decreasing: bool = False) -> DataFrame:
    """Per step: is it a new best of its run, and is it among the ``n`` retained at the end.

    Ties keep the earlier step; a row without a metric is always retained. Runs of any length are cut into cells.
    """
    value = -F.col(metric) if decreasing else F.col(metric)
    flagged = running(df, [run], by_number(F.col(step)), {"_before": Running("max_before", value)})
    is_best = F.col(metric).isNotNull() & (F.col("_before").isNull() | (value > F.col("_before")))
    flagged = flagged.withColumn("is_best", is_best).drop("_before")
    ranked = indexed(flagged, [run], by_number(value, F.col(step), descending=True), "_rank", 1)
    return ranked.withColumn("retained", F.col(metric).isNull() | (F.col("_rank") <= n)).drop("_rank")


def best_of_run(df: DataFrame, run: str, step: str, metric: str, decreasing: bool = False) -> DataFrame:
    """Best metric per run and the first step that reached it."""
    value = -F.col(metric) if decreasing else F.col(metric)
    return df.where(F.col(metric).isNotNull()).groupBy(run).agg(
        F.max_by(F.struct(F.col(metric).alias("m"), F.col(step).alias("s")), F.struct(value, -F.col(step))).alias("_b")
    ).select(run, F.col("_b.m").alias("best_metric"), F.col("_b.s").alias("best_step"))


def preferred_order(df: DataFrame, column: str, preferred: Sequence[str]) -> DataFrame:
    """Distinct values with their place: the listed ones in list order, then the rest alphabetically."""
    place = F.array_position(F.lit(list(preferred)), F.col(column))
    listed = F.when(place > 0, place).otherwise(F.lit(len(preferred) + 1))
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    placed = indexed(values.withColumn("_listed", listed), [], by_number(F.col("_listed"), F.col(column)), "place", 1)
    return placed.withColumn("place", F.col("place").cast("int")).drop("_listed")
