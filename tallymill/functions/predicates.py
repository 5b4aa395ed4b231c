"""Predicate builders that stay pushable where the clause allows it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def all_of(clauses: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def run_filter(
    tags: Sequence[str] = (), any_tags: Sequence[str] = (), group: str | Sequence[str] | None = None,
    state: str | Sequence[str] | None = None, name_regex: str | None = None,
    created_after: str | None = None, created_before: str | None = None, extra: Sequence[Column] = (),
) -> Column:
    """AND of the clauses that are set; with none set every row passes."""
    as_list = lambda v: [v] if isinstance(v, str) else list(v)
    clauses = list(extra)
    clauses += [F.array_contains("tags", t) for t in tags]
    if any_tags:
        clauses.append(F.arrays_overlap("tags", F.lit(list(any_tags))))
    if group:
        clauses.append(F.col("group").isin(as_list(group)))
    if state:
        clauses.append(F.col("state").isin(as_list(state)))
    if name_regex:
        clauses.append(F.col("name").rlike(name_regex))
    if created_after:
        clauses.append(F.col("created_at") >= F.lit(created_after))
    if created_before:
        clauses.append(F.col("created_at") <= F.lit(created_before))
    return all_of(clauses)


def parse_ranges(ranges: Iterable[str]) -> list[tuple[int, int]]:
    """Inclusive ``a-b`` texts; a reversed range is an error."""
    out = []
    for text in ranges:
        low, _, high = text.partition("-")
        low, high = int(low), int(high or low)
        if high < low:
            raise ValueError(f"reversed range {text!r}")
        out.append((low, high))
    return out


def label_set(column: Column, preset: Sequence[int] = (), labels: Sequence[int] = (), ranges: Sequence[str] = ()) -> Column:
    """Membership in the union of preset, ids and ranges; all empty means no restriction."""
    clauses = [column.between(low, high) for low, high in parse_ranges(ranges)]
    ids = sorted({*preset, *labels})
    if ids:
        clauses.append(column.isin(ids))
    if not clauses:
        return F.lit(True)
    return reduce(lambda a, b: a | b, clauses)


def snap(value: Column, grid: Sequence[float], tol: float = 1e-6) -> Column:
    """The first grid point within ``tol`` of the value, else NULL."""
    out = F.lit(None).cast("double")
    for point in reversed(list(grid)):
        out = F.when(F.abs(value - F.lit(float(point))) < tol, F.lit(float(point))).otherwise(out)
    return out


def sweep_rows(runs: DataFrame, target_k: Sequence[int], alphas: Sequence[float], tol: float = 1e-6) -> DataFrame:
    """Finished fixed-schedule runs on the sweep grid, with model and dataset tags and a row name.

    Flags must be true (or must not be); NULL flags count as not set.
    """
    from tallymill.functions.names import general

    alpha = snap(F.col("alpha_min"), alphas, tol)
    keep = all_of([
        F.col("mixing").eqNullSafe(True), F.col("state").eqNullSafe("finished"), F.col("schedule").eqNullSafe("fixed"),
        F.col("k_min") == F.col("k_max"), F.col("k_min").isin(list(target_k)),
        F.abs(F.col("alpha_min") - F.col("alpha_max")) <= tol, alpha.isNotNull(),
        ~F.col("reverse").eqNullSafe(True), ~F.col("k_reverse").eqNullSafe(True), ~F.col("sampling").eqNullSafe(True),
        F.col("eval_top1").isNotNull(), F.col("eval_ece").isNotNull(),
    ])
    model = F.when(F.col("model").contains("vit_wee"), "vit-wee").otherwise(F.col("model"))
    dataset = F.when(F.col("dataset").contains("imagenet-1k"), "in1k").otherwise(F.col("dataset"))
    out = runs.where(keep).withColumns({"alpha": alpha, "k": F.col("k_min").cast("int")})
    name = F.concat_ws(
        "__", model, dataset, F.concat(F.lit("k"), F.col("k").cast("string")),
        F.concat(F.lit("a"), general(F.col("alpha"))), F.col("loss"))
    return out.withColumn("rowname", name)


def funnel(df: DataFrame, reasons: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds ``reason``: the first check that fails (a check is a predicate meaning *reject*), NULL if eligible."""
    reason = F.lit(None).cast("string")
    for name, rejects in reversed(list(reasons)):
        reason = F.when(rejects, name).otherwise(reason)
    return df.withColumn("reason", reason)


def funnel_counts(marked: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """Rows per reason plus ``eligible``, with zeros for reasons that never fired. One aggregation to one row."""
    names = [*reasons, "eligible"]
    reason = F.coalesce("reason", F.lit("eligible"))
    counts = marked.agg(*[F.count_if(reason == n).alias(f"c{i}") for i, n in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(n).alias("reason"), F.col(f"c{i}").alias("rows")) for i, n in enumerate(names)])
    return counts.select(F.inline(pairs))
