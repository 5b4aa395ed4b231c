"""Aggregation over seeds, timings, class counts and sweeps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType

from tallymill.missing import require_columns, sample_std, to_number
from tallymill.plans.indexing import Running, by_number, running
from tallymill.plans.percentiles import percentiles
from tallymill.plans.sizing import join_null_safe
from tallymill.session import cut_lineage

EXPECTED_SEEDS = (42, 43, 44)


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def distinct_values(df: DataFrame, column: str, limit: int = 10_000) -> list:
    """Sorted distinct non-NULL values of an axis column; an axis beyond ``limit`` values is an error."""
    rows = df.select(c(column).alias("v")).where("v IS NOT NULL").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column!r} has more than {limit} distinct values and cannot be an axis")
    return sorted(r["v"] for r in rows)


def numeric_columns(df: DataFrame, skip: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (NumericType, BooleanType)) and f.name not in set(skip)]


def aggregate_over_seeds(df: DataFrame, group_by: Sequence[str], metrics: Sequence[str] | None = None, seed: str = "seed") -> DataFrame:
    """``<m>_mean``, ``<m>_std`` and ``n_seeds`` per group; NULL keys form groups. Default metrics: all numeric columns."""
    chosen = list(metrics) if metrics is not None else numeric_columns(df, [*group_by, seed])
    parts = []
    for m in chosen:
        value = c(m).cast("double")
        parts += [F.avg(value).alias(f"{m}_mean"), F.stddev_samp(value).alias(f"{m}_std")]
    if seed in df.columns:
        parts.append(F.count_distinct(c(seed)).alias("n_seeds"))
    return df.groupBy(*[c(g) for g in group_by]).agg(*parts)


def confidence_95(std: Column, n: Column) -> Column:
    """Half width of the normal 95 % interval; NULL below two values."""
    return F.when(n >= 2, F.lit(1.96) * std / F.sqrt(n))


def aggregate_by_type(df: DataFrame, metrics: Sequence[str], expected_seeds: Sequence[int] = EXPECTED_SEEDS) -> DataFrame:
    """Means, deviations and seed completeness by (type, dataset, model, long_horizon); incomplete groups stay, marked."""
    keys = ["type", "dataset", "model", "long_horizon"]
    require_columns(df, keys)
    present = [m for m in metrics if m in df.columns]
    if not present:
        raise ValueError(f"none of the metrics {list(metrics)} in {df.columns}")
    # A set of seeds: as many entries as the study has seeds.
    seeds = F.array_sort(F.collect_set(to_number(F.col("seed").cast("string"), "bigint"))) if "seed" in df.columns else F.array().cast("array<bigint>")
    numbers = set(numeric_columns(df, []))
    stats = []
    for m in present:
        # Numbers are taken as they are; only texts need parsing.
        value = to_number(c(m)) if m in numbers else to_number(c(m).cast("string"))
        stats += [F.avg(value).alias(f"{m}_mean"), sample_std(value, "zero").alias(f"{m}_std")]
    agg = df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(seeds.alias("_seeds"), *stats)
    missing = F.array_except(F.lit([int(s) for s in expected_seeds]).cast("array<bigint>"), F.col("_seeds"))
    out = agg.withColumns({
        "n_seeds": F.size("_seeds"), "seeds_present": F.array_join("_seeds", ","), "missing_seeds": F.array_join(missing, ","),
        "status": F.when(F.size(missing) == 0, "complete").otherwise("unfinished"),
    })
    lead = [*keys, "n_seeds", "seeds_present", "missing_seeds", "status"]
    return out.select(*lead, *[c(x) for m in present for x in (f"{m}_mean", f"{m}_std")])


def split_by_horizon(agg: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(short, long, unfinished): complete groups by horizon, and the groups that are reported and dropped."""
    complete = agg.where("status = 'complete'")
    return complete.where("NOT long_horizon"), complete.where("long_horizon"), agg.where("status <> 'complete'")


# The columns of a timing file, its setup first, then its metrics.
RUNTIME_KEYS = (
    "configuration", "description", "loss", "mix_k", "balanced_mode", "batch_size", "workers", "warmup_batches", "measured_batches",
)
RUNTIME_METRICS = (
    "first_batch_seconds", "total_batch_processing_seconds", "throughput_images_per_second", "latency_p50_ms", "latency_p95_ms", "peak_rss_mb",
    "peak_uss_mb",
)


def runtime_summary(df: DataFrame, keys: Sequence[str] = RUNTIME_KEYS, metrics: Sequence[str] = RUNTIME_METRICS, seed: str = "seed") -> DataFrame:
    """Mean and deviation of the timing metrics per setup, number of runs and the seeds seen. NULL keys stay groups."""
    require_columns(df, [*keys, *metrics, seed])
    parts = [F.count(F.lit(1)).alias("runs"), F.array_join(F.array_sort(F.collect_set(seed)), ",").alias("seeds_present")]
    for m in metrics:
        parts += [F.avg(c(m)).alias(f"{m}_mean"), F.stddev_samp(c(m)).alias(f"{m}_std")]
    return df.groupBy(*[c(k) for k in keys]).agg(*parts)


def last_eval_summary(lines: DataFrame, metrics: Sequence[str], required: str, group: Sequence[str], run: str = "run", seed: str = "seed") -> DataFrame:
    """Per run the last JSON line that parses and has ``required``; then mean and deviation per group.

    ``lines`` has the run key, group columns, seed, line_no and text. Bad lines drop out.
    """
    fields = list(dict.fromkeys([required, *metrics]))
    parsed = lines.withColumn("_m", F.from_json("text", F.lit("map<string,string>"), {"mode": "PERMISSIVE"}))
    values = F.struct(*[to_number(F.try_element_at("_m", F.lit(m))).alias(m) for m in fields])
    usable = parsed.where(F.map_contains_key("_m", required)).select(run, *group, seed, "line_no", values.alias("_v"))
    last = usable.groupBy(run, *group, seed).agg(F.max_by("_v", "line_no").alias("_v"))
    parts = []
    for m in metrics:
        parts += [F.avg(c("_v")[m]).alias(f"{m}_mean"), sample_std(c("_v")[m], "zero").alias(f"{m}_std")]
    agg = last.groupBy(*group).agg(F.count(F.lit(1)).alias("n_seeds"), *parts)
    # The seed list keeps duplicates; counting per seed first keeps the shuffle small.
    per_seed = last.groupBy(*group, seed).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    pairs = F.sort_array(F.collect_list(F.struct(seed, "_n")))
    texts = per_seed.groupBy(*group).agg(
        F.array_join(F.flatten(F.transform(pairs, lambda p: F.array_repeat(p[seed], p["_n"]))), ",").alias("seeds"))
    return join_null_safe(agg, texts, list(group))


def latency_profile(df: DataFrame, keys: Sequence[str], warmup: int, batch: str = "batch_no", seconds: str = "seconds", items: str = "items") -> DataFrame:
    """p50 and p95 batch time by linear interpolation, throughput and first-batch time.

    ``batch`` counts from 1 within a run; batch 1 and the ``warmup`` batches after it are not measured.
    """
    late = F.col(batch) > 1 + warmup
    extra = {
        "items_per_second": F.sum(F.when(late, c(items))) / F.sum(F.when(late, c(seconds))),
        "first_batch_seconds": F.max(F.when(F.col(batch) == 1, c(seconds))), "measured": F.count_if(late),
    }
    return percentiles(df, keys, F.when(late, c(seconds)), {"p50_seconds": 0.5, "p95_seconds": 0.95}, extra)


def sketch_size(rank_error: float) -> int:
    """Items per level of a KLL sketch whose ranks are off by at most ``rank_error`` (a share, with 99 % confidence)."""
    # The published fit of the sketch's error to its size.
    size = math.ceil((2.296 / rank_error) ** (1 / 0.9723))
    if not 8 <= size <= 65_535:
        raise ValueError(f"no sketch has a rank error of {rank_error}")
    return size


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: Column, rank_error: float = 0.002) -> DataFrame:
    """(keys, ``sketch``): a mergeable sketch of the non-NULL values per group, of bounded size whatever the group's.

    Write it by day or by shard, add it up with :func:`merge_sketches` and read
    it with :func:`sketch_quantiles`. Partial aggregation merges on the map side,
    so a hot group is no hot task.
    """
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(value.cast("double"), F.lit(sketch_size(rank_error))).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str], rank_error: float = 0.002) -> DataFrame:
    """One sketch per group of ``keys`` from finer ones of the same ``rank_error``."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(sketch_size(rank_error))).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, keys: Sequence[str], levels: dict[str, float]) -> DataFrame:
    """(keys, ``n``, a column per entry of ``levels``), NULL for groups without values."""
    n = F.kll_sketch_get_n_double("sketch")
    at = [F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(name) for name, p in levels.items()]
    return sketches.select(*keys, n.alias("n"), *at)


def rank_errors(df: DataFrame, quantiles: DataFrame, keys: Sequence[str], value: Column, levels: dict[str, float]) -> DataFrame:
    """(keys, ``name``, ``error``): how far the exact ranks of values that are said to be quantiles are from their levels, as shares."""
    rows = join_null_safe(df.select(*keys, value.cast("double").alias("_v")).where("_v IS NOT NULL"), quantiles.select(*keys, *levels), keys, "inner")
    # NaN ranks above all numbers, in Spark's order as in the sketch's input.
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("_v") < F.col(c)).alias(f"_lt_{c}") for c in levels],
        *[F.count_if(F.col("_v") <= F.col(c)).alias(f"_le_{c}") for c in levels])
    entries = [F.struct(F.lit(c).alias("name"), F.greatest(
        F.lit(0.0), F.col(f"_lt_{c}") / F.col("_n") - p, p - F.col(f"_le_{c}") / F.col("_n")).alias("error")) for c, p in levels.items()]
    return counts.select(*keys, F.inline(F.array(*entries)))


def metrics_across_seeds(rows: DataFrame, group: Sequence[str], metrics: Sequence[str], level: str = "k") -> DataFrame:
    """Mean and deviation over seeds of the values present (deviation NULL below two), with a sort ordinal for ``level``:
    numbers ascending, then ``all``."""
    parts = []
    for m in metrics:
        parts += [F.avg(c(m)).alias(f"{m}_mean"), F.stddev_samp(c(m)).alias(f"{m}_std"), F.count(c(m)).alias(f"{m}_n")]
    number = F.col(level).try_cast("int")
    parts.append(F.count(F.lit(1)).alias("n_seeds"))
    return rows.groupBy(*group).agg(*parts).withColumn("level_order", F.coalesce(number, F.lit(2_147_483_647)))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, label: str, rows_per_class: int) -> DataFrame:
    """Epoch size of each balancing mode and its signed difference to the table, with class count, smallest and largest class."""
    totals = class_counts(df, label).agg(
        F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.sum("n").alias("original"))
    modes = F.array(*[
        F.struct(F.lit(name).alias("mode"), (F.col("classes") * per).cast("bigint").alias("epoch_size"))
        for name, per in (("min", F.col("smallest")), ("max", F.col("largest")), ("fixed", F.lit(rows_per_class)))])
    out = totals.select("*", F.inline(modes))
    return out.withColumn("diff_percent", (F.col("epoch_size") - F.col("original")) * 100.0 / F.col("original"))


def natural_stats(df: DataFrame, label: str, k: int) -> DataFrame:
    """Totals of the level schedule in closed form.

    Level l holds one row of every class with more than l rows, so the number of
    active classes is a step function of the class sizes. Each distinct size is
    one step: no level is ever expanded.
    """
    by_size = cut_lineage(class_counts(df, label).groupBy("n").agg(F.count(F.lit(1)).alias("classes")))
    classes = by_size.agg(F.sum("classes")).first()[0] or 0
    placed = running(by_size, [], by_number(F.col("n")), {"upto": Running("sum", F.col("classes")), "below": Running("max_before", F.col("n"))})
    steps = placed.select(
        (F.col("n") - F.coalesce("below", F.lit(0))).alias("levels"), (F.lit(classes) - F.col("upto") + F.col("classes")).alias("active"))
    mixed = F.col("active") >= k
    rest = F.col("active") % k
    total = lambda cond, value: F.coalesce(F.sum(F.when(cond, F.col("levels") * value)), F.lit(0)).cast("bigint")
    return steps.agg(
        total(mixed, F.col("active")).alias("mixed_primary"), total(~mixed, F.col("active")).alias("single_primary"),
        total(mixed, F.lit(1)).alias("mixed_rows"), total(~mixed, F.lit(1)).alias("single_rows"),
        total(mixed & (rest > 0), F.lit(1)).alias("padded_groups"), total(mixed, rest).alias("remainder_outputs"),
        total(F.lit(True), F.col("active")).alias("total_primary"))


def grid_coverage(rows: DataFrame, group: Sequence[str], axes: dict[str, Sequence]) -> DataFrame:
    """Combinations of the axis values that a group has no row for."""
    wanted = rows.select(*group).distinct()
    for name, values in axes.items():
        wanted = wanted.withColumn(name, F.explode(F.lit(list(values))))
    return wanted.join(rows.select(*group, *axes).distinct(), [*group, *axes], "left_anti")


# Fixed value: the method name of runs without a baseline tag, also the kind of a sweep row.
DEFAULT_METHOD = "groupmix"


def with_method(df: DataFrame, tags: str = "tags", method: str = "method") -> DataFrame:
    """The existing method where set, else ``baseline`` if a tag contains it, else the default method."""
    derived = F.when(F.exists(tags, lambda t: t.contains("baseline")), "baseline").otherwise(DEFAULT_METHOD)
    return df.withColumn(method, F.coalesce(F.col(method), derived) if method in df.columns else derived)


def method_tables(df: DataFrame, group: Sequence[str] = ("model", "dataset", "method"), accuracy: Sequence[str] = ("top1_acc", "top5_acc"),
                  calibration_prefix: str = "ece/", extra: Sequence[str] = ("nll", "brier")) -> tuple[DataFrame, DataFrame]:
    """(accuracy table, calibration table) over seeds; calibration takes every ``ece/…`` column plus ``extra``."""
    acc = [m for m in accuracy if m in df.columns]
    cal = [m for m in df.columns if m.startswith(calibration_prefix)] + [m for m in extra if m in df.columns]
    return aggregate_over_seeds(df, group, acc), aggregate_over_seeds(df, group, cal)


def pivot_matrix(rows: DataFrame, index: str, columns: str, value: str, values: Sequence | None = None) -> DataFrame:
    """Cell means with sorted axes; giving ``values`` fixes the columns and saves a pass over the data."""
    wanted = list(values) if values is not None else distinct_values(rows, columns)
    return rows.groupBy(index).pivot(columns, wanted).agg(F.avg(value)).orderBy(index)


FLOAT32_MAX = 3.4028234663852886e38


def average_parameters(params: DataFrame, checkpoints: DataFrame, n: int, decreasing: bool = False) -> DataFrame:
    """Mean of each parameter over those of the ``n`` best checkpoints that have it.

    ``params`` is (ckpt, key, pos, value), ``checkpoints`` is (ckpt, metric, path); best is by (metric, path).
    """
    best = F.col("metric").asc() if decreasing else F.col("metric").desc()
    tie = F.col("path").asc() if decreasing else F.col("path").desc()
    chosen = checkpoints.where("metric IS NOT NULL").orderBy(best, tie).limit(n).select("ckpt")
    mean = F.avg(F.col("value").cast("double"))
    clamped = F.greatest(F.least(mean, F.lit(FLOAT32_MAX)), F.lit(-FLOAT32_MAX))
    return params.join(chosen, "ckpt", "left_semi").groupBy("key", "pos").agg(clamped.alias("value"), F.count(F.lit(1)).alias("copies"))


def merge_class_weights(slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per sample the class weights as MAP<STRING,DOUBLE> and the sorted distinct classes (at most k each)."""
    merged = slots.groupBy(*keys, "label").agg(F.sum("weight").alias("w"))
    pairs = F.sort_array(F.collect_list(F.struct("label", "w")))
    return merged.groupBy(*keys).agg(pairs.alias("_p")).select(
        *keys, F.map_from_entries(F.transform("_p", lambda p: F.struct(p["label"].cast("string"), p["w"]))).alias("weights"),
        F.transform("_p", lambda p: p["label"]).alias("present"))


def common_value(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """One row: number of distinct non-NULL values, and the value if there is exactly one (``strict``: else an error)."""
    out = df.agg(F.count_distinct(c(column)).alias("n_values"), F.min(c(column)).alias("low"))
    value = F.when(F.col("n_values") == 1, F.col("low"))
    if strict:
        value = F.when(F.col("n_values") == 1, F.col("low")).otherwise(F.raise_error(F.lit(f"{column} is not one common value")))
    return out.select(F.lit(column).alias("column"), "n_values", value.alias("value"))


def unique_key(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: distinct keys, duplicated keys and the rows they cover."""
    sizes = df.groupBy(*[c(x) for x in columns]).agg(F.count(F.lit(1)).alias("n"))
    repeated = F.col("n") > 1
    return sizes.agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_if(repeated).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(repeated, F.col("n"))), F.lit(0)).alias("duplicate_rows"))


def seed_set_consistency(df: DataFrame, group: Sequence[str], seed: str = "seed") -> DataFrame:
    """Seed sets in use and how many groups have each; one row means every group ran the same seeds."""
    sets = df.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_set(seed)), ",").alias("seeds"))
    return sets.groupBy("seeds").agg(F.count(F.lit(1)).alias("groups"))


def sensitivity_band(rows: DataFrame, axis: str, series: str, metric: str) -> DataFrame:
    """Median, minimum and maximum of the metric per series and axis value; every axis value appears for every series."""
    band = percentiles(rows, [series, axis], c(metric), {"median": 0.5}, {"lo": F.min(metric), "hi": F.max(metric)})
    spine = rows.select(series).distinct().withColumn(axis, F.explode(F.lit(distinct_values(rows, axis))))
    return spine.join(band, [series, axis], "left")


def robust_range(rows: DataFrame, keys: Sequence[str], value: Column, center: Column, q: float | None = 0.9,
                 min_half: float = 1.5, lower: float | None = None) -> DataFrame:
    """Display range around ``center`` (constant per group): half span = max(q-quantile of the deviations, ``min_half``),
    cut at ``lower``, with a flag if a value lies outside. A group without finite values gets center ± 1."""
    keys = list(keys)
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    data = rows.select(*keys, finite.alias("_x"), center.cast("double").alias("_c")).withColumn("_d", F.abs(F.col("_x") - F.col("_c")))
    ends = {"_lo": F.min("_x"), "_hi": F.max("_x"), "center": F.max("_c"), "_full": F.max("_d")}
    if q is not None:
        ends = percentiles(data, keys, F.col("_d"), {"_q": q}, ends)
    else:
        ends = data.groupBy(*keys).agg(*[v.alias(n) for n, v in ends.items()])
    half = F.greatest(F.col("_q") if q is not None else F.col("_full"), F.lit(float(min_half)), F.lit(1e-6))
    half = F.when(F.col("_full").isNull(), F.lit(1.0)).otherwise(half)
    low = F.col("center") - half
    low = F.greatest(low, F.lit(float(lower))) if lower is not None else low
    out = ends.withColumns({"vmin": low, "vmax": F.col("center") + half})
    outside = (F.col("_lo") < F.col("vmin")) | (F.col("_hi") > F.col("vmax"))
    return out.select(*keys, "center", "vmin", "vmax", F.coalesce(outside, F.lit(False)).alias("clipped"))
