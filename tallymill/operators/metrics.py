"""Prediction-table metrics: grouped aggregations over per-row scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.functions import scores
from tallymill.operators.metric_kinds import PerClass, Quantile, RankArea, Shape, UserAggregate
from tallymill.plans.indexing import Order, Running, running

CALIBRATION_BINS = (5, 10, 15, 20)


@dataclass(frozen=True)
class Metric:
    """A metric made of per-row sums.

    ``sums`` maps a name to a per-row column to be added up; ``finish`` turns
    the totals (as columns, plus ``n``) into one value or a dict of sub-values.
    With ``bins`` the finish is the calibration gap of each bin count.
    """

    sums: dict[str, Column] = field(default_factory=dict)
    finish: Callable[[dict[str, Column]], Column | dict[str, Column]] | None = None
    bins: tuple[int, ...] = ()
    scale: float = 1.0


Kind = Metric | PerClass | Quantile | RankArea | UserAggregate


class MetricRegistry:
    """Named metrics; duplicates and unknown names are errors."""

    def __init__(self):
        self._metrics: dict[str, Callable[[], Kind]] = {}

    def register(self, name: str):
        def wrap(factory: Callable[[], Kind]):
            if name in self._metrics:
                raise ValueError(f"metric {name!r} is already registered")
            self._metrics[name] = factory
            return factory

        return wrap

    def names(self) -> list[str]:
        return sorted(self._metrics)

    def get(self, name: str) -> Kind:
        if name not in self._metrics:
            raise KeyError(f"unknown metric {name!r}; known: {self.names()}")
        return self._metrics[name]()

    def evaluate(self, df: DataFrame, group: Sequence[str], names: Sequence[str] | None = None,
                 logits: str = "logits", label: str = "label") -> DataFrame:
        """Long table (group..., metric, value). Metrics of sums scan and shuffle the predictions once.

        Their first aggregation is by group and by the combination of confidence
        bins, which leaves at most a few dozen rows per group whatever the
        data size; every metric is finished from those rows. Metrics of other
        kinds add a plan each over the same scored rows.
        """
        # Factories name the columns ``logits`` and ``label``.
        df = df.withColumns({k: F.col(f"`{v}`") for k, v in (("logits", logits), ("label", label)) if k != v})
        logits, label = "logits", "label"
        chosen = {n: self.get(n) for n in (names or self.names())}
        group = list(group)
        others = {n: m for n, m in chosen.items() if not isinstance(m, Metric)}
        if others:
            rows = scores.with_scores(df, logits, label)
            tables = [m.table(rows, group, n) for n, m in others.items()]
            summed = [n for n in chosen if n not in others]
            out = self.evaluate(df, group, summed, logits, label) if summed else tables.pop(0)
            for table in tables:
                out = out.unionByName(table)
            return out
        bins = sorted({b for m in chosen.values() for b in m.bins})
        scored = scores.with_scores(df, logits, label).withColumns(
            {f"_b{b}": scores.bin_of(F.col("_conf"), b) for b in bins} or {"_none": F.lit(0)}
        )
        sums = {"n": F.lit(1), "conf": F.col("_conf"), "hit": (F.col("_pred") == F.col(label)).cast("double")}
        for name, metric in chosen.items():
            sums.update({f"{name}.{k}": v for k, v in metric.sums.items()})
        bin_cols = [f"_b{b}" for b in bins]
        cells = scored.groupBy(*group, *bin_cols).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
        # One chain from the cells: a row per (group, bin count, bin) plus the entry 0 that carries the totals.
        spread = F.array(*[F.struct(F.lit(b).alias("_bins"), F.col(f"_b{b}").alias("_bin")) for b in bins],
                         F.struct(F.lit(0).alias("_bins"), F.lit(0).alias("_bin")))
        per_bin = cells.select(*group, F.inline(spread), *[f"`{k}`" for k in sums]).groupBy(*group, "_bins", "_bin").agg(
            *[F.sum(f"`{k}`").alias(k) for k in sums])
        totals = per_bin.groupBy(*group, "_bins").agg(
            (F.sum(F.abs(F.col("hit") - F.col("conf"))) / F.sum("n")).alias("_gap"), *[F.sum(f"`{k}`").alias(k) for k in sums])
        entries = []
        for name, metric in chosen.items():
            for b in metric.bins:
                label_ = f"{name}/n_bins={b}" if len(metric.bins) > 1 else name
                entries.append((b, label_, F.col("_gap") * metric.scale))
            if metric.finish is not None:
                value = metric.finish({"n": F.col("n"), **{k: F.col(f"`{name}.{k}`") for k in metric.sums}})
                named = {f"{name}/{k}": v for k, v in value.items()} if isinstance(value, dict) else {name: value}
                entries += [(0, k, v) for k, v in named.items()]
        rows = F.array(*[
            F.struct(F.lit(b).alias("bins"), F.lit(k).alias("metric"), v.cast("double").alias("value")) for b, k, v in entries])
        out = totals.select(*group, "_bins", F.inline(rows))
        return out.where(F.col("bins") == F.col("_bins")).select(*group, "metric", "value")


def bin_gaps(cells: DataFrame, group: list[str], bins: Sequence[int]) -> DataFrame:
    """Calibration gap per group and bin count from rows that carry n, conf, hit and ``_b<bins>``."""
    pairs = F.array(*[F.struct(F.lit(b).alias("bins"), F.col(f"_b{b}").alias("bin")) for b in bins])
    per_bin = (
        cells.select(*group, "n", "conf", "hit", F.inline(pairs))
        .groupBy(*group, "bins", "bin")
        .agg(F.sum("n").alias("n"), F.sum("conf").alias("conf"), F.sum("hit").alias("hit"))
    )
    # sum over bins of n_b/N * |acc_b - conf_b| = sum |hits_b - conf_b| / N
    return per_bin.groupBy(*group, "bins").agg((F.sum(F.abs(F.col("hit") - F.col("conf"))) / F.sum("n")).alias("gap"))


REGISTRY = MetricRegistry()
register_metric = REGISTRY.register


def _topk(k: int) -> Metric:
    hit = scores.in_top(F.col("logits"), F.col("label"), k).cast("double")
    return Metric({"hit": hit}, lambda s: s["hit"] / s["n"] * 100)


register_metric("top1_acc")(lambda: _topk(1))
register_metric("top5_acc")(lambda: _topk(5))

def _mean(score: str) -> Metric:
    """Mean of a score over the rows that have one: a missing label counts in neither sum."""
    value = F.col(score)
    return Metric({"sum": value, "rows": value.isNotNull().cast("double")}, lambda s: s["sum"] / F.nullif(s["rows"], F.lit(0.0)))


register_metric("nll")(lambda: _mean("_nll"))
register_metric("brier")(lambda: _mean("_brier"))
register_metric("ece")(lambda: Metric(bins=CALIBRATION_BINS))


def _hit() -> Column:
    return F.col("_pred") == F.col("label")


register_metric("class_acc")(lambda: PerClass({"hit": _hit().cast("double")}, lambda s: s["hit"] / s["n"] * 100))
register_metric("median_nll")(lambda: Quantile(F.col("_nll"), 0.5))
# Confidences that agree to nine digits tie, as the last bits of a softmax depend on the order of its sum.
register_metric("auroc")(lambda: RankArea(F.round("_conf", 9), _hit()))
register_metric("nll_shape")(lambda: UserAggregate({"x": F.col("_nll")}, Shape))


def topk_accuracy(df: DataFrame, group: Sequence[str], ks: Sequence[int] = (1, 5)) -> DataFrame:
    """Percent of rows whose label is among the k best scores, one column per k."""
    hits = [
        (F.avg(scores.in_top(F.col("logits"), F.col("label"), k).cast("double")) * 100).alias(f"top{k}_acc") for k in ks
    ]
    return df.groupBy(*group).agg(*hits)


def mean_nll(df: DataFrame, group: Sequence[str]) -> DataFrame:
    row = F.col("logits")
    return df.groupBy(*group).agg(F.avg(scores.log_sum_exp(row) - scores.at(row, F.col("label"))).alias("nll"))


def mean_brier(df: DataFrame, group: Sequence[str]) -> DataFrame:
    return scores.with_scores(df).groupBy(*group).agg(F.avg("_brier").alias("brier"))


def binned(df: DataFrame, group: Sequence[str], bins: Sequence[int], label: str = "label") -> DataFrame:
    scored = scores.with_scores(df, label=label).withColumns({f"_b{b}": scores.bin_of(F.col("_conf"), b) for b in bins})
    return scored.groupBy(*group, *[f"_b{b}" for b in bins]).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_conf").alias("conf"),
        F.sum((F.col("_pred") == F.col(label)).cast("double")).alias("hit"),
    )


def calibration_error(df: DataFrame, group: Sequence[str], bins: Sequence[int] = CALIBRATION_BINS) -> DataFrame:
    """Calibration error as a fraction, one row per group and bin count."""
    return bin_gaps(binned(df, group, bins), list(group), bins).withColumnRenamed("gap", "ece")


def calibration_meter(df: DataFrame, group: Sequence[str], soft_labels: str | None = None, bins: int = 15) -> DataFrame:
    """Calibration error in percent. Soft labels are first reduced to their argmax."""
    if soft_labels:
        df = df.withColumn("label", scores.argmax(F.col(soft_labels)))
    gaps = bin_gaps(binned(df, group, [bins]), list(group), [bins])
    return gaps.select(*group, (F.col("gap") * 100).alias("ece_percent"))


def reliability(df: DataFrame, group: Sequence[str], bins: int = 15) -> DataFrame:
    """Every bin of every group: centre, accuracy (NULL when empty) and share of the rows."""
    group = list(group)
    cells = binned(df, group, [bins]).withColumnRenamed(f"_b{bins}", "bin")
    filled = cells.groupBy(*group).agg(
        F.sum("n").alias("_total"),
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "hit")))).alias("_bins"),
    )
    spine = filled.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    cell = F.try_element_at(F.col("_bins"), F.col("bin"))
    return spine.select(
        *group, "bin", ((F.col("bin") + 0.5) / bins).alias("center"), (cell["hit"] / cell["n"]).alias("accuracy"),
        (F.coalesce(cell["n"], F.lit(0)) / F.col("_total")).alias("fraction"),
    )


def multi_label_accuracy(preds: DataFrame, labels: DataFrame, group: Sequence[str], k: int,
                         path: str = "path", label_set: str = "labels") -> DataFrame:
    """Percent of samples with any of the k best classes in their label set; empty sets are left out."""
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    sets = labels.where(F.size(label_set) > 0).select(base(F.col(path)).alias("_base"), F.col(label_set).alias("_set"))
    top = F.transform(scores.ranked_classes(F.col("logits"), k), lambda s: s["class"].cast("int"))
    joined = preds.withColumns({"_base": base(F.col(path)), "_top": top}).join(sets, "_base")
    hit = F.arrays_overlap("_top", "_set").cast("double")
    return joined.groupBy(*group).agg((F.avg(hit) * 100).alias(f"real_top{k}"), F.count(F.lit(1)).alias("n"))


def restrict_classes(df: DataFrame, valid: list[int]) -> DataFrame:
    """Scores of the listed classes only; labels become positions in the list, other labels drop out."""
    position = F.array_position(F.lit(valid), F.col("label")) - 1
    out = df.withColumns({"logits": scores.restrict(F.col("logits"), valid), "label": position.cast("int")})
    return out.where("label >= 0")


def topk_predictions(df: DataFrame, keys: Sequence[str], k: int, probabilities: bool = False) -> DataFrame:
    """One row per key and rank with class and score."""
    top = scores.ranked_classes(F.col("logits"), k)
    if probabilities:
        df = df.withColumn("_lse", scores.log_sum_exp(F.col("logits")))
        top = F.transform(top, lambda s: F.struct(F.exp(s["score"] - F.col("_lse")).alias("score"), s["class"].alias("class")))
    return df.select(*keys, F.posexplode(top).alias("rank", "_s")).select(
        *keys, (F.col("rank") + 1).alias("rank"), F.col("_s.class").cast("int").alias("class"), F.col("_s.score").alias("score")
    )


def average_copies(df: DataFrame, source: Column, num_classes: int, order: str = "vec_id") -> DataFrame:
    """Element-wise mean score over the augmented copies of a sample, keeping the label of the copy first by ``order``."""
    return df.groupBy(source.alias("source_id")).agg(
        F.array(*[F.avg(F.col("logits")[i]) for i in range(num_classes)]).alias("logits"),
        F.min_by("label", order).alias("label"), F.count(F.lit(1)).alias("copies"),
    )


def weighted_meter(df: DataFrame, keys: Sequence[str], value: Column, weight: Column, order: Column | None = None) -> DataFrame:
    """Weighted average and total weight per run; with ``order`` also the last value."""
    parts = [(F.sum(value * weight) / F.sum(weight)).alias("avg"), F.sum(weight).alias("count")]
    if order is not None:
        parts.append(F.max_by(value, order).alias("val"))
    return df.groupBy(*keys).agg(*parts)


def running_meter(df: DataFrame, keys: Sequence[str], order: Order, value: Column, weight: Column) -> DataFrame:
    """The meter's average after each row of a run; long runs are cut into cells."""
    out = running(df, keys, order, {"_vw": Running("sum", value * weight), "_w": Running("sum", weight)})
    return out.withColumn("avg", F.col("_vw") / F.col("_w")).drop("_vw", "_w")


def area_score_metrics(samples: DataFrame, k_allowed: Sequence[int] = (3, 4, 5, 6), min_area_diff: float = 0.05) -> DataFrame:
    """How well class scores follow class areas, per model and k plus a level over all k.

    Input rows: model, k, present ARRAY<STRUCT<label, area, score>>. A sample
    holds at most max(k) classes, so ranks and pairs are compared inside the
    row; the only shuffle is the final aggregation.
    """
    present = F.col("present")
    n = F.size(present)
    areas = F.transform(present, lambda s: s["area"])
    marks = F.transform(present, lambda s: s["score"])
    tied = (F.size(F.array_distinct(areas)) < n) | (F.size(F.array_distinct(marks)) < n)

    def rank_gap(s):
        by_area = F.size(F.filter(areas, lambda a: a < s["area"]))
        by_score = F.size(F.filter(marks, lambda x: x < s["score"]))
        return ((by_area - by_score) * (by_area - by_score)).cast("double")

    squares = F.aggregate(F.transform(present, rank_gap), F.lit(0.0), lambda acc, x: acc + x)
    rho = F.when((n >= 2) & ~tied, F.lit(1.0) - squares * 6 / (n * (n * n - 1)))
    # Each unordered pair appears once, from its larger-area side.
    smaller = F.flatten(F.transform(present, lambda a: F.transform(
        F.filter(present, lambda b: a["area"] - b["area"] >= min_area_diff), lambda b: a["score"] > b["score"])))
    top_area = F.array_max(areas)
    top_score = F.array_max(marks)
    unique_top = F.size(F.filter(areas, lambda a: a == top_area)) == 1
    first_best = F.filter(present, lambda s: s["score"] == top_score)[0]
    rows = samples.where(F.col("k").isin(list(k_allowed))).select(
        "model", F.col("k").cast("string").alias("k"), rho.alias("rho"),
        F.size(F.filter(smaller, lambda x: x)).alias("pair_ok"), F.size(smaller).alias("pairs"),
        F.when((n > 0) & unique_top, (first_best["area"] == top_area).cast("int")).alias("top_ok"),
    )
    # One shuffle to (model, k), then the extra level from those few rows.
    per_k = rows.groupBy("model", "k").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("rho").alias("rho"), F.count("rho").alias("spearman_n"),
        F.sum("pair_ok").alias("pair_ok"), F.sum("pairs").alias("pair_n"),
        F.sum("top_ok").alias("top_ok"), F.count("top_ok").alias("top_n"),
    )
    sums = ["n_samples", "rho", "spearman_n", "pair_ok", "pair_n", "top_ok", "top_n"]
    levels = F.array(*[F.lit(str(k)) for k in sorted(k_allowed)], F.lit("all"))
    spine = per_k.withColumn("level", F.explode(levels))
    mine = (F.col("level") == "all") | (F.col("level") == F.col("k"))
    out = spine.groupBy("model", "level").agg(*[F.sum(F.when(mine, F.col(c))).alias(c) for c in sums])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select(
        "model", F.col("level").alias("k"), zero("n_samples"), ratio("rho", "spearman_n").alias("spearman_mean"),
        zero("spearman_n"), ratio("pair_ok", "pair_n").alias("pair_acc"), zero("pair_n"),
        ratio("top_ok", "top_n").alias("top_acc"), zero("top_n"),
    )


def present_classes(slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums slot weights by class and collects them, ordered by class (at most k per sample)."""
    merged = slots.groupBy(*keys, "label").agg(F.sum("weight").alias("area"))
    return merged.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("label", "area"))).alias("present"))


def with_class_scores(present: Column, logits: Column) -> Column:
    return F.transform(present, lambda s: F.struct(
        s["label"].alias("label"), s["area"].alias("area"), scores.at(logits, s["label"]).alias("score")))


def class_probability(wanted: DataFrame, preds: DataFrame, keys: Sequence[str], cls: str = "class") -> DataFrame:
    """Softmax value of one given class per row; NULL when the sample or the class is absent."""
    logits = F.col("logits")
    side = preds.select(*keys, "logits")
    joined = wanted.join(side, list(keys), "left")
    value = scores.at(logits, F.col(cls))
    return joined.withColumn("probability", F.exp(value - scores.log_sum_exp(logits))).drop("logits")


def linear_scores(features: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """Scores of a linear model as a Column: one dot product per class."""
    outs = []
    for i, row in enumerate(weights):
        dot = scores.array_sum(F.zip_with(features, F.lit([float(w) for w in row]), lambda x, w: x * w))
        outs.append(dot + float(bias[i]) if bias else dot)
    return F.array(*outs)


def batch_score(df: DataFrame, features: str, make_predict: Callable, num_classes: int, dim: int,
                batch_size: int = 4096) -> DataFrame:
    """Adds ``logits`` from a model loaded once per Python worker and fed Arrow batches.

    ``make_predict`` returns a function from an (n, dim) array to an (n, num_classes) array.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    udf = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size, input_tensor_shapes=[[dim]])
    return df.withColumn("logits", F.transform(udf(F.col(features)), lambda x: x.cast("double")))
