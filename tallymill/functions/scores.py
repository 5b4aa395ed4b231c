"""Per-row score expressions over ``logits ARRAY<DOUBLE>``. All stay inside the row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def log_sum_exp(logits: Column) -> Column:
    """Shifted by the maximum, so large scores do not overflow."""
    top = F.array_max(logits)
    return top + F.ln(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def at(values: Column, index: Column) -> Column:
    """Zero-based element, NULL when out of range."""
    return F.when(index >= 0, F.try_element_at(values, index.cast("int") + 1))


def argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def in_top(values: Column, index: Column, k) -> Column:
    """Whether ``index`` is among the k best; equal scores rank by position. k is capped at the length."""
    score = at(values, index)
    ahead = F.size(F.filter(values, lambda x, i: (x > score) | ((x == score) & (i < index))))
    return (score.isNotNull()) & (ahead < F.least(F.lit(k), F.size(values)))


def log_softmax(logits: Column) -> Column:
    lse = log_sum_exp(logits)
    return F.transform(logits, lambda x: x - lse)


def with_scores(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Adds what every metric needs, each computed once: _lse, _pred, _conf, _nll, _p, _brier."""
    row, y = F.col(logits), F.col(label)
    lse, conf = F.col("_lse"), F.col("_conf")
    df = df.withColumn("_lse", log_sum_exp(row))
    df = df.withColumns({"_conf": F.exp(F.array_max(row) - lse), "_pred": argmax(row), "_nll": lse - at(row, y)})
    squares = F.aggregate(row, F.lit(0.0), lambda acc, x: acc + F.exp((x - lse) * 2))
    p_label = F.exp(-F.col("_nll"))
    return df.withColumns({"_p": p_label, "_brier": squares - p_label * 2 + 1})


def bin_of(conf: Column, bins: int) -> Column:
    """Equal-width bin of a value in [0, 1]; the last bin is closed."""
    return F.least(F.floor(conf * bins), F.lit(bins - 1)).cast("int")


def ranked_classes(values: Column, k: int) -> Column:
    """The k best entries as structs (score, class), best first, ties by lower class."""
    pairs = F.transform(values, lambda x, i: F.struct((-x).alias("neg"), i.alias("class")))
    top = F.slice(F.array_sort(pairs), 1, k)
    return F.transform(top, lambda s: F.struct((-s["neg"]).alias("score"), s["class"].alias("class")))


def restrict(values: Column, valid: list[int]) -> Column:
    """Only the listed entries, in the listed order."""
    return F.transform(F.lit(valid), lambda i: F.get(values, i))


# ---- losses over soft or mixed targets -------------------------------------------------------


def soft_cross_entropy(logits: Column, dense: Column) -> Column:
    return array_sum(F.zip_with(dense, log_softmax(logits), lambda t, lp: -t * lp))


def smoothed_cross_entropy(logits: Column, label: Column, smoothing: float) -> Column:
    lse = log_sum_exp(logits)
    nll = lse - at(logits, label)
    mean_nll = lse - array_sum(logits) / F.size(logits)
    return nll * (1 - smoothing) + mean_nll * smoothing


def target_weight(target: Column) -> Column:
    return F.aggregate(target, F.lit(0.0), lambda acc, s: acc + s["weight"])


def mixed_cross_entropy(logits: Column, target: Column) -> Column:
    """Sum of weight * nll over the slots of a sparse target."""
    lse = log_sum_exp(logits)
    return F.aggregate(target, F.lit(0.0), lambda acc, s: acc + (lse - at(logits, s["label"])) * s["weight"])


def ranked_loss(logits: Column, target: Column, alpha: float = 0.0, eps: float = 1e-12) -> Column:
    """Ranking loss over slots in ascending weight order.

    Slot i costs ``w_i * ((1 - alpha) * log(rest + p_1 + ... + p_i) - log p_i)``
    where rest is the mass outside the ranked classes. ``alpha=0`` is the pure
    ranking loss, ``alpha=1`` the mixed cross-entropy. Zero-weight slots are inert.
    """
    lse = log_sum_exp(logits)
    live = F.filter(target, lambda s: s["weight"] > 0)
    logp = F.transform(
        live, lambda s: F.struct(s["weight"].alias("weight"), (at(logits, s["label"]) - lse).alias("logp"))
    )
    ranked = F.aggregate(logp, F.lit(0.0), lambda acc, s: acc + F.exp(s["logp"]))
    rest = F.greatest(F.lit(1.0) - ranked, F.lit(0.0))
    start = F.struct(rest.alias("mass"), F.lit(0.0).alias("loss"))

    def step(acc, s):
        mass = acc["mass"] + F.exp(s["logp"])
        cost = F.ln(F.greatest(mass, F.lit(eps))) * (1 - alpha) - s["logp"]
        return F.struct(mass.alias("mass"), (acc["loss"] + cost * s["weight"]).alias("loss"))

    return F.aggregate(logp, start, step, lambda acc: acc["loss"])


def mean_over_valid(loss: Column, weight: Column) -> Column:
    """Sum of the loss over the number of rows that carry weight (at least 1)."""
    return F.sum(loss) / F.greatest(F.count_if(weight > 0), F.lit(1))
