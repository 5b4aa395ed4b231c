"""Quality classifier: quadratic discriminant with shrunk class covariances over transformed document statistics.

Statistics of the whole text (lengths, shares of capitals, symbols, digits and marks, variety of words, repeated lines)
are transformed to be roughly normal: logarithms of sizes, square roots of shares. Spark sums counts, first and second
moments per class over all labelled rows in one aggregation, so fitting reads every label and the driver sees a few
hundred numbers. Each class covariance is shrunk toward the pooled one and given a ridge of the pooled variances; its
Cholesky factor is computed once and kept in the model. The score is the logistic of the difference of the two log
densities (Mahalanobis distances in the factors' coordinates, plus log determinants) and class shares.

Defined cases: NULL and empty texts have all-zero statistics and get a score; several labels of one document all count;
labels without a document and NULL labels are ignored; a class with no label leaves the share of labels as everyone's
score (one half without any); repeated rows get equal scores; input columns named like an added one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallymill.llm.common import SPACES, bound, kept, without, words_of

SHRINK = 0.1
RIDGE = 0.01
CUT = 0.7


def statistics(text: Column) -> Column:
    """The transformed statistics as ``array<double>``."""
    value = F.coalesce(text, F.lit(""))
    share = lambda a, b: F.when(b > 0, F.sqrt(a / b)).otherwise(F.lit(0.0))
    among = lambda chars: F.length(F.regexp_replace(value, f"[^{chars}]+", ""))

    def of_words(w: Column) -> Column:
        n, chars = F.size(w), F.length(F.array_join(w, ""))
        return bound(F.array_distinct(w), lambda d: F.array(
            F.log1p(n), F.log1p(F.when(n > 0, chars / n).otherwise(0.0)),
            F.when(n > 1, F.log(F.size(d)) / F.log(n)).otherwise(F.lit(1.0)), F.log1p(F.coalesce(F.array_max(F.transform(d, F.length)), F.lit(0)))))

    def of_lines(x: Column) -> Column:
        n = F.size(x)
        return F.array(F.log1p(n), share(n - F.size(F.array_distinct(x)), n))

    lines = F.filter(F.split(value, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    size = F.length(value)
    shares = F.array(*[share(among(chars), size) for chars in ("A-Z", "#*$%&|<>", "!?", "0-9", ".,;:")])
    return F.concat(bound(words_of(value), of_words), bound(lines, of_lines), shares)


@dataclass
class Model:
    """Class shares, means and inverse Cholesky factors; ``factors`` is None without labels of both classes."""

    prior: float
    means: list[np.ndarray] | None = None
    factors: list[np.ndarray] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), self.prior)
        logs = []
        for mean, inverse in zip(self.means, self.factors):
            z = (x - mean) @ inverse.T
            logs.append(np.log(np.diag(inverse)).sum() - 0.5 * (z * z).sum(axis=1))
        margin = np.log(self.prior) - np.log1p(-self.prior) + logs[1] - logs[0]
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(examples: DataFrame, shrink: float = SHRINK, ridge: float = RIDGE) -> Model:
    """``examples`` has ``stats`` (array) and ``label`` (0 or 1)."""
    width = len(examples.first()["stats"]) if not examples.isEmpty() else 0
    if not width:
        return Model(0.5)
    at = [F.col("stats")[i] for i in range(width)]
    upper = [(i, j) for i in range(width) for j in range(i, width)]
    sums = examples.groupBy("label").agg(
        F.count("*").alias("n"), F.array(*[F.sum(x) for x in at]).alias("s"), F.array(*[F.sum(at[i] * at[j]) for i, j in upper]).alias("p")).collect()
    by_class = {r["label"]: r for r in sums}
    count = [by_class[k]["n"] if k in by_class else 0 for k in (0, 1)]
    prior = (count[1] + 1) / (sum(count) + 2)
    if not all(count):
        return Model(prior)
    means, covariances = [], []
    for k in (0, 1):
        row, second = by_class[k], np.zeros((width, width))
        mean = np.array(row["s"]) / row["n"]
        for (i, j), value in zip(upper, row["p"]):
            second[i, j] = second[j, i] = value / row["n"]
        means.append(mean)
        covariances.append(second - np.outer(mean, mean))
    pooled = sum(n * c for n, c in zip(count, covariances)) / sum(count)
    floor = np.diag(ridge * np.diag(pooled) + 1e-6)
    factors = [np.linalg.inv(np.linalg.cholesky((1 - shrink) * c + shrink * pooled + floor)) for c in covariances]
    return Model(prior, means, factors)


def _scorer(model: Model):
    def score(stats: pa.Array) -> pa.Array:
        if not len(stats):
            return pa.array([], pa.float64())
        return pa.array(model.score(stats.flatten().to_numpy(zero_copy_only=False).reshape(len(stats), -1)))

    return F.arrow_udf(score, "double")


def score_quality(
    docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", cut: float = CUT, **options,
) -> DataFrame:
    """``docs`` without ``text``, with ``score`` and ``predicted``; ``learn`` says which rows' labels may be used."""
    measured = kept(without(docs, "score", "predicted", "__stats").withColumn("__stats", statistics(F.col(f"`{text}`"))).drop(text), "statistics")
    known = labels.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("label")).where("label IN (0, 1)")
    examples = measured.where(learn).join(known, F.col(f"`{doc_id}`") == F.col("__id")).select(F.col("__stats").alias("stats"), "label")
    model = fit(kept(examples, "examples"), **options)
    scored = measured.withColumn("score", _scorer(model)("__stats")).drop("__stats")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
