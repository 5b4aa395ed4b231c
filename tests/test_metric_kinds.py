"""Metrics that are no sums, against brute force, alone and beside the sums, with whole and with cut groups."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.operators import aggregates as G
from tallymill.operators import metrics as M
from tallymill.operators.metric_kinds import RankArea, Shape, UserAggregate

KINDS = ["class_acc", "median_nll", "auroc", "nll_shape"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(9)
    rows = [(f"m{i % 3}", [round(float(x), 1) for x in rng.normal(size=5)], int(rng.integers(5))) for i in range(240)]
    return [*rows, ("lone", [1.0, 0.0, 0.0, 0.0, 0.0], 0), *rows[:30]]


def area(score, hit):
    pairs = [(a > b) + (a == b) / 2 for a, x in zip(score, hit) if x for b, y in zip(score, hit) if not y]
    return sum(pairs) / len(pairs) if pairs else None


def brute(rows):
    z = np.array([r[1] for r in rows])
    y = np.array([r[2] for r in rows])
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    nll, hit = -np.log(p[np.arange(len(y)), y]), z.argmax(1) == y
    sd, m = nll.std(), nll.mean()
    return {"class_acc": np.mean([hit[y == c].mean() * 100 for c in set(y.tolist())]), "median_nll": statistics.median(nll),
            "auroc": area(np.round(p.max(1), 9).tolist(), hit.tolist()), "nll_shape/mean": m, "nll_shape/std": nll.std(ddof=1) if len(y) > 1 else None,
            "nll_shape/skew": ((nll - m) ** 3).mean() / sd ** 3 if sd > 1e-12 else None, "top1_acc": hit.mean() * 100}


def checked(spark, data):
    df = spark.createDataFrame(data, "model string, logits array<double>, label int").repartition(7)
    got = {}
    for r in M.REGISTRY.evaluate(df, ["model"], ["top1_acc", *KINDS]).collect():
        got.setdefault(r["model"], {})[r["metric"]] = r["value"]
    for model in {r[0] for r in data}:
        want = brute([r for r in data if r[0] == model])
        assert set(got[model]) == set(want)
        for name, value in want.items():
            assert got[model][name] == (None if value is None else pytest.approx(value, abs=1e-6)), (model, name)


def test_kinds_beside_sums(spark, data):
    checked(spark, data)


def test_kinds_in_cells(spark, data, small_cells):
    checked(spark, data)


def test_no_group_and_no_rows(spark, data):
    df = spark.createDataFrame(data, "model string, logits array<double>, label int")
    got = {r["metric"]: r["value"] for r in M.REGISTRY.evaluate(df, [], KINDS).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in brute(data).items() if k != "top1_acc"}
    assert M.REGISTRY.evaluate(df.where("false"), ["model"], KINDS).collect() == []


def test_states_merge_in_any_order():
    rng = np.random.default_rng(1)
    x = rng.gamma(2.0, size=500) + 1e6
    shape = Shape()
    states = [shape.update(None, {"x": part}) for part in np.array_split(x, 7)] + [shape.update(None, {"x": np.array([math.nan])})]
    left = states[0]
    for s in states[1:]:
        left = shape.merge(left, s)
    right = states[-1]
    for s in reversed(states[:-1]):
        right = shape.merge(s, right)
    once = shape.finish(shape.update(shape.update(None, {"x": x[:100]}), {"x": x[100:]}))
    for got in (shape.finish(left), shape.finish(right), once):
        assert got["mean"] == pytest.approx(x.mean()) and got["std"] == pytest.approx(x.std(ddof=1), rel=1e-6)
        assert got["skew"] == pytest.approx(((x - x.mean()) ** 3).mean() / x.std() ** 3, rel=1e-4)


def test_user_registers_own_kinds(spark):
    class Longest:
        def update(self, state, values):
            return max(state or b"", b"%020d" % int(np.nanmax(values["n"])))

        def merge(self, a, b):
            return max(a, b)

        def finish(self, state):
            return float(state)

    registry = M.MetricRegistry()
    registry.register("longest")(lambda: UserAggregate({"n": F.size("logits")}, Longest))
    registry.register("order")(lambda: RankArea(F.col("_conf"), F.col("label") == 1))
    df = spark.createDataFrame([(None, [0.0, 3.0], 1), (None, [1.0, 0.0, 0.5], 0), ("b", [0.0, 1.0], 1)], "model string, logits array<double>, label int")
    got = {(r["model"], r["metric"]): r["value"] for r in registry.evaluate(df, ["model"]).collect()}
    assert got == {(None, "longest"): 3.0, ("b", "longest"): 2.0, (None, "order"): 1.0, ("b", "order"): None}


def test_groups_beyond_the_held_states(spark, monkeypatch):
    from tallymill.operators import metric_kinds

    df = spark.range(50_000).select((F.col("id") % 20_011).alias("g"), F.col("id").cast("double").alias("x"))
    got = UserAggregate({"x": F.col("x")}, Shape).table(df, ["g"], "s").where("metric = 's/mean'")
    want = df.groupBy("g").agg(F.avg("x").alias("want"))
    assert metric_kinds.HELD_STATES < 20_011
    assert got.join(want, "g").where("abs(value - want) < 1e-6").count() == 20_011


def test_sketches_keep_their_rank_error(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("day"), F.when(F.col("id") % 11 > 0, F.pow(F.rand(4), 3)).alias("x"))
    df = df.union(spark.createDataFrame([(9, 0, None)], "g long, day long, x double")).cache()
    levels = {f"p{int(100 * p):02d}": p for p in (0.01, 0.25, 0.5, 0.95, 0.99)}
    daily = G.quantile_sketches(df, ["g", "day"], F.col("x"), 0.004)
    found = G.sketch_quantiles(G.merge_sketches(daily, ["g"], 0.004), ["g"], levels).cache()
    n = {r["g"]: r["n"] for r in found.collect()}
    assert n == {r["g"]: r["n"] for r in df.groupBy("g").agg(F.count("x").alias("n")).collect()}
    assert all(r[c] is None for r in found.where("g = 9").collect() for c in levels)
    errors = G.rank_errors(df, found, ["g"], F.col("x"), levels).collect()
    assert len(errors) == 15 and max(r["error"] for r in errors) <= 0.005
    wrong = found.withColumn("p50", F.col("p99"))
    assert min(r["error"] for r in G.rank_errors(df, wrong, ["g"], F.col("x"), {"p50": 0.5}).collect()) > 0.4
    with pytest.raises(ValueError):
        G.sketch_size(1e-9)
