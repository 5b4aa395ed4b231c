import pytest
from pyspark.sql import functions as F

from tallymill.functions import names
from tallymill.operators import aggregates as G
from tallymill.operators import ranking as W


@pytest.fixture
def evals(spark):
    rows = []
    for recipe, base in (("bare_cutmix=0_mixup=0", 77.0), ("cutmix_mixup_switch_prob=1.0", 75.0)):
        for i, seed in enumerate((42, 43, 44)):
            rows.append((f"vit__in1k__{recipe}__seed={seed}", "vit", "in1k", seed, base + i))
    return spark.createDataFrame(rows, "name string, model string, dataset string, seed int, top1_acc double")


def typed(df):
    return df.withColumns({"type": names.canonical_type(F.col("name")), "long_horizon": names.is_long_horizon(F.col("name"))})


def test_aggregate_by_type_pins(evals):
    out = {r["type"]: r for r in G.aggregate_by_type(typed(evals), ["top1_acc"]).collect()}
    assert out["bare"]["top1_acc_mean"] == 78 and out["bare"]["top1_acc_std"] == 1 and out["bare"]["n_seeds"] == 3
    assert out["cutmix"]["top1_acc_mean"] == 76 and out["cutmix"]["status"] == "complete" and out["cutmix"]["seeds_present"] == "42,43,44"


def test_unfinished_groups_are_split_off(evals):
    agg = G.aggregate_by_type(typed(evals.where("NOT (seed = 44 AND top1_acc > 78)")), ["top1_acc"])
    short, long, unfinished = G.split_by_horizon(agg)
    assert [r["type"] for r in short.collect()] == ["cutmix"] and long.count() == 0
    row = unfinished.first()
    assert row["missing_seeds"] == "44" and row["n_seeds"] == 2


def test_missing_identity_columns_are_an_error(evals):
    with pytest.raises(ValueError):
        G.aggregate_by_type(evals, ["top1_acc"])
    with pytest.raises(ValueError):
        G.aggregate_by_type(typed(evals), ["absent"])


def test_null_keys_form_a_group_and_one_value_has_no_deviation(spark):
    df = spark.createDataFrame([("a", 1, 1.0), (None, 1, 2.0), (None, 2, 4.0)], "k string, seed int, m double")
    out = {r["k"]: r for r in G.aggregate_over_seeds(df, ["k"]).collect()}
    assert out[None]["m_mean"] == 3 and out[None]["n_seeds"] == 2
    assert out["a"]["m_std"] is None


def test_ci_needs_two_values(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 4)], "s double, n int")
    assert [r[0] for r in df.select(G.confidence_95(F.col("s"), F.col("n"))).collect()] == [None, pytest.approx(1.96)]


def test_last_eval_takes_last_parsable_line(spark):
    lines = spark.createDataFrame([
        ("r1", "m", 1, 1, '{"AP": 1.0}'), ("r1", "m", 1, 2, '{"AP": 3.0}'), ("r1", "m", 1, 3, "{broken"), ("r1", "m", 1, 4, '{"lr": 1}'),
        ("r2", "m", 1, 1, '{"AP": 5.0}')], "run string, model string, seed int, line_no int, text string")
    row = G.last_eval_summary(lines, ["AP"], "AP", ["model"]).first()
    assert row["AP_mean"] == 4 and row["n_seeds"] == 2 and row["seeds"] == "1,1"


def test_natural_stats_pins(spark):
    df = spark.createDataFrame([(c,) for c, n in (("a", 5), ("b", 4), ("c", 3), ("d", 2)) for _ in range(n)], "label string")
    row = G.natural_stats(df, "label", 3).first()
    assert (row["mixed_primary"], row["single_primary"], row["total_primary"]) == (11, 3, 14)
    assert (row["mixed_rows"], row["single_rows"], row["padded_groups"], row["remainder_outputs"]) == (3, 2, 2, 2)


def test_latency_profile_drops_first_and_warm_up(spark):
    df = spark.createDataFrame([("a", i, float(i), 10) for i in range(1, 7)], "c string, batch_no int, seconds double, items int")
    row = G.latency_profile(df, ["c"], warmup=2).first()
    assert row["first_batch_seconds"] == 1 and row["measured"] == 3 and row["p50_seconds"] == 5
    assert row["items_per_second"] == pytest.approx(30 / 15)


def test_robust_range(spark):
    df = spark.createDataFrame([("g", float(v)) for v in range(11)] + [("n", float("nan"))], "k string, v double")
    out = {r["k"]: r for r in G.robust_range(df, ["k"], F.col("v"), F.lit(5.0), 0.5, 0.5, 3.0).collect()}
    assert out["g"]["vmin"] == 3.0 and out["g"]["vmax"] == 8.0 and out["g"]["clipped"]
    assert out["n"]["vmax"] == 6.0 and not out["n"]["clipped"]


def test_average_parameters_only_over_holders_of_a_key(spark):
    params = spark.createDataFrame([("c1", "w", 0, 1.0), ("c2", "w", 0, 3.0), ("c3", "w", 0, 100.0), ("c2", "b", 0, 7.0), ("c1", "h", 0, 1e39)], "ckpt string, key string, pos int, value double")
    ckpts = spark.createDataFrame([("c1", 0.9, "p1"), ("c2", 0.8, "p2"), ("c3", 0.1, "p3")], "ckpt string, metric double, path string")
    out = {(r["key"], r["pos"]): r["value"] for r in G.average_parameters(params, ckpts, 2).collect()}
    assert out[("w", 0)] == 2 and out[("b", 0)] == 7 and out[("h", 0)] == G.FLOAT32_MAX


def test_quality_checks(spark):
    df = spark.createDataFrame([("m", 1), ("m", 2), ("n", 1)], "model string, seed int")
    assert G.common_value(df, "model").first()["n_values"] == 2
    with pytest.raises(Exception):
        G.common_value(df, "model", strict=True).collect()
    assert G.unique_key(df, ["model"]).first()["duplicate_rows"] == 2
    assert {r["seeds"]: r["groups"] for r in G.seed_set_consistency(df, ["model"]).collect()} == {"1,2": 1, "1": 1}


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 1.0), ("g", "c", 0.0)], "g string, item string, v double")
    assert {r["item"]: r["mean_rank"] for r in W.average_rank(df, ["g"], "item", F.col("v")).collect()} == {"a": 1.5, "b": 1.5, "c": 3.0}


def test_best_flags_all_ties_and_delta(spark):
    df = spark.createDataFrame([("g", "base", 1.0), ("g", "x", 2.0), ("g", "y", 2.0)], "g string, m string, v double")
    out = {r["m"]: r for r in W.best_and_delta(df, ["g"], "m", {"v": True}, "base").collect()}
    assert out["x"]["v_best"] and out["y"]["v_best"] and not out["base"]["v_best"] and out["x"]["v_delta"] == 1


def test_robustness_diff(spark):
    schema = "model string, img_size int, top1 double, top5 double"
    base = spark.createDataFrame([("a", 224, 80.0, 95.0), ("b", 224, 70.0, 90.0)], schema)
    test = spark.createDataFrame([("a", 224, 60.0, 85.0), ("b", 224, 65.5, 91.0), ("c", 224, 10.0, 20.0)], schema)
    out = {r["model"]: r for r in W.robustness_diff(base, test).collect()}
    assert out["b"]["rank_diff"] == "+1" and out["a"]["rank_diff"] == "-1" and out["c"]["rank_diff"] == ""
    assert out["b"]["top1_diff"] == "-4.500" and out["b"]["top5_diff"] == "+1.000" and out["c"]["top1_diff"] == ""


def test_relative_needs_one_reference(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "k string, v double")
    assert [r["reduction_percent"] for r in W.relative_to_reference(df, F.col("k") == "a", "v").orderBy("k").collect()] == [0.0, 50.0]
    with pytest.raises(ValueError):
        W.relative_to_reference(df, F.col("v") > 0, "v")


@pytest.mark.parametrize("decreasing", [False, True])
def test_best_checkpoints_equal_stepwise_eviction(spark, small_cells, decreasing):
    import random

    rng = random.Random(5)
    rows = [("r", i, rng.choice([1.0, 2.0, 3.0, 4.0, 5.0])) for i in range(25)]
    out = W.best_checkpoints(spark.createDataFrame(rows, "run string, step int, m double"), "run", "step", "m", 3, decreasing).collect()
    kept, best, flags = [], None, {}
    better = (lambda a, b: a < b) if decreasing else (lambda a, b: a > b)
    for _, step, m in rows:
        flags[step] = best is None or better(m, best)
        best = m if flags[step] else best
        if len(kept) < 3 or better(m, kept[-1][1]):
            kept = kept[:2] if len(kept) >= 3 else kept
            kept.append((step, m))
            kept.sort(key=lambda p: p[1], reverse=not decreasing)
    assert {r["step"] for r in out if r["retained"]} == {s for s, _ in kept}
    assert {r["step"]: r["is_best"] for r in out} == flags


def test_preferred_order(spark):
    df = spark.createDataFrame([("b",), ("z",), ("a",), ("m",)], "v string")
    assert [r["v"] for r in W.preferred_order(df, "v", ["z", "q", "m"]).orderBy("place").collect()] == ["z", "m", "a", "b"]
