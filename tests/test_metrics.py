import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.functions import scores
from tallymill.operators import metrics as M


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    return [(i, f"m{i % 2}", [float(x) for x in rng.normal(size=6)], int(rng.integers(6))) for i in range(120)]


@pytest.fixture
def preds(spark, data):
    return spark.createDataFrame(data, "vec_id long, model string, logits array<double>, label int")


def brute(rows):
    logits = np.array([r[2] for r in rows])
    y = np.array([r[3] for r in rows])
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    out = {"top1_acc": (logits.argmax(1) == y).mean() * 100, "nll": -np.log(p[np.arange(len(y)), y]).mean()}
    hot = np.eye(6)[y]
    out["brier"] = ((p - hot) ** 2).sum(1).mean()
    ranks = (logits > logits[np.arange(len(y)), y][:, None]).sum(1)
    out["top5_acc"] = (ranks < 5).mean() * 100
    conf, hit = p.max(1), logits.argmax(1) == y
    for bins in (5, 10, 15, 20):
        b = np.minimum((conf * bins).astype(int), bins - 1)
        out[f"ece/n_bins={bins}"] = sum(
            (b == i).mean() * abs(hit[b == i].mean() - conf[b == i].mean()) for i in range(bins) if (b == i).any())
    return out


def test_registry_equals_brute_force(preds, data):
    got = {(r["model"], r["metric"]): r["value"] for r in M.REGISTRY.evaluate(preds, ["model"]).collect()}
    for model in ("m0", "m1"):
        for name, value in brute([r for r in data if r[1] == model]).items():
            assert got[(model, name)] == pytest.approx(value, abs=1e-9), name


def test_registry_scans_and_shuffles_predictions_once(preds):
    frame = M.REGISTRY.evaluate(preds, ["model"])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_registry_rejects_duplicates_and_unknown_names(preds):
    with pytest.raises(ValueError):
        M.register_metric("nll")(lambda: M.Metric())
    with pytest.raises(KeyError):
        M.REGISTRY.evaluate(preds, ["model"], ["absent"])


def test_registry_accepts_user_metrics_with_sub_values(preds):
    own = M.MetricRegistry()
    own.register("margin")(lambda: M.Metric(
        {"p": F.col("_p"), "c": F.col("_conf")}, lambda s: {"label": s["p"] / s["n"], "top": s["c"] / s["n"]}))
    names = {r["metric"] for r in own.evaluate(preds, ["model"]).collect()}
    assert names == {"margin/label", "margin/top"}


def test_first_argmax_wins_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 2), ([1.0, 3.0, 3.0], 1)], "logits array<double>, label int")
    out = df.select(scores.argmax(F.col("logits")).alias("a"), scores.in_top(F.col("logits"), F.col("label"), 1).alias("h")).collect()
    assert [r["a"] for r in out] == [1, 1] and [r["h"] for r in out] == [False, True]


def test_k_is_capped_at_the_number_of_classes(preds):
    assert all(r["top9_acc"] == 100 for r in M.topk_accuracy(preds, ["model"], (9,)).collect())


def test_reliability_has_empty_bins_and_fractions_sum_to_one(preds):
    rows = M.reliability(preds, ["model"], 15).where("model = 'm0'").collect()
    assert len(rows) == 15
    assert sum(r["fraction"] for r in rows) == pytest.approx(1)
    assert any(r["accuracy"] is None and r["fraction"] == 0 for r in rows)


def test_large_scores_do_not_overflow(spark):
    df = spark.createDataFrame([([1000.0, 0.0], 0)], "logits array<double>, label int")
    assert df.select((scores.log_sum_exp(F.col("logits")) - 1000).alias("d")).first()["d"] == pytest.approx(0)


def targets(spark, rows):
    return spark.createDataFrame(rows, "logits array<double>, label int, target array<struct<label:int,weight:double>>")


def test_single_target_losses_equal_cross_entropy(spark):
    logits = [0.3, -1.0, 2.0, 0.1]
    df = targets(spark, [(logits, 2, [(0, 0.0), (0, 0.0), (2, 1.0)])])
    row = df.select(
        scores.mixed_cross_entropy(F.col("logits"), F.col("target")).alias("ce"), scores.ranked_loss(F.col("logits"), F.col("target")).alias("pl"),
        scores.ranked_loss(F.col("logits"), F.col("target"), alpha=0.37).alias("blend")).first()
    want = math.log(sum(math.exp(x) for x in logits)) - 2.0
    # With one ranked class the mass is everything, so its log is zero.
    assert row["ce"] == pytest.approx(want) and row["pl"] == pytest.approx(want) and row["blend"] == pytest.approx(want)


def test_rows_without_weight_change_nothing(spark):
    logits = [0.3, -1.0, 2.0, 0.1]
    full = [(logits, 1, [(1, 0.3), (2, 0.7)])]
    padded = full + [(logits, 0, [(0, 0.0), (0, 0.0)])] * 3
    loss = lambda rows: targets(spark, rows).agg(scores.mean_over_valid(
        scores.mixed_cross_entropy(F.col("logits"), F.col("target")), scores.target_weight(F.col("target"))).alias("l")).first()["l"]
    assert loss(full) == pytest.approx(loss(padded))


def test_area_scores_skip_ties_and_foreign_k(spark):
    present = "array<struct<label:int,area:double,score:double>>"
    df = spark.createDataFrame([
        ("m", 3, [(0, 0.2, 1.0), (1, 0.3, 2.0), (2, 0.5, 3.0)]),
        ("m", 3, [(0, 0.4, 1.0), (1, 0.4, 2.0), (2, 0.2, 3.0)]),
        ("m", 4, [(0, 0.1, 4.0), (1, 0.2, 3.0), (2, 0.3, 2.0), (3, 0.4, 1.0)]),
        ("m", 7, [(0, 1.0, 1.0)]),
    ], f"model string, k int, present {present}")
    out = {r["k"]: r for r in M.area_score_metrics(df).collect()}
    assert set(out) == {"3", "4", "5", "6", "all"}
    assert out["3"]["spearman_mean"] == 1 and out["3"]["spearman_n"] == 1 and out["3"]["top_n"] == 1
    assert out["4"]["spearman_mean"] == -1 and out["4"]["pair_acc"] == 0 and out["4"]["pair_n"] == 6
    assert out["5"]["n_samples"] == 0 and out["5"]["pair_acc"] is None
    assert out["all"]["n_samples"] == 3 and out["all"]["spearman_mean"] == 0


def test_multi_label_ignores_empty_sets(spark):
    preds = spark.createDataFrame([("a/x.jpg", "m", [3.0, 2.0, 1.0]), ("a/y.jpg", "m", [3.0, 2.0, 1.0])], "path string, model string, logits array<double>")
    labels = spark.createDataFrame([("b/x.jpg", [2, 1]), ("b/y.jpg", [])], "path string, labels array<int>")
    row = M.multi_label_accuracy(preds, labels, ["model"], 2).first()
    assert row["real_top2"] == 100 and row["n"] == 1


def test_restrict_classes_remaps_labels(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 2), ([1.0, 2.0, 3.0], 1)], "logits array<double>, label int")
    row = M.restrict_classes(df, [2, 0]).collect()
    assert len(row) == 1 and row[0]["logits"] == [3.0, 1.0] and row[0]["label"] == 0


def test_running_meter_with_cut_runs(spark, small_cells):
    from tallymill.plans.indexing import by_number

    df = spark.createDataFrame([("r", i, float(i), 1 + i % 3) for i in range(20)], "run string, step int, v double, n int")
    got = [r["avg"] for r in M.running_meter(df, ["run"], by_number(F.col("step")), F.col("v"), F.col("n")).orderBy("step").collect()]
    total = weight = 0
    for i in range(20):
        total, weight = total + i * (1 + i % 3), weight + 1 + i % 3
        assert got[i] == pytest.approx(total / weight)


def test_registry_missing_labels_and_column_names(spark):
    rows = [("a", [1.0, 2.0, 0.5], 1), ("a", [0.2, 0.1, 3.0], 2), ("a", [1.0, 1.0, 1.0], -1)]
    df = spark.createDataFrame(rows, "model string, z array<double>, y int")
    from tallymill.operators.metrics import REGISTRY

    whole = {r["metric"]: r["value"] for r in REGISTRY.evaluate(df, ["model"], ["nll", "brier", "top1_acc"], logits="z", label="y").collect()}
    labelled = {r["metric"]: r["value"] for r in REGISTRY.evaluate(df.where("y >= 0"), ["model"], ["nll", "brier"], logits="z", label="y").collect()}
    assert whole["nll"] == labelled["nll"] and whole["brier"] == labelled["brier"]
