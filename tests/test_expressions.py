import pytest
from pyspark.sql import functions as F

from tallymill.functions import configs, names, predicates, schedules, text
from tallymill.missing import sample_std, to_number


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "name string").select(*columns).first()


def test_parse_run_name_keeps_the_underscore_quirk(spark):
    name = "abl__vit__img256__k4-4_a0.1-0.5_mixup_switch_prob=1.0_as-cosine_ma0.2__seed=42__seed=43"
    row = names.parse_run_name(spark.createDataFrame([(name,)], "name string")).first()
    assert row["experiment_tag"] == "abl"
    assert row["params"] == {"img": "256", "k": "4-4", "a": "0.1-0.5", "prob": "1.0", "ma": "0.2", "seed": "43"}
    assert row["tags"] == ["vit", "mixup", "switch", "as-cosine"]


def test_parsed_columns_do_not_overwrite(spark):
    df = spark.createDataFrame([("x__seed=1", 7)], "name string, seed int")
    row = names.add_parsed_columns(df, names.parsed_keys(df)).first()
    assert row["seed"] == 7 and row["seed_parsed"] == "1"


@pytest.mark.parametrize("name,want", [
    ("v__in1k__bare_cutmix=0_mixup=0__seed=1", "bare"),
    ("v__unbalanced__bare_cutmix=0__seed=1", "unbalanced-bare"),
    ("v__in1k__cutmix_mixup_switch_prob=1.0__seed=1", "cutmix"),
    ("v__in1k__openmixup-fmix__seed=1", "fmix"),
    ("v__unbalanced__x", "unbalanced-noaug"),
    ("v__unbalanced__baseline_soft-ce", "unbalanced-groupmix-sce"),
    ("V__BASELINE__soft-ce", "baseline"),
    ("nothing", "unknown"),
    (None, "unknown"),
])
def test_canonical_type(spark, name, want):
    assert one(spark, name, names.canonical_type(F.col("name")).alias("t"))["t"] == want


def test_token_detectors(spark):
    row = one(spark, "a__300__b-Muon__seed=44", names.is_long_horizon(F.col("name")).alias("l"), names.optimizer_of(F.col("name")).alias("o"), names.seed_of(F.col("name")).alias("s"))
    assert (row["l"], row["o"], row["s"]) == (True, "muon", 44)
    assert one(spark, "run_PL_loss", names.matching_category(F.col("name"), [["soft-ce"], ["pl-loss", "pl_loss"]]).alias("c"))["c"] == "pl-loss"


@pytest.mark.parametrize("raw,want", [("a b//c", "a_b_c"), ("__x__", "x"), ("???", "run"), ("ok-1.2_z", "ok-1.2_z")])
def test_slug(spark, raw, want):
    assert one(spark, raw, names.slug(F.col("name")).alias("s"))["s"] == want


def test_general_number_format(spark):
    df = spark.createDataFrame([(0.1,), (1.0,), (0.0005,), (2.5,), (100.0,), (None,)], "x double")
    assert [r[0] for r in df.select(names.general(F.col("x"))).collect()] == ["0.1", "1", "0.0005", "2.5", "100", None]


def test_rendered_names_parse_back(spark):
    df = spark.createDataFrame([("vit", "in1k", 256, 4, 6, 0.1, 0.5, "soft_ce", 42)], "model string, dataset string, img_size int, k_min int, k_max int, a_min double, a_max double, loss string, seed int")
    row = names.parse_run_name(names.render_run_name(df)).first()
    assert row["name"] == "vit__in1k__img256__k4-6_a0.1-0.5_soft-ce__seed=42"
    assert row["params"]["k"] == "4-6" and row["params"]["seed"] == "42" and "soft-ce" in row["tags"]


def test_unwrap_is_idempotent_and_keeps_plain_objects(spark):
    wrapped = '{"a": {"value": 1, "desc": null}, "b": {"x": 1, "y": "z"}, "c": [1, "q"], "d": {"value": 1, "other": 2}, "e": null, "f": "t"}'
    value = lambda k: configs.flatten_value(F.try_element_at("c", F.lit(k))).alias(k)
    row = spark.createDataFrame([(wrapped,)], "j string").select(configs.unwrap_config(F.col("j")).alias("c")).select(*[value(k) for k in "abcdef"]).first()
    assert row["a"] == "1" and row["b"] == "x=1;y=z" and row["c"] == "1,q" and row["d"] == "other=2;value=1" and row["f"] == "t"
    assert one(spark, "{bad", configs.unwrap_config(F.col("name")).alias("c"))["c"] is None


def test_flatten_keys(spark):
    row = one(spark, '{"a": {"b": {"c": 1, "d": [1, 2]}}, "e": "x"}', configs.flatten_keys(F.col("name")).alias("f"))
    assert row["f"] == {"a.b.c": "1", "a.b.d": "[1,2]", "e": "x"}


def test_flatten_keys_to_the_end(spark):
    row = one(spark, '{"a": {"b": {"c": {"d": {"e": {"f": 1}, "g": [{"h": 2}]}}}}}', configs.flatten_keys(F.col("name")).alias("f"))
    assert row["f"] == {"a.b.c.d.e.f": "1", "a.b.c.d.g": '[{"h":2}]'}


def test_filters(spark):
    df = spark.createDataFrame([(["x", "y"], "g", "finished", "run-1"), (["x"], "h", "failed", "run-2")], "tags array<string>, `group` string, state string, name string")
    assert df.where(predicates.run_filter()).count() == 2
    assert df.where(predicates.run_filter(tags=["x", "y"])).count() == 1
    assert df.where(predicates.run_filter(any_tags=["y", "q"], group="g", state="finished", name_regex="1$")).count() == 1


def test_label_set_and_ranges(spark):
    ids = lambda **kw: [r["id"] for r in spark.range(10).where(predicates.label_set(F.col("id"), **kw)).collect()]
    assert ids() == list(range(10))
    assert ids(labels=[1], ranges=["3-5"], preset=[9]) == [1, 3, 4, 5, 9]
    with pytest.raises(ValueError):
        predicates.label_set(F.col("id"), ranges=["5-3"])


def test_snap(spark):
    df = spark.createDataFrame([(0.1 + 5e-7,), (0.1 + 2e-6,), (None,)], "x double")
    assert [r[0] for r in df.select(predicates.snap(F.col("x"), [0.1, 0.5])).collect()] == [0.1, None, None]


def test_funnel_counts_first_failing_reason(spark):
    df = spark.range(10)
    reasons = [("small", F.col("id") < 3), ("even", F.col("id") % 2 == 0), ("none", F.col("id") > 99)]
    counts = {r["reason"]: r["rows"] for r in predicates.funnel_counts(predicates.funnel(df, reasons), [n for n, _ in reasons]).collect()}
    assert counts == {"small": 3, "even": 3, "none": 0, "eligible": 4}


def test_coercion_and_rounding(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(to_number(F.col("s"))).collect()] == [1.5, None, None, None]
    half = spark.createDataFrame([(0.125, 0.375)], "m_mean double, m_std double")
    assert tuple(text.round_metrics(half, digits=2).first()) == (0.12, 0.38)


def test_single_value_deviation_policies(spark):
    df = spark.createDataFrame([(5.0,)], "x double")
    row = df.agg(sample_std(F.col("x")).alias("n"), sample_std(F.col("x"), "zero").alias("z")).first()
    assert row["n"] is None and row["z"] == 0.0


def test_cells(spark):
    df = spark.createDataFrame([(1.234, 0.5), (None, None), (-2.0, None)], "m double, s double")
    assert [r[0] for r in df.select(text.mean_std(F.col("m"), F.col("s"))).collect()] == ["1.23 +/- 0.50", "-", "-2.00 +/- nan"]
    assert [r[0] for r in df.select(text.signed(F.col("m"))).collect()] == ["+1.234", None, "-2.000"]


def test_step_counts_pin(spark):
    parts = schedules.steps(F.lit(115846), 100, 10, 1024)
    row = spark.range(1).select(*[v.alias(k) for k, v in parts.items()]).first()
    assert (row["num_steps"], row["warmup_steps"], row["steps_per_epoch"]) == (11314, 1132, 114)


def test_group_size_cooldown_beats_fixed(spark):
    e = spark.range(10)
    ks = [r[0] for r in e.select(schedules.group_size(F.col("id"), 4, 4, "fixed", total_epochs=10, cooldown_epochs=2)).collect()]
    assert ks == [4] * 8 + [1, 1]
    up = [r[0] for r in e.select(schedules.group_size(F.col("id"), 2, 6, "linear", total_epochs=10)).collect()]
    assert up[0] == 2 and up[-1] == 6 and up == sorted(up)


def test_log_extraction_prefers_newest_match(spark):
    from tallymill.sources.logs import extract_from_logs

    logs = spark.createDataFrame([
        ("r", 1, "a", "id: old"), ("r", 2, "b", "id: mid"), ("r", 3, "c", "nothing"), ("s", 1, "d", "run=zz"), ("t", 1, "e", "none")],
        "name string, mtime long, path string, content string")
    out = {r["name"]: r["value"] for r in extract_from_logs(logs, ["id: (\\w+)", "run=(\\w+)"]).collect()}
    assert out == {"r": "mid", "s": "zz", "t": None}
    assert {r["name"]: r["value"] for r in extract_from_logs(logs, ["id: (\\w+)"], limit=1).collect()}["r"] is None
