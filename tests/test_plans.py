"""Cell plans give what a plain window gives, for any skew."""

import random

import pytest
from pyspark.sql import Window, functions as F

from tallymill.hashing import md5_key, uniform
from tallymill.plans.indexing import Running, by_hash, by_number, first_n, indexed, running, with_cells
from tallymill.plans.percentiles import percentiles
from tallymill.plans.sizing import join_null_safe, pin


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def skewed(spark):
    rng = random.Random(7)
    data = [(i, "hot" if i % 3 else rng.choice(["a", "b", None]), round(rng.uniform(-5, 5), 2) if i % 11 else None) for i in range(400)]
    return spark.createDataFrame(data, "id long, k string, x double").cache()


@pytest.mark.parametrize("cells", ["3", "17", "1000"])
def test_running_equals_window(spark, skewed, cells):
    spark.conf.set("tallymill.cell.rows", cells)
    try:
        got = running(skewed, ["k"], by_number(F.col("id")), {
            "i": Running("index"), "s": Running("sum", F.col("x")), "m": Running("max_before", F.col("x"))})
        w = Window.partitionBy("k").orderBy("id")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        want = skewed.withColumns({
            "i": F.row_number().over(w).cast("bigint"), "s": F.sum("x").over(upto), "m": F.max("x").over(w.rowsBetween(Window.unboundedPreceding, -1))})
        norm = lambda df: rows_of(df.select("id", "k", "i", F.round("s", 6), "m"))
        assert norm(got) == norm(want)
    finally:
        spark.conf.unset("tallymill.cell.rows")


@pytest.mark.parametrize("cells", ["5", "1000"])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_index_in_hash_and_value_order(spark, skewed, cells, keys):
    spark.conf.set("tallymill.cell.rows", cells)
    try:
        h = md5_key(3, F.col("id"))
        part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
        for order, sort in (
            (by_hash(h, F.col("id")), [h, F.col("id")]),
            (by_number(F.col("x"), F.col("id"), descending=True), [F.desc_nulls_last("x"), F.col("id")]),
            (by_number(F.col("x"), F.col("id")), [F.asc_nulls_last("x"), F.col("id")]),
        ):
            got = indexed(skewed, keys, order).select("id", "idx")
            want = skewed.select("id", (F.row_number().over(part.orderBy(*sort)) - 1).alias("idx"))
            assert rows_of(got) == rows_of(want)
    finally:
        spark.conf.unset("tallymill.cell.rows")


@pytest.mark.parametrize("sample, carry", [(5, 100_000), (10**6, 4), (7, 2)])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_large_samples_and_many_bounds_change_nothing(spark, skewed, small_cells, monkeypatch, keys, sample, carry):
    """The sample sorted over several tasks, and bounds met by a join, as beyond 10^9 and 10^10 rows."""
    from tallymill.plans import indexing

    monkeypatch.setattr(indexing, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(indexing, "CARRY_ROWS", carry)
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    for order, sort in ((by_number(F.col("x"), F.col("id")), [F.asc_nulls_last("x"), F.col("id")]), (by_number(F.col("id")), [F.col("id")])):
        got = running(skewed, keys, order, {"i": Running("index"), "s": Running("sum", F.col("id")), "m": Running("max_before", F.col("id"))})
        w = part.orderBy(*sort)
        want = skewed.withColumns({
            "i": F.row_number().over(w).cast("bigint"), "s": F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "m": F.max("id").over(w.rowsBetween(Window.unboundedPreceding, -1))})
        assert rows_of(got.select("id", "i", "s", "m")) == rows_of(want.select("id", "i", "s", "m"))


def test_cells_by_joined_bounds_stay_small(spark, skewed, small_cells, monkeypatch):
    from tallymill.plans import indexing

    monkeypatch.setattr(indexing, "SAMPLE_ROWS", 20)
    monkeypatch.setattr(indexing, "CARRY_ROWS", 3)
    tagged, cut = with_cells(skewed, [], by_number(F.col("x"), F.col("id")))
    sizes = [r["count"] for r in tagged.groupBy("__cell").count().collect()]
    assert cut and len(sizes) > 100 and max(sizes) <= 12


@pytest.mark.parametrize("bounds", [0, 1, 2, 3, 7, 8, 100])
def test_cells_count_the_bounds_below(spark, bounds):
    from tallymill.plans.indexing import CELL, _with_bucket

    held = F.array(*[F.lit(10 * i) for i in range(bounds)]).cast("array<bigint>")
    got = {r["id"]: r[CELL] for r in _with_bucket(spark.range(-5, 1010), held, bounds, F.col("id")).collect()}
    assert got == {i: sum(10 * b <= i for b in range(bounds)) for i in range(-5, 1010)}


def test_cells_are_found_by_compiled_code(spark, skewed, small_cells):
    """No expression over the bounds that Spark can only interpret, row by row."""
    for keys in ([], ["k"]):
        tagged, cut = with_cells(skewed, keys, by_number(F.col("id")))
        plan = tagged._jdf.queryExecution().optimizedPlan().toString()
        assert cut and "lambda" not in plan


def test_hot_groups_are_cut_and_others_are_not(spark, skewed):
    spark.conf.set("tallymill.cell.rows", "100")
    try:
        tagged, cut = with_cells(skewed, ["k"], by_number(F.col("id")))
        assert cut
        cells = {r["k"]: (r["n"], r["most"]) for r in tagged.groupBy("k", "__cell").count().groupBy("k").agg(
            F.count("*").alias("n"), F.max("count").alias("most")).collect()}
        assert cells["hot"][0] >= 3 and cells["hot"][1] <= 120
        assert all(v[0] == 1 for k, v in cells.items() if k != "hot")
        assert tagged.where("k = 'hot' AND __cell IS NULL").count() == 0 and tagged.where("k = 'a' AND __cell IS NOT NULL").count() == 0
    finally:
        spark.conf.unset("tallymill.cell.rows")


def test_constant_order_value_stays_exact(spark, small_cells):
    df = spark.range(30).withColumn("v", F.lit(1.0))
    got = indexed(df, [], by_number(F.col("v"), F.col("id")))
    assert [r["idx"] for r in got.orderBy("id").collect()] == list(range(30))


@pytest.mark.parametrize("cells", ["3", "1000"])
def test_first_n_per_group_with_column_bound(spark, skewed, cells):
    spark.conf.set("tallymill.cell.rows", cells)
    try:
        bounded = skewed.withColumn("n", F.when(F.col("k") == "hot", 7).otherwise(2))
        got = first_n(bounded, ["k"], by_number(F.col("id")), F.col("n"))
        rank = F.row_number().over(Window.partitionBy("k").orderBy("id"))
        want = bounded.withColumn("r", rank).where("r <= n").drop("r")
        assert rows_of(got) == rows_of(want)
    finally:
        spark.conf.unset("tallymill.cell.rows")


def test_first_n_limits_before_the_shuffle(spark, skewed):
    plan = first_n(skewed, ["k"], by_number(F.col("id")), 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("cells", ["4", "1000"])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_percentiles_match_interpolation(spark, skewed, cells, keys):
    import numpy as np

    spark.conf.set("tallymill.cell.rows", cells)
    try:
        out = percentiles(skewed, keys, F.col("x"), {"p0": 0.0, "p50": 0.5, "p95": 0.95}).collect()
        data = skewed.collect()
        for row in out:
            xs = [r["x"] for r in data if r["x"] is not None and (not keys or r["k"] == row["k"])]
            assert row["p50"] == pytest.approx(np.quantile(xs, 0.5))
            assert row["p95"] == pytest.approx(np.quantile(xs, 0.95))
            assert row["p0"] == min(xs)
    finally:
        spark.conf.unset("tallymill.cell.rows")


def test_percentile_pins(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert percentiles(df, [], F.col("x"), {"p": 0.95}).first()["p"] == pytest.approx(1.95)
    with pytest.raises(ValueError):
        percentiles(df, [], F.col("x"), {"p": 1.5})


def test_pin_is_local_below_the_bound_and_checkpointed_above(spark):
    small, rows = pin(spark.range(5), 10)
    assert rows is not None and small.count() == 5
    large, rows = pin(spark.range(50), 10)
    assert rows is None and large.count() == 50


def test_null_keys_match(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, b int")
    assert rows_of(join_null_safe(a, b, ["k"])) == [("x", 2, 20), (None, 1, 10)] or len(join_null_safe(a, b, ["k"]).where("b is not null").collect()) == 2


def test_uniform_is_deterministic_and_in_range(spark):
    df = spark.range(2000).select(uniform(1, 2, F.col("id")).alias("u"))
    a, b = df.collect(), df.collect()
    assert a == b and all(0 <= r["u"] < 1 for r in a)
    assert abs(sum(r["u"] for r in a) / 2000 - 0.5) < 0.03


def test_repeated_order_values_spread_over_cells(spark):
    """Three values over many rows, text keys and NULLs: no cell above the limit, positions as the plain window's."""
    spark.conf.set("tallymill.cell.rows", "100")
    try:
        df = spark.range(2000).select("id", F.when(F.col("id") % 4 < 3, F.col("id") % 3).cast("double").alias("v"), F.concat(F.lit("é-Maß"), F.col("id") % 3).alias("t"))
        for order in (by_number(F.col("v"), descending=True), by_number(F.col("v")), by_number(F.col("t"))):
            tagged, cut = with_cells(df, [], order)
            assert cut and tagged.groupBy("__cell").count().agg(F.max("count")).first()[0] <= 100
            assert sorted(r["idx"] for r in indexed(df, [], order).collect()) == list(range(2000))
        got = indexed(df, ["v"], by_number(F.col("t"), F.col("id"))).select("id", "idx")
        plain = F.row_number().over(Window.partitionBy("v").orderBy("t", "id")) - 1
        assert rows_of(got) == rows_of(df.select("id", plain))
    finally:
        spark.conf.unset("tallymill.cell.rows")


def test_percentiles_do_not_depend_on_the_cell_size(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), (F.col("id") * 37 % 7 / 3.0).alias("x"))
    levels = {"a": 0.1, "b": 0.37, "c": 0.5, "d": 0.953}
    want = rows_of(percentiles(df, ["k"], F.col("x"), levels))
    spark.conf.set("tallymill.cell.rows", "100")
    try:
        assert rows_of(percentiles(df, ["k"], F.col("x"), levels)) == want
    finally:
        spark.conf.unset("tallymill.cell.rows")
