"""Schedules and groups: coverage, counts, determinism, change with epoch, for plain and cut groups."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallymill.operators import mixing as X
from tallymill.operators import sampling as D
from tallymill.plans.indexing import by_number


@pytest.fixture(params=["plain", "cut"])
def cells(spark, request):
    if request.param == "cut":
        spark.conf.set("tallymill.cell.rows", "3")
    yield request.param
    spark.conf.unset("tallymill.cell.rows")


@pytest.fixture
def labelled(spark):
    rows, i = [], 0
    for label, n in enumerate((5, 4, 3, 2)):
        for _ in range(n):
            rows.append((i, label))
            i += 1
    return spark.createDataFrame(rows, "id long, label int")


def test_long_tail_profile_pins(spark):
    rows = [r["rows"] for r in D.long_tail_profile(spark.range(1000), 1280, 5).orderBy("rank").collect()]
    assert sum(rows) == 230341 and rows[0] == 1280 and rows[-1] == 5 and rows == sorted(rows, reverse=True)


def test_rank_assignment_uses_each_class_once(spark):
    counts = spark.createDataFrame([(0, 8), (1, 7), (2, 6), (3, 5)], "label int, n long")
    out = D.assign_ranks(counts, [8, 6, 4, 2], 42).collect()
    have = dict(enumerate((8, 7, 6, 5)))
    assert sorted(r["label"] for r in out) == [0, 1, 2, 3] and sorted(r["rank"] for r in out) == [0, 1, 2, 3]
    assert all(have[r["label"]] >= r["rows"] for r in out)
    with pytest.raises(ValueError):
        D.assign_ranks(counts, [9, 1, 1, 1], 42)


def heap_ranks(counts, wanted, seed):
    """The same choice one count at a time."""
    left, out = dict(counts), {}
    key = lambda c: hashlib.md5(f"{seed}|{c}".encode()).hexdigest()
    for rank, need in sorted(enumerate(wanted), key=lambda p: -p[1]):
        best = min((c for c, n in left.items() if n >= need), key=key, default=None)
        if best is None:
            return need
        out[best] = (rank, need)
        del left[best]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_ranks_without_the_driver_equal_the_heap(spark, small_cells, seed):
    r = random.Random(seed)
    n = r.choice([1, 7, 16, 33])
    counts = [(i, r.choice([3, 5, 5, 8, 13, 21, 34])) for i in range(n)]
    sizes = sorted((c for _, c in counts), reverse=True)
    wanted = [max(1, s - r.randrange(4)) for s in sizes]
    r.shuffle(wanted)
    expected = heap_ranks(counts, wanted, seed)
    df = spark.createDataFrame(counts, "label long, n long")
    if not isinstance(expected, dict):
        with pytest.raises(ValueError, match=str(expected)):
            D.assign_ranks(df, wanted, seed)
        return
    got = D.assign_ranks(df, wanted, seed).collect()
    assert {x["label"]: (x["rank"], x["rows"]) for x in got} == expected and len(got) == n



def test_long_tail_selection(spark, cells, labelled):
    counts = spark.createDataFrame([(0, 4), (1, 1), (3, 2)], "label int, rows long")
    a = D.select_long_tail(labelled, "label", "id", counts, 1).collect()
    assert collections.Counter(r["label"] for r in a) == {0: 4, 1: 1, 3: 2}
    assert sorted(r["position"] for r in a) == list(range(7))
    assert {r["id"] for r in a} == {r["id"] for r in D.select_long_tail(labelled.repartition(3), "label", "id", counts, 1).collect()}
    with pytest.raises(ValueError):
        D.select_long_tail(labelled, "label", "id", spark.createDataFrame([(3, 3)], "label int, rows long"), 1)


def test_source_pool_collapses_copies(spark, cells):
    df = spark.createDataFrame([(f"b{i // 2}", f"s{i % 2}/b{i // 2}", i) for i in range(20)], "base string, path string, payload int")
    out = D.source_pool(df, "base", "path", 6, 3).collect()
    assert len({r["base"] for r in out}) == 6 and all(r["path"].startswith("s0") for r in out)
    with pytest.raises(ValueError):
        D.source_pool(df, "base", "path", 11, 3)


def test_stratified_cap_and_explicit_list(spark, cells, labelled):
    out = D.stratified_cap(labelled, "label", "id", 3, 9).collect()
    assert collections.Counter(r["label"] for r in out) == {0: 3, 1: 3, 2: 3, 3: 2}
    assert [r["id"] for r in D.stratified_cap(labelled, "label", "id", 3, 9, explicit=[5]).collect()] == [5]


def test_capped_sample_equals_the_loop(spark, cells):
    import random

    rng = random.Random(2)
    rows = [(i, rng.choice("aaabc"), rng.randint(0, 10)) for i in range(60)]
    out = D.capped_label_sample(spark.createDataFrame(rows, "id long, l string, size int"), "l", "id", F.col("size"), 12, 5, 4, ["a", "b"]).collect()
    want, counts, saved = {}, collections.Counter(), 0
    for i, label, size in rows:
        if saved >= 12:
            break
        if label not in "ab":
            want[i] = "label"
        elif counts[label] >= 5:
            want[i] = "cap"
        elif size < 4:
            want[i] = "size"
        else:
            counts[label] += 1
            saved += 1
            want[i] = "accepted"
    assert {r["id"]: r["outcome"] for r in out} == want


@pytest.mark.parametrize("mode,cycles", [("min", 2), ("max", 5), (3, 3)])
def test_resampled_schedule(cells, labelled, mode, cycles):
    rows = D.resampled_schedule(labelled, "label", "id", mode, 1, 0).collect()
    per = collections.defaultdict(list)
    for r in rows:
        per[r["cycle"]].append((r["pos"], r["label"]))
    assert len(per) == cycles
    for members in per.values():
        assert sorted(p for p, _ in members) == [0, 1, 2, 3] and sorted(x for _, x in members) == [0, 1, 2, 3]


def schedule_rows(df, epoch, seed=42):
    return D.natural_schedule(df, "label", "id", seed, epoch)


def test_natural_schedule(cells, labelled):
    rows = schedule_rows(labelled, 0).collect()
    assert sorted(r["id"] for r in rows) == list(range(14))
    sizes = collections.Counter(r["level"] for r in rows)
    assert [sizes[i] for i in range(5)] == [4, 4, 3, 2, 1]
    assert all(len({r["label"] for r in rows if r["level"] == lv}) == n for lv, n in sizes.items())
    key = lambda rs: sorted((r["level"], r["pos"], r["id"]) for r in rs)
    assert key(rows) == key(schedule_rows(labelled.repartition(5), 0).collect())
    assert key(rows) != key(schedule_rows(labelled, 1).collect()) and key(rows) != key(schedule_rows(labelled, 0, 7).collect())


def test_natural_mixed_schedule_covers_every_row_once(cells, labelled):
    rows = D.natural_mixed_schedule(labelled, "label", "id", 1, 0, 4, 3).collect()
    assert sorted(r["slot"] for r in rows) == list(range(14)) and sorted(r["id"] for r in rows) == list(range(14))
    assert all(r["row"] == r["slot"] // 3 and r["col"] == r["slot"] % 3 for r in rows)


@pytest.mark.parametrize("k", [2, 3, 6])
def test_mix_groups(cells, labelled, k):
    levels = schedule_rows(labelled, 0)
    out = X.mix_groups(levels, "label", "id", k, X.level_weights(k, 42, 0, F.col("level")), 42, 0).collect()
    # Every row leads exactly one output, with its own label in front.
    label = {r["id"]: r["label"] for r in labelled.collect()}
    assert sorted(r["id"] for r in out) == list(range(14))
    sizes = {0: 4, 1: 4, 2: 3, 3: 2, 4: 1}
    for r in out:
        mixed = sizes[r["level"]] >= k
        assert r["mixed"] == mixed and len(r["target"]) == (k if mixed else 1)
        weights = [s["weight"] for s in r["target"]]
        assert weights == sorted(weights) and sum(weights) == pytest.approx(1)
        assert r["target"][0]["label"] == label[r["id"]]
        if mixed:
            assert len({s["label"] for s in r["target"]}) == k


@pytest.mark.parametrize("alpha", [0, 0.3, 1, 4.0])
def test_level_weights(spark, alpha):
    rows = spark.range(50).select(X.level_weights(4, 1, 2, F.col("id"), alpha).alias("w")).collect()
    again = spark.range(50).repartition(7).select("id", X.level_weights(4, 1, 2, F.col("id"), alpha).alias("w")).orderBy("id").collect()
    assert [r["w"] for r in rows] == [r["w"] for r in again]
    for r in rows:
        assert r["w"] == sorted(r["w"]) and sum(r["w"]) == pytest.approx(1)
    assert (len({tuple(r["w"]) for r in rows}) == 1) == (alpha == 0)


def test_level_weights_follow_a_schedule_column(spark):
    rows = spark.range(6).select(X.level_weights(3, 1, 0, F.col("id"), F.col("id") / 5).alias("w")).collect()
    assert rows[0]["w"] == pytest.approx([1 / 3] * 3) and rows[5]["w"] != rows[0]["w"]


@pytest.mark.parametrize("mode", ["batch", "pair", "elem"])
def test_pair_mix(spark, cells, mode):
    df = spark.createDataFrame([(i, i % 3, [float(i), 1.0, 2.0, 3.0]) for i in range(10)], "id long, y int, p array<double>")
    rows = X.batched(df, by_number(F.col("id")), 4)
    out = X.pair_mix(rows, "id", "y", mode=mode, seed=5, payload="p").collect()
    partner = {r["id"]: r["partner"] for r in out}
    assert partner == {0: 3, 1: 2, 2: 1, 3: 0, 4: 7, 5: 6, 6: 5, 7: 4, 8: 9, 9: 8}
    lam = {r["id"]: r["lam"] for r in out}
    if mode == "batch":
        assert len({lam[i] for i in range(4)}) == 1
    if mode == "pair":
        assert lam[0] == lam[3] and lam[1] == lam[2] and lam[0] != lam[1]
    for r in out:
        assert r["mixed_payload"][0] == pytest.approx(r["id"] * r["lam"] + r["partner"] * (1 - r["lam"]))
    skipped = X.pair_mix(rows, "id", "y", mode=mode, prob=0.0).collect()
    assert all(r["lam"] == 1 for r in skipped)


def test_pair_mix_beta_and_soft_label(spark):
    rows = X.batched(spark.createDataFrame([(i, i % 3) for i in range(8)], "id long, y int"), by_number(F.col("id")), 4)
    out = X.pair_mix(rows, "id", "y", mode="elem", alpha=0.4, seed=1)
    got = out.withColumn("t", X.soft_label(F.col("y"), F.col("partner_label"), F.col("lam"), 3, 0.1)).collect()
    for r in got:
        assert 0 <= r["lam"] <= 1 and sum(r["t"]) == pytest.approx(1)


def test_cut_options(spark):
    df = spark.createDataFrame([(i, i % 3, [float(i)] * 64) for i in range(40)], "id long, y int, p array<double>")
    rows = X.batched(df, by_number(F.col("id")), 8)
    cut = dict(mode="elem", cut_prob=1.0, height=8, width=8, seed=2, payload="p")
    pasted = lambda r: sum(v == r["partner"] for v in r["mixed_payload"]) / 64
    exact = {r["id"]: r for r in X.pair_mix(rows, "id", "y", **cut).collect()}
    loose = {r["id"]: r for r in X.pair_mix(rows, "id", "y", **cut, correct=False).collect()}
    assert all(r["lam"] == pytest.approx(1 - pasted(r)) for r in exact.values())
    assert all(loose[i]["mixed_payload"] == r["mixed_payload"] for i, r in exact.items()) and any(loose[i]["lam"] != r["lam"] for i, r in exact.items())
    ranged = X.pair_mix(rows, "id", "y", **cut, box_range=(0.5, 0.9), correct=False).collect()
    assert all(r["lam"] == pytest.approx(1 - pasted(r)) and 16 / 64 <= pasted(r) <= 49 / 64 for r in ranged) and len({r["lam"] for r in ranged}) > 3
    # Cuts draw lam by their own alpha; mixes keep theirs.
    drawn = {c: X.pair_mix(rows, "id", "y", mode="elem", cut_prob=0.5, height=8, width=8, seed=2, cut_alpha=c, correct=False).collect() for c in (None, 3.0)}
    other = {a["id"]: a["lam"] != b["lam"] for a, b in zip(*[sorted(rows_, key=lambda r: r["id"]) for rows_ in drawn.values()])}
    assert {r["id"] for r in drawn[3.0] if r["cut"]} == {i for i, changed in other.items() if changed}
    with pytest.raises(ValueError):
        X.pair_mix(rows, "id", "y", cut_prob=1.0, box_range=(0.9, 0.2))


def test_derangement_never_self(spark, cells):
    rows = X.batched(spark.range(11), by_number(F.col("id")), 5)
    out = X.derangement(rows, "id", 3, 0).collect()
    for b in (0, 1):
        members = [r for r in out if r["batch"] == b]
        assert {r["partner"] for r in members} == {r["id"] for r in members} and all(r["partner"] != r["id"] for r in members)
    assert [r["partner"] for r in out if r["batch"] == 2] == [None]


def test_four_groups(spark, cells):
    df = spark.createDataFrame([(i, i % 5, i % 2) for i in range(50)], "id long, y int, s int")
    out = X.four_groups(df, ["s"], "id", "y", 0.6, 1, 0).collect()
    members = [m for r in out for m in r["members"]]
    assert sorted(members) == list(range(50))
    for r in out:
        assert len(r["weights"]) == 4 and sum(r["weights"]) == pytest.approx(1)
        assert len(r["members"]) in (1, 4)
        if len(r["members"]) == 1:
            assert r["weights"] == [1, 0, 0, 0] and len(set(r["labels"])) == 1
    off = X.four_groups(df, ["s"], "id", "y", 1.0, 1, 9, epochs=10, close_epochs=2).collect()
    assert all(len(r["members"]) == 1 for r in off)


def test_tile_weights_at_the_middle_are_equal(spark):
    row = spark.range(1).select(X.four_tile_weights(F.lit(100.0), F.lit(100.0), F.lit(1.0), 100).alias("w")).first()
    assert row["w"] == [0.25] * 4


def test_pad_batches_pins(spark, cells):
    df = spark.createDataFrame([(i, [(i, 1.0)]) for i in range(5)], "id long, t array<struct<label:int,weight:double>>")
    out = X.pad_batches(df, "id", 8, "t").orderBy("pos").collect()
    assert [r["id"] for r in out] == [0, 1, 2, 3, 4, 0, 1, 2]
    assert all(r["t"][0]["weight"] == (0 if r["padding"] else 1) for r in out) and [r["padding"] for r in out] == [False] * 5 + [True] * 3
    assert X.pad_batches(df, "id", 5, "t").count() == 5
    assert [r["id"] for r in X.pad_batches(df.where("id < 2"), "id", 7, "t").orderBy("pos").collect()] == [0, 1, 0, 1, 0, 1, 0]


def test_random_tuples(spark, cells):
    pool = spark.range(100, 107)
    rows = D.random_tuples(pool, "id", 40, 5, 1).collect()
    per = collections.defaultdict(dict)
    for r in rows:
        per[r["sample_id"]][r["slot"]] = r["id"]
    assert len(per) == 40 and all(len(set(v.values())) == 5 and sorted(v) == list(range(5)) for v in per.values())
    assert len({tuple(sorted(v.values())) for v in per.values()}) > 10
    done = spark.createDataFrame([("k05_00000",), ("k05_00007",)], "sample_id string")
    rest = D.random_tuples(pool, "id", 40, 5, 1, done).collect()
    assert {tuple(r) for r in rest} == {tuple(r) for r in rows if r["sample_id"] not in ("k05_00000", "k05_00007")}
    with pytest.raises(ValueError):
        D.random_tuples(pool, "id", 1, 8, 1)
    with pytest.raises(ValueError):
        D.check_same_config({"k": 3}, {"k": 4})


@pytest.mark.parametrize("rows,n", [(10, 3), (7, 7), (100, 8), (5, 8)])
def test_shard_assignment(spark, cells, rows, n):
    df = spark.range(rows)
    deal = {r["id"]: r["shard"] for r in D.shard_assign(df, "id", n, "round_robin").collect()}
    assert deal == {i: i % n for i in range(rows)}
    sizes = collections.Counter(r["shard"] for r in D.shard_assign(df, "id", n, "strided").collect())
    if rows >= n:
        assert len(set(sizes.values())) == 1
    even = {r["id"]: r["shard"] for r in D.shard_assign(df, "id", n, "contiguous").collect()}
    want = {}
    for s in range(n):
        for i in range(round(s * rows / n), round((s + 1) * rows / n)):
            want[i] = s
    assert even == want


@pytest.mark.parametrize("rows,n", [(10, 3), (7, 7), (100, 8), (5, 8)])
def test_strided_copies_come_from_one_pass(spark, cells, rows, n):
    df = spark.range(rows)
    strided = D.shard_assign(df, "id", n, "strided")
    padding = [i for i in range(rows) if i < -rows % n]
    assert sorted((r["id"], r["shard"], r["seq"], r["padding"]) for r in strided.collect()) == sorted(
        [(i, i % n, i // n, False) for i in range(rows)] + [(i, (i + rows) % n, (i + rows) // n, True) for i in padding])
    assert "Union" not in strided._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("repeats", [1, 3, 1.5, 2.25])
def test_repeat_sampler_equals_the_list(spark, cells, repeats):
    import math

    n, ranks = 50, 4
    out = D.repeat_sampler(spark.range(n), "id", repeats, ranks, 0, selected_round=0, selected_ratio=1, shuffle=False).collect()
    per_rank = math.ceil(n * repeats / ranks)
    idx = [int(i // repeats) for i in range(math.ceil(repeats * n))]
    idx += idx[: per_rank * ranks - len(idx)]
    want = {(r, s): idx[r::ranks][s] for r in range(ranks) for s in range(min(per_rank, n))}
    assert {(r["rank"], r["seq"]): r["id"] for r in out} == want


def test_token_batches_respect_the_budget(spark, cells):
    out = D.token_batches(spark.range(123), "id", [16, 32, 48], 200, 2, 1, 0).collect()
    assert sorted(r["id"] for r in out) == list(range(123))
    per = collections.defaultdict(list)
    for r in out:
        per[r["batch"]].append(r)
    for rows in per.values():
        assert len(rows) == rows[0]["batch_rows"] and sorted(r["place"] for r in rows) == list(range(len(rows)))
        assert len(rows) * rows[0]["seq_len"] <= 200
    other = D.token_batches(spark.range(123), "id", [16, 32, 48], 200, 2, 1, 1).collect()
    assert {(r["id"], r["batch"]) for r in other} != {(r["id"], r["batch"]) for r in out}


def test_balanced_split(spark, cells):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "x") for i in range(21)], "id long, b string")
    out = D.balanced_split(df, "id", 4, 1, {"b": "d"}).collect()
    assert sorted(collections.Counter(r["part"] for r in out).values()) == [5, 5, 5, 6] and all(r["b"] for r in out)
    with pytest.raises(ValueError):
        D.balanced_split(df.union(df), "id", 4, 1)


def test_resample_shards(spark, cells):
    shards = spark.createDataFrame([(i * 10,) for i in range(6)], "shard int")
    a = sorted(map(tuple, D.resample_shards(shards, "shard", 30, 1, 0).collect()))
    assert len(a) == 30 and a == sorted(map(tuple, D.resample_shards(shards, "shard", 30, 1, 0).collect()))
    assert a != sorted(map(tuple, D.resample_shards(shards, "shard", 30, 1, 0, worker=1).collect()))
