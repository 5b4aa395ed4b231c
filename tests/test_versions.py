"""Commits appear whole or not at all: a failure before or after every step leaves the old state or the new one."""

import pytest
from pyspark.sql import functions as F

from tallymill.sources import versions

STEPS = ["_write", "_point", "_remove"]


def broken(monkeypatch, step, late, nth=1):
    """Makes the ``nth`` call of a step fail, before or after it has done its work."""
    real, calls = getattr(versions, step), []

    def failing(*args, **kwargs):
        calls.append(1)
        if len(calls) == nth:
            if late:
                real(*args, **kwargs)
            raise OSError("lost")
        return real(*args, **kwargs)

    monkeypatch.setattr(versions, step, failing)


@pytest.mark.parametrize("late", [False, True])
@pytest.mark.parametrize("step", STEPS)
def test_table_is_old_or_new(spark, tmp_path, monkeypatch, step, late):
    root = str(tmp_path / "t")
    assert versions.read_table(spark, root) is None
    versions.commit_table(spark.range(5), root)
    with monkeypatch.context() as m:
        broken(m, step, late)
        with pytest.raises(OSError):
            versions.commit_table(versions.read_table(spark, root).select(F.col("id") * 10), root)
    got = sorted(r[0] for r in versions.read_table(spark, root).collect())
    new = step == "_remove" or (step == "_point" and late)
    assert got == ([0, 10, 20, 30, 40] if new else [0, 1, 2, 3, 4])
    # The next commit goes through, reads what counts and clears what was left.
    for _ in range(2):
        versions.commit_table(versions.read_table(spark, root).select((F.col(versions.read_table(spark, root).columns[0]) + 1).alias("id")), root)
    assert sorted(r[0] for r in versions.read_table(spark, root).collect()) == [x + 2 for x in got]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2


@pytest.mark.parametrize("late", [False, True])
@pytest.mark.parametrize("step, nth", [("_write", 1), ("_write", 2), ("_point", 1), ("_remove", 1), ("_remove", 2)])
def test_splits_are_old_or_new_together(spark, tmp_path, monkeypatch, step, nth, late):
    root = str(tmp_path / "s")
    split = F.when(F.col("id") < 3, "a").when(F.col("id") < 6, "b").otherwise("c")
    versions.commit_splits(spark.range(9), root, split)
    change = spark.range(6).select("id", F.when(F.col("id") < 3, "b").otherwise("d").alias("split"))
    old = {"a": [0, 1, 2], "b": [3, 4, 5], "c": [6, 7, 8]}
    new = {**old, "b": [0, 1, 2], "d": [3, 4, 5]}

    def content():
        out = {}
        for r in versions.read_splits(spark, root).collect():
            out.setdefault(r["split"], []).append(r["id"])
        return {k: sorted(v) for k, v in out.items()}

    with monkeypatch.context() as m:
        broken(m, step, late, nth)
        with pytest.raises(OSError):
            versions.commit_splits(change, root, force=True)
    assert content() == (new if step == "_remove" or (step == "_point" and late) else old)
    versions.commit_splits(change, root, force=True)
    assert content() == new
    for k in range(3):
        versions.commit_splits(spark.range(k).withColumn("split", F.lit("a")), root, force=True)
    assert content() == {**new, "a": [0, 1]}


def test_existing_splits_are_an_error(spark, tmp_path):
    root = str(tmp_path / "s")
    assert versions.read_splits(spark, root) is None
    versions.commit_splits(spark.range(2).withColumn("part", F.lit(7)), root, "part")
    with pytest.raises(FileExistsError, match="7"):
        versions.commit_splits(spark.range(4).withColumn("split", F.lit("7")), root)
    versions.commit_splits(spark.range(4).withColumn("split", F.lit("8")), root)
    assert {(r["split"], r["count"]) for r in versions.read_splits(spark, root).groupBy("split").count().collect()} == {("7", 2), ("8", 4)}


def test_a_reader_outlives_one_commit(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.commit_table(spark.range(3), root)
    before = versions.read_table(spark, root)
    versions.commit_table(spark.range(7), root)
    assert before.count() == 3 and versions.read_table(spark, root).count() == 7
