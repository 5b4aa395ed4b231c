
import pytest
from pyspark.sql import functions as F

from tallymill.sources import paths, results, shards


def test_result_files_union_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,top1,error\nr1,1.5,\nr2,2.5,boom\n")
    (tmp_path / "b.csv").write_text("top1,name,ece\n3.5,r3,0.1\n")
    (tmp_path / "c.csv").write_text("name,top1,error\nr4,4.5,\n")
    out = results.load_results(spark, [f"{tmp_path}/*.csv"])
    rows = {r["name"]: r for r in out.collect()}
    assert set(rows) == {"r1", "r2", "r3", "r4"}
    assert rows["r3"]["top1"] == "3.5" and rows["r1"]["ece"] is None and rows["r1"]["error"] is None and rows["r2"]["error"] == "boom"
    assert rows["r4"]["_source_csv"].endswith("c.csv")
    with pytest.raises(ValueError):
        results.load_results(spark, [])


def test_paths_with_blanks_and_quoted_headers(spark, tmp_path):
    (tmp_path / "a b+c.csv").write_text('name,"top, one"\nr1,1.5\n')
    schema = "name string, `top, one` double"
    from pyspark.sql.types import StructType

    row = results.load_results(spark, [f"{tmp_path}/*.csv"], StructType.fromDDL(schema)).first()
    assert row["name"] == "r1" and row["top, one"] == 1.5


def test_pending_ignores_failed_and_unnamed_rows(spark):
    mapping = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    with_error = spark.createDataFrame([("a", None), ("b", "boom"), (" ", None)], "name string, error string")
    without = spark.createDataFrame([("c",)], "name string")
    assert [r["name"] for r in results.pending(mapping, [with_error, without], ["d"]).collect()] == ["b"]


def test_upsert_replaces_named_rows_and_adds_failures(spark):
    old = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, None), ("c", 3.0, "old")], "name string, z double, error string")
    new = spark.createDataFrame([("b", 9.0)], "name string, acc double")
    errors = spark.createDataFrame([("c", "lost")], "name string, error string")
    mapping = spark.createDataFrame([("c", "/r/c")], "name string, run_dir string")
    out = results.upsert_results(old, new, errors, mapping)
    assert out.columns == ["name", "run_dir", "checkpoint", "acc", "z", "eval_time_s", "error"]
    rows = {r["name"]: r for r in out.collect()}
    assert rows["a"]["z"] == 1 and rows["b"]["acc"] == 9 and rows["b"]["z"] is None and rows["c"]["error"] == "lost" and rows["c"]["run_dir"] == "/r/c" and rows["c"]["z"] is None


def test_table_can_be_replaced_by_its_own_result(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    results.replace_table(spark.read.parquet(path).where("id > 2"), path)
    assert spark.read.parquet(path).count() == 2


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json"])
def test_predictions_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, [0.5, 0.25], [7])], "id int, p array<double>, one array<int>")
    results.write_predictions(df, str(tmp_path / "s"), fmt, {"p": 2, "one": 1})
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    back = reader.format(fmt).load(str(tmp_path / "s"))
    assert set(back.columns) == {"id", "p_0", "p_1", "one"}
    results.write_predictions(df, str(tmp_path / "w"), fmt)
    assert spark.read.format(fmt).option("header", True).load(str(tmp_path / "w")).count() == 1


def test_split_is_kept_unless_forced(spark, tmp_path):
    root = str(tmp_path / "ds")
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 8, "train").otherwise("val"))
    results.write_split(df, root)
    with pytest.raises(FileExistsError):
        results.write_split(df.where("split = 'val'"), root)
    results.write_split(df.where("split = 'val' AND id = 9"), root, force=True)
    assert {r["split"]: r["count"] for r in spark.read.parquet(root).groupBy("split").count().collect()} == {"train": 8, "val": 1}


def test_path_labels(spark, tmp_path):
    for rel in ("train/cat/a.JPG", "train/dog/b.png", "train/dog/c.txt"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text("x")
    files = paths.list_files(spark, str(tmp_path))
    leaf = {r["path"]: r["label"] for r in paths.path_label_index(files).collect()}
    assert leaf == {"train/cat/a.JPG": "cat", "train/dog/b.png": "dog"}
    assert {r["label"] for r in paths.path_label_index(files, leaf_only=False).collect()} == {"train_cat", "train_dog"}


def test_class_map_is_natural_order(spark, tmp_path):
    df = spark.createDataFrame([("src10",), ("src2",), ("Src1",), ("src2",), (None,)], "l string")
    assert {r["label"]: r["idx"] for r in paths.class_map(df, "l").collect()} == {"Src1": 0, "src2": 1, "src10": 2}
    (tmp_path / "map.txt").write_text("dog\ncat\n")
    mapping = paths.read_class_map(spark, str(tmp_path / "map.txt"))
    assert {r["label"]: r["idx"] for r in mapping.collect()} == {"dog": 0, "cat": 1}
    animals = spark.createDataFrame([("cat",), ("cow",)], "l string")
    assert [r["idx"] for r in paths.apply_class_map(animals, mapping, "l").collect()] == [1]
    assert paths.dropped_count(animals, mapping, "l").first()["dropped"] == 1


def shard_files(spark, *ids, total=3):
    return spark.createDataFrame([(f"d/set-train-{i:05d}-of-{total:05d}.arrow",) for i in ids], "path string")


def test_shards_complete_missing_duplicate(spark):
    assert shards.the_complete_group(shard_files(spark, 2, 0, 1)) == ("d", "set-train", 3)
    gap = shard_files(spark, 0, 2)
    assert [r["shard"] for r in shards.missing_shards(gap).collect()] == [1]
    with pytest.raises(ValueError):
        shards.the_complete_group(gap)
    row = shards.shard_completeness(shard_files(spark, 0, 0, 1, 2, 5)).first()
    assert (row["missing"], row["duplicates"], row["out_of_range"], row["complete"]) == (0, 1, 1, False)


def test_select_split_ranges(spark):
    df = spark.createDataFrame([("train", i, 10) for i in range(6)] + [("val", 0, 5)], "split string, shard int, shard_length int")
    pick = lambda spec: shards.select_split(df, spec)[1].first()
    assert tuple(pick("train-{1..3}")) == (3, 30) and tuple(pick("val")) == (1, 5) and tuple(pick("train-{0..1}|7")) == (2, 7)
    assert tuple(pick("data-train-{0002..0003}.tar")) == (2, 20)
    with pytest.raises(ValueError):
        pick("absent")


def test_natural_key_long_runs(spark):
    from pyspark.sql import functions as F

    from tallymill.sources.paths import natural_key

    names = ["n9", "n10", "n" + "1" * 25, "n" + "1" * 24 + "2", "n" + "9" * 24, "n007"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in names], "s string").orderBy(natural_key(F.col("s"))).collect()]
    assert got == ["n007", "n9", "n10", "n" + "9" * 24, "n" + "1" * 25, "n" + "1" * 24 + "2"]
