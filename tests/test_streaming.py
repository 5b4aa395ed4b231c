"""Streams fed in several runs end where the batch form ends."""

import collections

import pytest
from pyspark.sql import functions as F

from tallymill.operators.mixing import four_groups
from tallymill.queries import stream_queries
from tallymill.streaming import meters, sampling, sync
from tallymill.streaming.tables import drain, parquet_stream, read_between, read_version, run_batches
from tallymill.tables import Tables


@pytest.fixture
def feed(spark, tmp_path):
    """Writes rows as one more input file and returns the stream over the folder."""
    folder = tmp_path / "in"
    folder.mkdir()

    def add(rows, schema):
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(str(folder))
        return parquet_stream(spark, str(folder), df.schema)

    return add


def test_sync_refreshes_on_any_difference(spark, feed, tmp_path):
    schema = "run_id string, heartbeat_at string, updated_at string, created_at string, ord long"
    root = str(tmp_path / "sync")
    drain(sync.sync_stream(feed([("a", "", "t5", "t0", 1), ("b", "t2", "", "", 2), ("a", "", "t6", "t0", 3)], schema), root))
    drain(sync.sync_stream(feed([("a", "", "t4", "t0", 4), ("b", "t2", "", "", 5), ("c", "", "", "t1", 6)], schema), root))
    manifest = {r["run_id"]: r["updated_at"] for r in read_version(spark, f"{root}/manifest").collect()}
    # An older stamp also refreshes: only equality counts.
    assert manifest == {"a": "t4", "b": "t2", "c": "t1"}
    last = read_version(spark, f"{root}/decisions")
    assert {r["run_id"]: r["reason"] for r in last.collect()} == {"a": "changed", "b": "fresh", "c": "new"}
    row = sync.sync_counters(last).first()
    assert (row["scanned"], row["downloaded"], row["skipped"], row["failed"]) == (3, 2, 1, 0)


def test_failed_refresh_keeps_the_old_entry(spark):
    manifest = spark.createDataFrame([("a", "t1", False, "runs/a")], "run_id string, updated_at string, include_files boolean, path string")
    incoming = spark.createDataFrame([("a", "t2", "", "", 1), ("b", "t1", "", "", 2)], "run_id string, heartbeat_at string, updated_at string, created_at string, ord long")
    decided = sync.sync_decisions(incoming, manifest).withColumn("failed", F.col("run_id") == "a")
    assert {r["run_id"]: r["updated_at"] for r in sync.upsert_manifest(manifest, decided).collect()} == {"a": "t1", "b": "t1"}
    assert sync.sync_counters(decided).first()["failed"] == 1
    assert sync.sync_decisions(incoming, manifest, limit=1).count() == 1
    assert {r["reason"] for r in sync.sync_decisions(incoming, manifest, force=True).collect()} == {"forced"}


def test_status_fold_over_runs(spark, feed, tmp_path):
    schema = "run_id string, ts long, step long, state string, config string"
    root = str(tmp_path / "st")
    first = [("r", 1, 1, "launched", "c1"), ("r", 2, 2, "running", None), ("q", 1, 1, "launched", None)]
    second = [("r", 3, 3, "failed", None), ("r", 4, 4, "launched", "c2"), ("r", 5, 5, "running", None)]
    for part in (first, second):
        drain(sync.keyed_stream(sync.run_status(feed(part, schema)), root, ["run_id"], snapshot_every=1))
    got = {r["run_id"]: r.asDict() for r in sync.current(spark, root, ["run_id"]).collect()}
    want = {r["run_id"]: r.asDict() for r in sync.run_status(spark.createDataFrame(first + second, schema)).collect()}
    assert got == want
    assert got["r"]["launch_count"] == 2 and got["r"]["last_finished_at"] == 3 and got["r"]["config"] == "c2" and got["r"]["status"] == "running" and not got["r"]["finished"]


def test_meters_over_runs_equal_the_batch(spark, feed, tmp_path):
    schema = "g string, v double, w int, h boolean, c double"
    parts = [[("a", float(i), 1 + i % 2, i % 3 == 0, (i % 10) / 10) for i in range(k, k + 20)] for k in (0, 20)]
    spec = dict(keys=["g"], value=F.col("v"), weight=F.col("w"), hit=F.col("h"), conf=F.col("c"))
    root = str(tmp_path / "m")
    for part in parts:
        drain(sync.keyed_stream(meters.meter_sums(feed(part, schema), **spec), root, ["g", "_b15"]))
    got = meters.meter_values(sync.current(spark, root, ["g", "_b15"]), ["g"]).first()
    want = meters.meter_values(meters.meter_sums(spark.createDataFrame(parts[0] + parts[1], schema), **spec), ["g"]).first()
    for name in ("avg", "acc", "ece", "count"):
        assert got[name] == pytest.approx(want[name])


def test_caps_hold_across_batches(spark, feed, tmp_path):
    root = str(tmp_path / "cap")
    for start in (0, 30, 60):
        rows = [(i, "ab"[i % 5 == 0]) for i in range(start, start + 30)]
        drain(sampling.capped_stream(feed(rows, "id long, l string"), root, "l", "id", 8, 13))
    out = read_between(spark, f"{root}/accepted").collect()
    counts = collections.Counter(r["l"] for r in out)
    assert counts["a"] <= 8 and counts["b"] <= 8 and len(out) == 13
    assert {r["id"] for r in out if r["l"] == "a"} == {1, 2, 3, 4, 6, 7, 8, 9}


def test_groups_of_four_across_batches_equal_the_batch(spark, feed, tmp_path):
    root = str(tmp_path / "four")
    schema = "id long, s int, y int"
    everything = [(i, i % 2, i % 7) for i in range(50)]
    for a, b in ((0, 9), (9, 11), (11, 50)):
        drain(sampling.four_group_stream(feed(everything[a:b], schema), root, ["s"], "id", "y", 0.7, 3, 0))
    got = sampling.flushed_groups(spark, root, ["s"], "id", "y")
    want = four_groups(spark.createDataFrame(everything, schema), ["s"], "id", "y", 0.7, 3, 0)
    key = lambda df: sorted((r["s"], tuple(r["members"]), tuple(r["labels"]), tuple(round(w, 9) for w in r["weights"])) for r in df.collect())
    assert key(got) == key(want)


@pytest.mark.parametrize("ids, files", [(range(400), 12), ([*range(399), 10**6], 2)])
def test_slices_of_events_have_many_files(spark, tmp_path, monkeypatch, ids, files):
    # Each micro-batch is one whole slice; where a slice holds little, all are one file, as before (two of them empty).
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 30)
    spark.createDataFrame([(i, "t") for i in ids], "event_id long, event_type string").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    stream = stream_queries.event_stream(Tables(spark, str(tmp_path)))
    drain(run_batches(stream, lambda rows, k: seen.append((rows.select(F.input_file_name()).distinct().count(), sorted(r["event_id"] for r in rows.collect()))), str(tmp_path / "check"), keep=False))
    got = [x for _, part in seen for x in part]
    assert got == sorted(ids) and len(seen) == 4 and sum(n for n, _ in seen) == files


def test_history_is_written_once(spark, feed, tmp_path):
    schema = "run_id string, step int, loss double"
    root = str(tmp_path / "h")
    for part in ([("r", 1, 0.5), ("r", 1, 0.5)], [("r", 1, 0.9), ("r", 2, 0.4)]):
        drain(meters.append_history(feed(part, schema), root, ["loss"], ["loss"]))
    out = {(r["run_id"], r["step"]): r["train_loss"] for r in spark.read.parquet(f"{root}/history").collect()}
    assert out == {("r", 1): 0.5, ("r", 2): 0.4} and spark.read.parquet(f"{root}/history").count() == 2


def test_worker_target():
    assert sampling.worker_target(1000, 8, 1, 32) == 128
    assert sampling.worker_target(1000, 3, 2, 64) == 704
    assert sampling.worker_target(10, 4, training=False) == 3
    assert sampling.worker_target(10, 1, training=False) == 10


def test_epoch_rows_repeat_to_the_target(spark):
    out = sampling.epoch_rows(spark.range(10), "id", 3, 7).collect()
    per = collections.defaultdict(dict)
    for r in out:
        per[r["worker"]][r["seq"]] = r["id"]
    assert all(sorted(v) == list(range(7)) for v in per.values())
    assert [per[0][i] for i in range(7)] == [0, 3, 6, 9, 0, 3, 6]
