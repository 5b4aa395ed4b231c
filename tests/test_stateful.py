"""Streams with keyed state, timers, watermarks and repeated files, over several micro-batches and restarts."""

import collections
import datetime
import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from tallymill.operators.mixing import four_groups
from tallymill.streaming import epochs, meters, stateful, sync
from tallymill.streaming.tables import drain, parquet_stream, read_between, read_version, run_batches, write_batch

SCHEMA = "id long, l string"


@pytest.fixture
def parts(spark, tmp_path):
    """Writes parts of rows one after the other; the stream reads one a micro-batch."""
    folder = tmp_path / "in"

    def add(schema, *pieces):
        for rows in pieces:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        return parquet_stream(spark, str(folder), spark.createDataFrame([], schema).schema, files_per_trigger=1)

    return add


def test_caps_by_keyed_state_equal_the_batch(spark, parts, tmp_path):
    everything = [(i, None if i % 11 == 0 else "abc"[min(2, i % 5 // 2)]) for i in range(100)]
    stream = parts(SCHEMA, *[everything[k:k + 20] for k in range(0, 100, 20)])
    root = str(tmp_path / "cap")
    query = stateful.capped_label_stream(stream, root, "l", "id", 7, fits=F.col("id") % 2 == 0)
    drain(query)
    want = collections.defaultdict(list)
    for i, label in everything:
        if i % 2 == 0 and len(want[label]) < 7:
            want[label].append(i)
    got = collections.defaultdict(list)
    for r in read_between(spark, f"{root}/accepted").collect():
        got[r["l"]].append(r["id"])
    assert {k: sorted(v) for k, v in got.items()} == dict(want)
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(progress) == 5 and progress[-1]["stateOperators"][0]["numRowsTotal"] == len(want)


def test_cap_with_a_total_and_a_restart(spark, parts, tmp_path):
    root = str(tmp_path / "cap")
    rows = [(i, "ab"[i % 3 == 0]) for i in range(60)]
    drain(stateful.capped_label_stream(parts(SCHEMA, rows[:10], rows[10:20]), root, "l", "id", 12, 20))
    drain(stateful.capped_label_stream(parts(SCHEMA, rows[20:40], rows[40:]), root, "l", "id", 12, 20))
    got = sorted(r["id"] for r in read_between(spark, f"{root}/accepted").collect())
    fits, used = [], collections.Counter()
    for i, label in rows:
        if used[label] < 12:
            used[label] += 1
            fits.append(i)
    assert got == fits[:20]


def test_tasks_hand_on_no_more_than_the_cap(spark):
    import pyarrow as pa

    keep = stateful.least_per_label("l", "id", 2)
    batches = [pa.RecordBatch.from_pydict({"id": ids, "l": ["a", None, "a"]}) for ids in ([9, 8, 7], [1, 2, 3], [4, 0, 5])]
    out = pa.Table.from_batches(list(keep(iter(batches)))).to_pylist()
    assert sorted((r["id"], r["l"]) for r in out if r["l"]) == [(1, "a"), (3, "a")] and sorted(r["id"] for r in out if not r["l"]) == [0, 2]
    assert list(keep(iter([]))) == []


def shown(df):
    return sorted((r["s"], tuple(r["members"]), tuple(r["labels"]), tuple(round(w, 9) for w in r["weights"])) for r in df.collect())


def test_fours_by_list_state_equal_the_batch(spark, parts, tmp_path):
    everything = [(i, i % 2, i % 7) for i in range(60)]
    stream = parts("id long, s int, y int", everything[:9], everything[9:11], everything[11:12], everything[12:])
    root = str(tmp_path / "four")
    with stateful.keyed_state(spark):
        query = run_batches(stateful.timed_fours(stream, ["s"], "id", "y", 0.7, 3, 0), lambda b, k: write_batch(b, f"{root}/out", k), f"{root}/check")
    drain(query)
    batch = four_groups(spark.createDataFrame(everything, "id long, s int, y int"), ["s"], "id", "y", 0.7, 3, 0, flush=False)
    got = read_between(spark, f"{root}/out")
    assert shown(got) == shown(batch.where("weights IS NOT NULL"))
    ids = [(r["s"], r["group"]) for r in got.where("group IS NOT NULL").collect()]
    assert len(set(ids)) == len(ids)


def test_leftovers_leave_after_the_timeout(spark, parts, tmp_path):
    everything = [(i, i % 2, i % 7) for i in range(31)]
    stream = parts("id long, s int, y int", everything[:20], everything[20:])
    root = str(tmp_path / "timed")
    with stateful.keyed_state(spark):
        query = run_batches(
            stateful.timed_fours(stream, ["s"], "id", "y", 1.0, 3, 0, wait_ms=4000), lambda b, k: write_batch(b, f"{root}/out", k), f"{root}/check", available_now=False)
    try:
        end, out = time.time() + 90, []
        while time.time() < end and sum(len(r["members"]) for r in out) < 31:
            time.sleep(1)
            done = glob.glob(f"{root}/out/*/_SUCCESS")
            out = spark.read.parquet(*[os.path.dirname(d) for d in done]).collect() if done else []
    finally:
        query.stop()
    # The input never ended, and every row has left: whole groups, and the rest alone.
    assert sorted(m for r in out for m in r["members"]) == list(range(31))
    lone = [r for r in out if len(r["members"]) == 1]
    assert lone and all(r["group"] is None and r["weights"] == [1.0, 0.0, 0.0, 0.0] and len(set(r["labels"])) == 1 for r in lone)


def day(hour, minute=0):
    return datetime.datetime(2024, 1, 1, hour, minute)


def test_repeats_within_the_watermark_and_state_that_shrinks(spark, parts, tmp_path):
    schema = "run_id string, step long, loss double, at timestamp"
    stream = parts(
        schema, [("r", k, 0.5, day(1)) for k in range(20)], [("r", 3, 0.9, day(1, 30)), ("r", 50, 0.4, day(1, 40))], [("r", 60, 0.3, day(9))],
        [("r", 4, 0.7, day(1)), ("r", 61, 0.2, day(9))], [("r", 62, 0.1, day(9, 5))])
    root = str(tmp_path / "h")
    query = meters.append_history(stream, root, ["loss"], [], at="at", delay="1 hour")
    drain(query)
    out = {r["step"]: r["train_loss"] for r in spark.read.parquet(f"{root}/history").collect()}
    # The repeat of step 3 within the hour and the one of step 4, long after it, are dropped.
    assert out == {**{k: 0.5 for k in range(20)}, 50: 0.4, 60: 0.3, 61: 0.2, 62: 0.1}
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(sizes) >= 21 and sizes[-1] <= 3


def test_sync_with_inventory_limit_and_counters(spark, parts, tmp_path):
    schema = "run_id string, heartbeat_at string, updated_at string, created_at string, ord long"
    root, there = str(tmp_path / "sync"), set()

    def inventory():
        return spark.createDataFrame([(p,) for p in sorted(there)], "path string")

    def refresh(decisions):
        there.update(f"runs/{r['run_id']}" for r in decisions.where("reason <> 'fresh'").collect())
        return decisions

    def more(*rows):
        drain(sync.sync_stream(parts(schema, *rows), root, refresh=refresh, inventory=inventory, limit=3))

    more([(c, "", "t1", "t0", i) for i, c in enumerate("abcde")])
    assert read_version(spark, f"{root}/manifest").count() == 3 and read_version(spark, f"{root}/waiting").count() == 2
    more([("f", "t1", "", "", 9)])
    assert {r["run_id"]: r["updated_at"] for r in read_version(spark, f"{root}/manifest").collect()} == {c: "t1" for c in "abcdef"}
    there.discard("runs/b")
    more([("b", "", "t1", "", 10), ("c", "", "t1", "", 11)])
    assert {r["run_id"]: r["reason"] for r in read_version(spark, f"{root}/decisions").collect()} == {"b": "vanished", "c": "fresh"}
    assert tuple(sync.stream_counters(spark, root).first()) == (8, 7, 1, 0)


def test_status_folds_any_optional_fields(spark, parts, tmp_path):
    schema = "run_id string, ts long, step long, state string, config string, host string, loss double"
    rows = [[("r", 1, 1, "launched", "c1", None, None), ("q", 1, 1, "launched", None, None, None)], [("r", 2, 2, "running", None, "h1", 0.5)],
            [("r", 3, 3, "failed", None, None, None)], [("r", 4, 4, "running", None, None, 0.25)]]
    names, root = ("config", "host", "loss"), str(tmp_path / "st")
    drain(sync.keyed_stream(sync.run_status(parts(schema, *rows), optional=names), root, ["run_id"]))
    got = {r["run_id"]: r.asDict() for r in sync.current(spark, root, ["run_id"]).collect()}
    assert got == {r["run_id"]: r.asDict() for r in sync.run_status(spark.createDataFrame(sum(rows, []), schema), optional=names).collect()}
    assert (got["r"]["config"], got["r"]["host"], got["r"]["loss"], got["q"]["loss"]) == ("c1", "h1", 0.25, None)


def test_files_repeat_to_the_target_and_after_a_restart(spark, tmp_path):
    sizes, workers, target = [5, 3, 4, 2, 6], 2, 19
    at, rows, ids = [], [], 0
    for k, n in enumerate(sizes):
        path = str(tmp_path / f"file{k}")
        spark.range(ids, ids + n).coalesce(2).write.parquet(path)
        at.append((k, path, n))
        rows.append(list(range(ids, ids + n)))
        ids += n
    files = spark.createDataFrame(at, "file long, path string, rows long")
    want = {}
    for w in range(workers):
        share = [i for k in range(len(sizes)) if k % workers == w for i in rows[k]]
        want[w] = [share[i % len(share)] for i in range(target)]

    def result(root):
        out = collections.defaultdict(dict)
        for r in read_between(spark, f"{root}/read").collect():
            out[r["worker"]][r["seq"]] = r["id"]
        return {w: [got[i] for i in sorted(got)] for w, got in out.items()}, sum(len(g) for g in out.values())

    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    epochs.finish(epochs.repeated_files(spark, files, whole, "id", workers, target, 2))
    for stop in (1, 2, None, None):
        epochs.finish(epochs.repeated_files(spark, files, cut, "id", workers, target, 3, stop))
    assert result(whole) == result(cut) == (want, workers * target)
    assert read_between(spark, f"{whole}/read").select("batch_id").distinct().count() >= 3


def test_tickets():
    reader = epochs.TicketReader({"files": "3", "epochs": "2", "step": "4"})
    rows, end = reader.read(reader.initialOffset())
    assert list(rows) == [(0, 0), (0, 1), (0, 2), (1, 0)] and end == {"epoch": 1, "file": 1}
    rows, end = reader.read(end)
    assert list(rows) == [(1, 1), (1, 2)] and reader.read(end)[1] == end == {"epoch": 2, "file": 0}
