"""Streaming queries, each run to the end of the input at hand, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.queries.dataset_queries import seen_sql, u
from tallymill.queries.registry import query
from tallymill.session import scratch_path
from tallymill.streaming import epochs, meters, sampling, stateful, sync
from tallymill.streaming.tables import drain, parquet_stream, read_between, read_version, run_batches, write_batch


def r6(*columns):
    return [F.round(c, 6).alias(c) for c in columns]


PARTS = 4
FILE_ROWS = 200_000


def event_stream(t):
    """The events as a stream of ``PARTS`` micro-batches: slices of the id range, written one after the other so that they arrive in order.

    A slice has as many files as the smallest one fills, so that large slices are written and read by many tasks and a
    micro-batch is still one whole slice.
    """
    folder = scratch_path(t.spark, "events")
    end = t.events.agg(F.max("event_id")).first()[0] or 0
    part = F.floor(F.col("event_id") * PARTS / (end + 1))
    sizes = {r["part"]: r["count"] for r in t.events.groupBy(part.alias("part")).count().collect()}
    files = max(1, min(sizes.get(k, 0) for k in range(PARTS)) // FILE_ROWS)
    for k in range(PARTS):
        rows = t.events.where(part == k)
        rows = rows.coalesce(1) if files == 1 else rows.repartition(files)
        rows.write.mode("append").parquet(folder)
    return parquet_stream(t.spark, folder, t.events.schema, files_per_trigger=files)


def notices(events):
    """Run notices: some rows lack a heartbeat, some only have a creation stamp."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return events.select(
        F.col("user_id").alias("run_id"), F.when(F.col("event_id") % 3 == 0, day).otherwise("").alias("heartbeat_at"), F.when(F.col("event_id") % 3 == 1, day).otherwise("").alias("updated_at"),
        day.alias("created_at"), F.col("event_id").alias("ord"))


@query("t1_sync_decisions", """
WITH n AS (SELECT user_id AS run_id, event_id, strftime(ts, '%Y-%m-%d') AS stamp FROM events),
l AS (SELECT run_id, arg_max(stamp, event_id) AS stamp FROM n GROUP BY run_id),
m AS (SELECT user_id AS run_id, arg_max(strftime(ts, '%Y-%m-%d'), event_id) AS stamp, user_id % 3 = 0 AS files FROM events WHERE event_id % 5 <> 0 AND user_id % 7 <> 2 GROUP BY user_id)
SELECT l.run_id, l.stamp AS server_at, CASE WHEN m.run_id IS NULL THEN 'new' WHEN m.stamp <> l.stamp THEN 'changed' WHEN NOT m.files THEN 'files' WHEN l.run_id % 4 = 1 THEN 'vanished' ELSE 'fresh' END AS reason
FROM l LEFT JOIN m ON m.run_id = l.run_id
""")
def sync_decisions(t):
    manifest = t.events.where("event_id % 5 <> 0 AND user_id % 7 <> 2").groupBy(F.col("user_id").alias("run_id")).agg(F.max_by(F.date_format("ts", "yyyy-MM-dd"), "event_id").alias("updated_at")).withColumns(
        {"include_files": F.col("run_id") % 3 == 0, "path": F.concat(F.lit("runs/"), F.col("run_id").cast("string"))})
    inventory = manifest.where("run_id % 4 <> 1").select("path")
    out = sync.sync_decisions(notices(t.events), manifest, inventory, want_files=True)
    return out.select("run_id", "server_at", "reason")


@query("t1_sync_stream", """
SELECT user_id AS run_id, arg_max(strftime(ts, '%Y-%m-%d'), event_id) AS updated_at, concat('runs/', user_id) AS path FROM events GROUP BY user_id
""")
def sync_stream(t):
    root = scratch_path(t.spark, "sync")
    drain(sync.sync_stream(notices(event_stream(t)), root))
    return read_version(t.spark, f"{root}/manifest").select("run_id", "updated_at", "path")


def meter_input(events):
    k = F.get_json_object("props", "$.k").cast("double") / 100
    return events, dict(keys=["event_type"], value=F.col("value"), weight=1 + F.col("event_id") % 4, hit=F.col("value") > k * 100, conf=k)


METER_SQL = """
WITH e AS (SELECT event_type, value, 1 + event_id % 4 AS w, CAST(props->>'$.k' AS DOUBLE) / 100 AS conf FROM events),
b AS (SELECT event_type, least(floor(conf * 15), 14) AS b, sum(conf) AS c, sum(CASE WHEN value > conf * 100 THEN 1.0::DOUBLE ELSE 0 END) AS h, count(*) AS n FROM e GROUP BY 1, 2)
SELECT e.event_type, round(sum(value * w) / sum(w), 6) AS avg, round(avg(CASE WHEN value > conf * 100 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS acc, count(*) AS count, max(g.ece) AS ece
FROM e JOIN (SELECT event_type, round(sum(abs(h - c)) / sum(n) * 100, 6) AS ece FROM b GROUP BY 1) g ON g.event_type = e.event_type GROUP BY e.event_type
"""


@query("t2_meters", METER_SQL)
def batch_meters(t):
    rows, spec = meter_input(t.events)
    return meters.meter_values(meters.meter_sums(rows, **spec), ["event_type"]).select("event_type", *r6("avg", "acc", "ece"), "count")


@query("t2_meters_stream", METER_SQL)
def stream_meters(t):
    root = scratch_path(t.spark, "meters")
    rows, spec = meter_input(event_stream(t))
    drain(sync.keyed_stream(meters.meter_sums(rows, **spec), root, ["event_type", "_b15"]))
    sums = sync.current(t.spark, root, ["event_type", "_b15"])
    return meters.meter_values(sums, ["event_type"]).select("event_type", *r6("avg", "acc", "ece"), "count")


CAPPED_SQL = """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rk FROM events WHERE value >= 20)
SELECT event_type, event_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS g FROM f WHERE rk <= 30) q WHERE g <= 120
"""


@query("t3_capped_state", CAPPED_SQL)
def capped_state(t):
    root = scratch_path(t.spark, "capped")
    drain(stateful.capped_label_stream(event_stream(t), root, "event_type", "event_id", 30, 120, F.col("value") >= 20))
    return read_between(t.spark, f"{root}/accepted").select("event_type", "event_id")


@query("t3_capped_stream", CAPPED_SQL)
def capped_stream(t):
    root = scratch_path(t.spark, "capped")
    drain(sampling.capped_stream(event_stream(t), root, "event_type", "event_id", 30, 120, F.col("value") >= 20))
    return read_between(t.spark, f"{root}/accepted").select("event_type", "event_id")


FOURS_SQL = f"""
WITH e AS (SELECT event_type, event_id, user_id % 10 AS label, {u(8, 2, "'group'", 'event_id')} < 0.7::DOUBLE AS inn FROM events),
n AS (SELECT *, (row_number() OVER (PARTITION BY event_type, inn ORDER BY event_id) - 1) // 4 AS grp FROM e),
g AS (SELECT event_type, grp, count(*) AS c, min(event_id) AS lead, list(label ORDER BY event_id) AS ls FROM n WHERE inn GROUP BY event_type, grp),
d AS (SELECT *, round((0.5 + {u(8, 2, "'cx'", 'lead')}) * 224)::DOUBLE AS xc, round((0.5 + {u(8, 2, "'cy'", 'lead')}) * 224)::DOUBLE AS yc, 1.0::DOUBLE AS z FROM g WHERE c = 4),
s AS (SELECT *, {seen_sql('greatest(xc - 224, 0)', 'xc')} AS l, {seen_sql('xc', 'least(xc + 224, 448)')} AS r, {seen_sql('greatest(yc - 224, 0)', 'yc')} AS t, {seen_sql('yc', 'least(yc + 224, 448)')} AS b FROM d)
SELECT event_type, lead, array_to_string(ls, ',') AS labels, round(l * t / ((l + r) * (t + b)), 6) AS w0 FROM s
"""


@query("t4_four_group_stream", FOURS_SQL + """UNION ALL SELECT n.event_type, n.event_id, concat_ws(',', label, label, label, label), 1 FROM n LEFT JOIN g ON n.inn AND g.event_type = n.event_type AND g.grp = n.grp WHERE NOT n.inn OR g.c < 4
""")
def four_group_stream(t):
    root = scratch_path(t.spark, "fours")
    stream = event_stream(t).select("event_type", "event_id", (F.col("user_id") % 10).alias("label"))
    drain(sampling.four_group_stream(stream, root, ["event_type"], "event_id", "label", 0.7, 8, 2))
    out = sampling.flushed_groups(t.spark, root, ["event_type"], "event_id", "label")
    return out.select("event_type", F.get("members", 0).alias("lead"), F.array_join("labels", ",").alias("labels"), F.round(F.get("weights", 0), 6).alias("w0"))


@query("t4_timed_fours", FOURS_SQL + """UNION ALL SELECT event_type, event_id, concat_ws(',', label, label, label, label), 1 FROM n WHERE NOT inn
""")
def timed_fours(t):
    """Groups by list state; rows whose group is open at the end of the input still wait there."""
    root = scratch_path(t.spark, "timed")
    stream = event_stream(t).select("event_type", "event_id", (F.col("user_id") % 10).alias("label"))
    with stateful.keyed_state(t.spark):
        query = run_batches(stateful.timed_fours(stream, ["event_type"], "event_id", "label", 0.7, 8, 2), lambda rows, k: write_batch(rows, f"{root}/groups", k), f"{root}/checkpoint")
    drain(query)
    out = read_between(t.spark, f"{root}/groups")
    return out.select("event_type", F.get("members", 0).alias("lead"), F.array_join("labels", ",").alias("labels"), F.round(F.get("weights", 0), 6).alias("w0"))


@query("t5_epoch_reader", """
WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS g, count(*) OVER () AS n FROM events),
d AS (SELECT event_id, g % 6 AS worker, g // 6 AS i, CAST(ceil(ceil(2 * n / 6.0::DOUBLE) / 64) * 64 AS BIGINT) AS target, count(*) OVER (PARTITION BY g % 6) AS m FROM e)
SELECT CAST(worker AS INTEGER) AS worker, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS key_sum, max(i + r.range * m) AS last_seq FROM d, range(4) r WHERE i + r.range * m < target GROUP BY worker
""")
def epoch_reader(t):
    target = sampling.worker_target(t.events.count(), 6, repeats=2, batch=64)
    rows = sampling.epoch_rows(t.events, "event_id", 6, target)
    return rows.groupBy("worker").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("key_sum"), F.max("seq").alias("last_seq"))


@query("t5_epoch_stream", """
WITH e AS (SELECT event_id, event_id % 12 AS file, event_id % 6 AS worker, count(*) OVER () AS n FROM events),
d AS (SELECT event_id, worker, row_number() OVER (PARTITION BY worker ORDER BY file, event_id) - 1 AS i, count(*) OVER (PARTITION BY worker) AS m,
  CAST(ceil(ceil(2 * n / 6.0::DOUBLE) / 64) * 64 AS BIGINT) AS target FROM e)
SELECT CAST(worker AS INTEGER) AS worker, i + r.range * m AS seq, r.range AS epoch, event_id FROM d, range(4) r WHERE i + r.range * m < target
""")
def epoch_stream(t):
    """Twelve files in three epochs, five files a micro-batch; stopped after the first epoch and started again from the checkpoint."""
    root, folder = scratch_path(t.spark, "epoch"), scratch_path(t.spark, "files")
    t.events.select("event_id", (F.col("event_id") % 12).alias("file")).repartition(12, "file").write.partitionBy("file").parquet(folder)
    files = t.events.groupBy((F.col("event_id") % 12).alias("file")).agg(F.count(F.lit(1)).alias("rows")).withColumn("path", F.concat(F.lit(f"{folder}/file="), "file"))
    target = sampling.worker_target(t.events.count(), 6, repeats=2, batch=64)
    for stop in (1, None):
        epochs.finish(epochs.repeated_files(t.spark, files, root, "event_id", 6, target, 5, stop))
    return read_between(t.spark, f"{root}/read").select("worker", "seq", "epoch", "event_id")


@query("t6_append_history", """
SELECT user_id AS run_id, event_id // 2 AS step, round(min(value), 6) AS train_loss, round(min(value) * 2, 6) AS eval_top1, 0.1::DOUBLE AS lr FROM events GROUP BY 1, 2
""")
def append_history(t):
    root = scratch_path(t.spark, "history")
    # Both events of a step carry the same row, so that keeping either one is the same.
    stream = event_stream(t).select(F.col("user_id").alias("run_id"), F.floor(F.col("event_id") / 2).alias("step"), "value")
    loss = t.events.groupBy(F.col("user_id").alias("run_id"), F.floor(F.col("event_id") / 2).alias("step")).agg(F.min("value").alias("loss"))
    evals = stream.select("run_id", "step").join(loss, ["run_id", "step"]).select("run_id", "step", "loss", (F.col("loss") * 2).alias("top1"), F.lit(0.1).alias("lr"))
    drain(meters.append_history(evals, root, ["loss"], ["top1"], "lr"))
    return t.spark.read.parquet(f"{root}/history").select("run_id", "step", *r6("train_loss", "eval_top1"), "lr")


STATUS_SQL = """
WITH h AS (SELECT run_id, step, state, CASE WHEN step % 3 = 0 THEN config END AS cfg, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS stamp, epoch_us(ts) * 1000000::HUGEINT + step AS seq FROM hist)
SELECT run_id, min(stamp) AS created_at, max(stamp) AS updated_at, arg_max(state, seq) AS status, arg_max(cfg, seq) FILTER (WHERE cfg IS NOT NULL) AS config,
  count(*) FILTER (WHERE state = 'launched') AS launch_count, max(stamp) FILTER (WHERE state = 'launched') AS last_started_at,
  max(stamp) FILTER (WHERE state IN ('finished', 'failed', 'interrupted')) AS last_finished_at, arg_max(state, seq) = 'finished' AS finished FROM h GROUP BY run_id
"""


def status_input(events):
    """Status events; stamps are sortable text, as in the tracked runs."""
    state = F.when(F.col("event_type") == "signup", "launched").when(F.col("event_type") == "purchase", "finished").when(F.col("event_type") == "error", "failed").otherwise("running")
    return events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), state.alias("state"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("config"))


@query("t7_run_status", STATUS_SQL, uses=("hist",))
def run_status(t):
    return sync.run_status(status_input(t.events))


@query("t7_run_status_stream", STATUS_SQL, uses=("hist",))
def run_status_stream(t):
    root = scratch_path(t.spark, "status")
    drain(sync.keyed_stream(sync.run_status(status_input(event_stream(t))), root, ["run_id"]))
    return sync.current(t.spark, root, ["run_id"])
