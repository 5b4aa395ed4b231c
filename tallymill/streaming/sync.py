"""Incremental run synchronisation and run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.plans.indexing import by_hash, first_n
from tallymill.hashing import md5_key
from tallymill.streaming.tables import latest_by_key, newest_id, read_between, read_version, run_batches, write_batch

FINAL_STATES = ("finished", "failed", "interrupted")


def server_time(*stamps: Column) -> Column:
    """First non-empty of heartbeat, updated and created; empty text if none."""
    return F.coalesce(*[F.when(s != "", s) for s in stamps], F.lit(""))


def newest_per_run(incoming: DataFrame, run: str = "run_id", order: str = "ord") -> DataFrame:
    """One row per run: its latest notice."""
    values = [c for c in incoming.columns if c != run]
    return incoming.groupBy(run).agg(F.max_by(F.struct(*values), order).alias("_v")).select(run, "_v.*")


def sync_decisions(
    incoming: DataFrame, manifest: DataFrame, inventory: DataFrame | None = None, want_files: bool = False, force: bool = False, limit: int | None = None,
) -> DataFrame:
    """Per incoming run the reason to refresh it, or ``fresh``.

    ``incoming`` is (run_id, heartbeat_at, updated_at, created_at, ord), ``manifest``
    (run_id, updated_at, include_files, path), ``inventory`` the existing paths.
    A different stamp refreshes, newer or not. ``limit`` bounds the runs looked at.
    """
    runs = newest_per_run(incoming)
    if limit is not None:
        runs = first_n(runs, [], by_hash(md5_key(F.col("run_id")), F.col("run_id")), limit)
    known = manifest.select("run_id", F.col("updated_at").alias("_known"), F.col("include_files").alias("_files"), F.col("path").alias("_path"))
    out = runs.withColumn("server_at", server_time(F.col("heartbeat_at"), F.col("updated_at"), F.col("created_at"))).join(known, "run_id", "left")
    if inventory is not None:
        out = out.join(inventory.select(F.col("path").alias("_path")).distinct().withColumn("_there", F.lit(True)), "_path", "left")
    else:
        out = out.withColumn("_there", F.lit(True))
    reason = F.when(F.lit(force), "forced").when(F.col("_known").isNull(), "new").when(F.col("_known") != F.col("server_at"), "changed")
    if want_files:
        reason = reason.when(~F.col("_files"), "files")
    reason = reason.when(F.col("_there").isNull(), "vanished").otherwise("fresh")
    return out.withColumn("reason", reason).drop("_known", "_files", "_path", "_there")


def sync_counters(decisions: DataFrame) -> DataFrame:
    """One row: scanned, downloaded, skipped, failed. A run with ``failed`` set counts as failed, not downloaded."""
    failed = F.col("failed") if "failed" in decisions.columns else F.lit(False)
    refresh = F.col("reason") != "fresh"
    return decisions.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(refresh & ~failed).alias("downloaded"), F.count_if(~refresh).alias("skipped"),
        F.count_if(refresh & failed).alias("failed"))


def upsert_manifest(manifest: DataFrame, decisions: DataFrame, want_files: bool = False) -> DataFrame:
    """The manifest after the refresh: refreshed runs replaced, all others kept. Failed runs keep their old entry."""
    done = decisions.where("reason <> 'fresh'")
    if "failed" in decisions.columns:
        done = done.where("NOT failed")
    fresh = done.select("run_id", F.col("server_at").alias("updated_at"), F.lit(want_files).alias("include_files"), F.concat(F.lit("runs/"), F.col("run_id").cast("string")).alias("path"))
    return manifest.join(fresh, "run_id", "left_anti").select("run_id", "updated_at", "include_files", "path").unionByName(fresh)


def sync_stream(
    stream: DataFrame, root: str, want_files: bool = False, force: bool = False, refresh=None, available_now: bool = True,
    inventory=None, limit: int | None = None,
):
    """Keeps a manifest below ``root`` in step with a stream of run notices.

    ``refresh(decisions)`` may fetch the runs and return the decisions with a
    ``failed`` column. ``inventory()`` gives the paths that exist now; runs
    whose path is gone are refreshed. ``limit`` bounds the runs looked at per
    micro-batch: notices of the others wait below ``root``/waiting and join the
    next one. Manifest versions, decisions and counters are written per
    micro-batch, so no table is overwritten while it is read; add the counters
    up with :func:`stream_counters`.
    """
    spark = stream.sparkSession

    def process(batch: DataFrame, batch_id: int):
        manifest = read_version(spark, f"{root}/manifest", batch_id)
        if manifest is None:
            manifest = spark.createDataFrame([], f"run_id {batch.schema['run_id'].dataType.simpleString()}, updated_at string, include_files boolean, path string")
        incoming = batch
        if limit is not None:
            waiting = read_version(spark, f"{root}/waiting", batch_id)
            incoming = batch if waiting is None else batch.unionByName(waiting)
        decisions = sync_decisions(incoming, manifest, None if inventory is None else inventory(), want_files, force, limit)
        if refresh is not None:
            decisions = refresh(decisions)
        write_batch(decisions, f"{root}/decisions", batch_id)
        stored = spark.read.parquet(f"{root}/decisions/batch_id={batch_id}")
        write_batch(sync_counters(stored), f"{root}/counters", batch_id)
        if limit is not None:
            write_batch(incoming.join(stored.select("run_id"), "run_id", "left_anti"), f"{root}/waiting", batch_id)
        write_batch(upsert_manifest(manifest, stored, want_files), f"{root}/manifest", batch_id)

    return run_batches(stream, process, f"{root}/checkpoint", available_now=available_now)


def stream_counters(spark, root: str) -> DataFrame:
    """One row: the counters of all micro-batches so far."""
    return read_between(spark, f"{root}/counters").agg(*[F.sum(n).alias(n) for n in ("scanned", "downloaded", "skipped", "failed")])


def run_status(events: DataFrame, run: str = "run_id", optional=("config",)) -> DataFrame:
    """Fold of status events (ts, step, state, optional fields) into one row per run.

    An ``optional`` field keeps its latest value that is not NULL. Works on a
    batch and, in update mode, on a stream: every aggregate merges.
    """
    at = F.struct("ts", "step")
    final = F.col("state").isin(*FINAL_STATES)
    return events.groupBy(run).agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max_by("state", at).alias("status"),
        *[F.max_by(f"`{name}`", F.when(F.col(f"`{name}`").isNotNull(), at)).alias(name) for name in optional], F.count_if(F.col("state") == "launched").alias("launch_count"),
        F.max(F.when(F.col("state") == "launched", F.col("ts"))).alias("last_started_at"), F.max(F.when(final, F.col("ts"))).alias("last_finished_at"),
    ).withColumn("finished", F.col("status") == "finished")


def keyed_stream(aggregated: DataFrame, root: str, keys, available_now: bool = True, snapshot_every: int = 100):
    """Runs a streaming aggregation in update mode into an update log below ``root``; read it with :func:`current`.

    A batch writes only the keys it changed. Every ``snapshot_every`` batches the
    current rows are written as a snapshot, so a reader never folds a longer log.
    """
    spark = aggregated.sparkSession

    def process(batch: DataFrame, batch_id: int):
        write_batch(batch, f"{root}/log", batch_id)
        if batch_id % snapshot_every == snapshot_every - 1:
            write_batch(current(spark, root, keys, batch_id), f"{root}/snapshot", batch_id)

    return run_batches(aggregated, process, f"{root}/checkpoint", mode="update", available_now=available_now, keep=False)


def current(spark, root: str, keys, last: int | None = None) -> DataFrame:
    """The rows of an update log as of its newest batch (or batch ``last``)."""
    start = newest_id(spark, f"{root}/snapshot", last)
    log = read_between(spark, f"{root}/log", start, last)
    if start is not None:
        base = read_between(spark, f"{root}/snapshot", start - 1, start)
        log = base if log is None else base.unionByName(log)
    return latest_by_key(log, keys)
