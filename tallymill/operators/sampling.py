"""Building training sets and epoch orders from labelled rows.

Everything works on keys and labels; payload columns are joined back by the
caller once the rows are chosen. Seeded order means the order of
``md5(seed|epoch|key)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallymill.hashing import md5_key, uniform
from tallymill.plans.indexing import Order, Running, by_hash, by_number, cell_rows, first_n, indexed, running
from tallymill.plans.sizing import pin
from tallymill.session import cut_lineage


def seeded(seed: int, epoch: int, key: Column) -> Order:
    """Order of the md5 of (seed, epoch, key), ties by key."""
    return by_hash(md5_key(seed, epoch, key), key)


def long_tail_count(rank: Column, classes: Column, largest: int, smallest: int) -> Column:
    """Rows of the class at ``rank`` (0 is the largest) in an exponential profile; both ends are exact."""
    share = rank / F.greatest(classes - 1, F.lit(1))
    raw = F.bround(F.lit(float(largest)) * F.pow(F.lit(smallest / largest), share), 0).cast("bigint")
    inner = F.greatest(F.lit(smallest), F.least(F.lit(largest), raw))
    return F.when(rank == 0, F.lit(largest)).when(rank == classes - 1, F.lit(smallest)).otherwise(inner).cast("bigint")


def long_tail_profile(classes: DataFrame, largest: int, smallest: int) -> DataFrame:
    """(rank, rows) with one rank per row of ``classes`` (a table of distinct labels)."""
    if smallest < 1 or largest < smallest:
        raise ValueError("need 1 <= smallest <= largest")
    n = classes.count()
    return classes.sparkSession.range(n).select(
        F.col("id").alias("rank"), long_tail_count(F.col("id"), F.lit(n), largest, smallest).alias("rows"))


def assign_ranks(counts: DataFrame, wanted: DataFrame | Sequence[int], seed: int) -> DataFrame:
    """Gives each of the ``wanted`` counts, largest first, to a seeded-random class that has enough rows.

    ``counts`` is (label, n), ``wanted`` (rank, rows) or a list of rows by rank;
    both must be of one size. Every count goes to the class of least seeded hash
    among the large enough ones that are left. Neither table is collected.

    Counts in falling order are slots; a class is free to take any from its
    first on, and in order of hash takes the first one left. Which slots a set of
    classes takes together does not depend on their order: they are those at
    which the classes queue. So the half of lower hashes takes its slots by
    running sums over all slots, and what it leaves are the slots of the other
    half; both halves go on alone, down to parts that one task solves.
    """
    spark = counts.sparkSession
    if not isinstance(wanted, DataFrame):
        wanted = spark.createDataFrame([(r, int(n)) for r, n in enumerate(wanted)], "rank long, rows long")
    both = counts.select(F.lit(0).alias("kind"), F.col("label"), F.col("n").cast("bigint").alias("v"), F.lit(None).cast("bigint").alias("rank")).unionByName(
        wanted.select(F.lit(1).alias("kind"), F.col("rows").cast("bigint").alias("v"), F.col("rank").cast("bigint").alias("rank")), allowMissingColumns=True)
    falling = both.withColumn("down", -F.col("v"))
    placed = cut_lineage(running(falling, [], by_number(F.col("down"), F.col("kind"), F.col("rank"), F.col("label").cast("string")), {"_at": Running("sum", F.col("kind"))}))
    classes = placed.where("kind = 0").select("label", F.col("_at").alias("first"), F.lit(0).cast("bigint").alias("node"))
    # A class whose first slot lies behind the last one has no place: its own check finds the slot that stays empty.
    classes = cut_lineage(indexed(classes, [], by_hash(md5_key(seed, F.col("label")), F.col("label")), "place"))
    slots = placed.where("kind = 1").select("rank", F.col("v").alias("rows"), (F.col("_at") - 1).alias("slot"), F.lit(0).cast("bigint").alias("node"))
    n, size = classes.count(), slots.count()
    if n != size:
        raise ValueError(f"{size} counts for {n} classes")

    def queued(some: DataFrame) -> DataFrame:
        """Slots with ``_in``, how many of ``some`` classes are free to take them or an earlier one."""
        arrived = some.groupBy("node", F.col("first").alias("slot")).agg(F.count(F.lit(1)).alias("_c"))
        return running(slots.join(arrived, ["node", "slot"], "left").fillna(0, ["_c"]), ["node"], by_number(F.col("slot")), {"_in": Running("sum", F.col("_c"))})

    short = queued(classes).where(F.col("slot") + 1 > F.col("_in")).orderBy("slot").limit(1).collect()
    if short:
        raise ValueError(f"no class left with {short[0]['rows']} rows")
    part, leaf = 1 << math.ceil(math.log2(max(n, 1))), cell_rows(counts)
    while part > leaf:
        part //= 2
        lower = F.floor(F.col("place") / part) % 2 == 0
        lag = queued(classes.where(lower)).withColumn("_lag", F.col("slot") + 1 - F.col("_in"))
        lag = running(lag, ["node"], by_number(F.col("slot")), {"_before": Running("max_before", F.col("_lag"))})
        # Slots that the lower half leaves free before a slot, and up to it.
        before = F.greatest(F.coalesce("_before", F.lit(0)), F.lit(0))
        free = cut_lineage(lag.select("rank", "rows", "slot", "node", before.alias("_before"), F.greatest(before, "_lag").alias("_free")))
        at = free.select("node", F.col("slot").alias("first"), "_before")
        # A class of the lower half queues at its own first slot, so that one is taken.
        classes = cut_lineage(classes.join(at, ["node", "first"], "left").select(
            "label", "place", F.when(lower, F.col("first") - F.col("_before")).otherwise(F.col("_before")).alias("first"),
            (F.col("node") * 2 + F.when(lower, 0).otherwise(1)).alias("node")))
        taken = F.col("_free") == F.col("_before")
        slots = free.select(
            "rank", "rows", F.when(taken, F.col("slot") - F.col("_free")).otherwise(F.col("_free") - 1).alias("slot"),
            (F.col("node") * 2 + F.when(taken, 0).otherwise(1)).alias("node"))
    label = counts.schema["label"].dataType.simpleString()
    pairs = classes.groupBy("node").cogroup(slots.groupBy("node"))
    return pairs.applyInPandas(_first_free, f"label {label}, rank int, rows bigint")


def _first_free(classes, slots):
    """One part: classes in order of hash take the first slot left from their first one on, by union-find over slots."""
    slots = slots.sort_values("slot")
    after, took = list(range(len(slots) + 1)), []
    for first in classes.sort_values("place")["first"]:
        at, seen = int(first), []
        while after[at] != at:
            seen.append(at)
            at = after[at]
        for k in seen:
            after[k] = at
        took.append(at)
        after[at] = at + 1
    chosen = slots.iloc[took]
    return pd.DataFrame({"label": classes.sort_values("place")["label"].to_numpy(), "rank": chosen["rank"].to_numpy(), "rows": chosen["rows"].to_numpy()})


def select_long_tail(df: DataFrame, label: str, key: str, counts: DataFrame, seed: int) -> DataFrame:
    """``rows`` rows of each class of ``counts`` (label, rows) in seeded order, with a seeded global position.

    A class with too few rows is an error, found from class counts before any row is moved.
    """
    have = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    short = counts.join(have, "label", "left").where(F.coalesce("n", F.lit(0)) < F.col("rows")).limit(20).collect()
    if short:
        raise ValueError(f"classes missing or short: {[(r['label'], r['rows'], r['n']) for r in short]}")
    local, _ = pin(counts.select(F.col("label").alias(label), F.col("rows").alias("_rows")))
    picked = first_n(df.join(local, label), [label], seeded(seed, 0, F.col(key)), F.col("_rows")).drop("_rows")
    return indexed(picked, [], by_hash(md5_key(seed, "order", F.col(key)), F.col(key)), "position")


def source_pool(df: DataFrame, base: str, path: str, n: int, seed: int, strict: bool = True) -> DataFrame:
    """``n`` rows in seeded order after copies that share a basename are reduced to the first path."""
    keep = df.groupBy(base).agg(F.min(path).alias(path))
    pool = first_n(keep, [], seeded(seed, 0, F.col(base)), n, "position")
    if strict:
        have = pool.count()
        if have < n:
            raise ValueError(f"pool has {have} of {n} rows")
    return pool.join(df, [base, path])


def stratified_cap(df: DataFrame, stratum: str, key: str, cap: int, seed: int, explicit: Sequence | None = None) -> DataFrame:
    """At most ``cap`` seeded rows per stratum; an explicit key list replaces the sampling."""
    if explicit is not None:
        return df.where(F.col(key).isin(list(explicit)))
    return first_n(df, [stratum], seeded(seed, 0, F.col(key)), cap)


def capped_label_sample(
    df: DataFrame, label: str, key: str, size: Column, n: int, max_per_label: int, min_size: int, allowed: Sequence | None = None,
) -> DataFrame:
    """Rows visited in key order up to the n-th accepted one, each with its outcome.

    The first failing test names the outcome: ``label`` (not allowed), ``cap``
    (the label already has ``max_per_label`` accepted rows), ``size`` (too
    small); accepted rows have ``accepted`` and their number. Two running sums,
    no sequential pass.
    """
    permitted = F.col(label).isin(list(allowed)) if allowed is not None else F.lit(True)
    fits = permitted & (size >= min_size)
    order = by_number(F.col(key))
    marked = running(df.withColumn("_fits", fits.cast("int")), [label], order, {"_seen": Running("sum", F.col("_fits"))})
    before = F.col("_seen") - F.col("_fits")
    outcome = F.when(~permitted, "label")
    if max_per_label > 0:
        outcome = outcome.when(before >= max_per_label, "cap")
    outcome = outcome.when(F.col("_fits") == 0, "size").otherwise("accepted")
    marked = marked.withColumn("outcome", outcome).drop("_seen", "_fits")
    ok = (F.col("outcome") == "accepted").cast("int")
    total = running(marked.withColumn("_ok", ok), [], order, {"number": Running("sum", F.col("_ok"))},
                    keep=F.coalesce(F.col("__before_number"), F.lit(0)) < n)
    visited = total.where(F.col("number") - F.col("_ok") < n)
    return visited.withColumn("number", F.when(F.col("_ok") == 1, F.col("number"))).drop("_ok")


def class_sizes(df: DataFrame, label: str) -> tuple[DataFrame, list | None]:
    """(label, n), fixed so that all uses agree; see :func:`pin`."""
    return pin(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")))


def resampled_schedule(df: DataFrame, label: str, key: str, mode: str | int, seed: int, epoch: int) -> DataFrame:
    """M cycles with one row per class drawn with replacement, shuffled within the cycle.

    M is the smallest (``min``) or largest (``max``) class, or the given number.
    The draws are generated as rows (cycle, class) and joined to the members by
    (class, index), so a large class is spread over its indexes.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    low, high, classes = sizes.agg(F.min("n"), F.max("n"), F.count(F.lit(1))).first()
    cycles = low if mode == "min" else high if mode == "max" else int(mode)
    if cycles < 1:
        raise ValueError("need at least one cycle")
    numbered, _ = pin(indexed(sizes, [], by_hash(md5_key("class", F.col(label)), F.col(label)), "_class"))
    draws = df.sparkSession.range(cycles * classes).select(
        F.floor(F.col("id") / classes).alias("cycle"), (F.col("id") % classes).alias("_class")).join(numbered, "_class")
    draws = draws.withColumn("_member", F.floor(uniform(seed, epoch, F.col("cycle"), F.col(label)) * F.col("n")))
    members = indexed(df.select(label, key), [label], by_number(F.col(key)), "_member")
    # Places come from the draws alone, before the members are attached. A cycle holds one row per class, which
    # can be many; all cycles are equally long, so their size is known.
    inside = by_hash(md5_key(seed, epoch, "cycle", F.col("cycle"), F.col(label)), F.col(label))
    each = df.sparkSession.range(cycles).select(F.col("id").alias("cycle"), F.lit(classes).alias("n"))
    placed = indexed(draws.drop("n"), ["cycle"], inside, "pos", sizes=each)
    return placed.join(members, [label, "_member"]).select("cycle", "pos", label, key)


def natural_schedule(df: DataFrame, label: str, key: str, seed: int, epoch: int) -> DataFrame:
    """Every row once: ``level`` is its place in its class's seeded shuffle, ``pos`` its seeded place in the level,
    ``level_rows`` the size of the level. A level holds at most one row per class."""
    levels = indexed(df, [label], seeded(seed, epoch, F.col(key)), "level")
    # Level 0 has a row of every class: with many small classes it is a large share of the table, so places inside a
    # level take the cell plan too.
    sizes, _ = pin(levels.groupBy("level").agg(F.count(F.lit(1)).alias("n")))
    inside = by_hash(md5_key(seed, epoch, "level", F.col(key)), F.col(key))
    return indexed(levels, ["level"], inside, "pos", sizes=sizes).join(sizes.withColumnRenamed("n", "level_rows"), "level")


def natural_mixed_schedule(df: DataFrame, label: str, key: str, seed: int, epoch: int, buffer: int, row_size: int) -> DataFrame:
    """Class members spread evenly over the epoch, shuffled inside windows of ``buffer`` rows, cut into rows."""
    sizes, rows = class_sizes(df, label)
    total = sum(r["n"] for r in rows) if rows is not None else sizes.agg(F.sum("n")).first()[0]
    total = int(total or 0)
    ranked = indexed(df, [label], seeded(seed, epoch, F.col(key)), "_i").join(sizes, label)
    spacing = F.lit(float(total)) / F.col("n")
    center = F.when(F.col("n") == 1, F.lit(0.5 * max(1, total))).otherwise((F.col("_i") + 0.5) * spacing)
    jitter = (uniform(seed, epoch, "jitter", F.col(key)) - 0.5) * F.least(spacing, F.lit(1.0))
    place = F.greatest(F.lit(0.0), F.least(F.lit(float(max(0, total - 1))), center + jitter))
    placed = ranked.withColumn("place", place).drop("n", "_i")
    # Places are spread evenly over the epoch by construction, so cells need no quantiles.
    order = Order((F.asc("place"), F.asc(key)), F.least(F.col("place") / max(1, total), F.lit(0.9999999999)), unit=True)
    spread = indexed(placed, [], order, "_g")
    window = max(1, min(buffer, total))
    spread = spread.withColumn("_chunk", F.floor(F.col("_g") / window))
    inside = Window.partitionBy("_chunk").orderBy(md5_key(seed, epoch, "chunk", F.col(key)), F.col(key))
    slot = F.col("_chunk") * window + F.row_number().over(inside) - 1
    out = spread.withColumn("slot", slot).drop("_g", "_chunk")
    return out.withColumns({"row": F.floor(F.col("slot") / row_size), "col": (F.col("slot") % row_size).cast("int")})


def random_tuples(pool: DataFrame, key: str, m: int, k: int, seed: int, existing: DataFrame | None = None) -> DataFrame:
    """``m`` tuples of ``k`` distinct pool rows as rows (sample_id, slot, key), a function of (seed, k, i).

    The positions come from a k-step distinct draw inside the row (no rejection,
    no m x N pairs) and meet the pool by an equi-join on its index. Ids already
    in ``existing`` (sample_id) are skipped, so a run can be continued.
    """
    size = pool.count()
    if k > size:
        raise ValueError(f"cannot draw {k} distinct rows from {size}")
    wanted = pool.sparkSession.range(m).select(
        F.format_string("k%02d_%05d", F.lit(k), F.col("id")).alias("sample_id"), F.col("id").alias("_i"))
    if existing is not None:
        wanted = wanted.join(existing.select("sample_id"), "sample_id", "left_anti")

    def draw(taken, j):
        top = j.cast("bigint") + F.lit(size - k)
        pick = F.floor(uniform(seed, k, F.col("_i"), j) * (top + 1))
        return F.concat(taken, F.array(F.when(F.array_contains(taken, pick), top).otherwise(pick)))

    picks = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array().cast("array<bigint>"), draw)
    slots = wanted.select("sample_id", F.posexplode(picks).alias("slot", "_at"))
    members = indexed(pool.select(key), [], by_number(F.col(key)), "_at")
    return slots.join(members, "_at").select("sample_id", "slot", key)


def check_same_config(stored: dict, current: dict) -> None:
    """Continuing a table written under another configuration is an error."""
    differing = {k: (stored.get(k), current.get(k)) for k in {*stored, *current} if stored.get(k) != current.get(k)}
    if differing:
        raise ValueError(f"configuration differs from the stored one: {differing}")


def shard_assign(df: DataFrame, key: str, n: int, mode: str) -> DataFrame:
    """Adds ``shard`` and ``seq`` by key order.

    ``round_robin``: row i goes to i mod n. ``strided``: the same, with the first
    rows repeated so that all shards have equal length (``padding`` marks the
    copies). ``contiguous``: shard s is rows round(s*N/n) to round((s+1)*N/n).
    """
    rows = indexed(df, [], by_number(F.col(key)), "_i")
    if mode == "round_robin":
        return rows.withColumns({"shard": F.col("_i") % n, "seq": F.floor(F.col("_i") / n)}).drop("_i")
    total = df.count()
    if mode == "strided":
        padding = -total % n
        # The copies come from the same pass as the rows.
        both = rows.withColumn("padding", F.explode(F.when(F.col("_i") < padding, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
        both = both.withColumn("_i", F.col("_i") + F.when(F.col("padding"), total).otherwise(0))
        return both.withColumns({"shard": F.col("_i") % n, "seq": F.floor(F.col("_i") / n)}).drop("_i")
    if mode == "contiguous":
        edge = lambda s: F.bround(s * F.lit(float(total)) / n, 0)
        guess = F.floor(F.col("_i") * n / F.lit(total))
        shard = F.when(edge(guess + 1) <= F.col("_i"), guess + 1).when(edge(guess) > F.col("_i"), guess - 1).otherwise(guess)
        out = rows.withColumn("shard", shard.cast("bigint"))
        return out.withColumn("seq", (F.col("_i") - edge(F.col("shard"))).cast("bigint")).drop("_i")
    raise ValueError(f"unknown mode {mode!r}")


def repeat_sampler(df: DataFrame, key: str, repeats: float, ranks: int, epoch: int, selected_round: int = 256,
                   selected_ratio: float | None = None, shuffle: bool = True) -> DataFrame:
    """Seeded order with each row ``repeats`` times in a row, padded, strided over ranks and cut to the selected length.

    Output rows: key, rank, seq. A row's copies are computed from its own position, so no order is materialised.
    """
    total = df.count()
    order = seeded(0, epoch, F.col(key)) if shuffle else by_number(F.col(key))
    rows = indexed(df.select(key), [], order, "_p")
    per_rank = math.ceil(total * repeats / ranks)
    padded = per_rank * ranks
    ratio = selected_ratio or ranks
    selected = math.floor(total // selected_round * selected_round / ratio) if selected_round else math.ceil(total / ratio)
    length = math.ceil(repeats * total)
    # Slots i with floor(i / repeats) == p, i.e. from ceil(p*r) up to ceil((p+1)*r) - 1.
    first = F.ceil(F.col("_p") * F.lit(float(repeats)))
    last = F.least(F.ceil((F.col("_p") + 1) * F.lit(float(repeats))), F.lit(length)) - 1
    slots = rows.where(first <= last).withColumn("_s", F.explode(F.sequence(first, last)))
    extra = slots.where(F.col("_s") < padded - length).withColumn("_s", F.col("_s") + length)
    both = slots.unionByName(extra) if padded > length else slots
    out = both.select(key, (F.col("_s") % ranks).cast("int").alias("rank"), F.floor(F.col("_s") / ranks).alias("seq"))
    return out.where(F.col("seq") < selected)


def batch_rows(seq_len: int, max_tokens: int, divisor: int) -> int:
    return max(1, max_tokens // seq_len // divisor * divisor if divisor > 1 else max_tokens // seq_len)


def token_schedule(spark: SparkSession, rows: int, seq_lens: Sequence[int], max_tokens: int, divisor: int, seed: int) -> DataFrame:
    """(batch, seq_len, rows): seeded sequence lengths with as many rows as fit the token budget, until all rows are used."""
    sizes = [batch_rows(s, max_tokens, divisor) for s in seq_lens]
    most = math.ceil(rows / min(sizes))
    pick = F.floor(uniform(seed, "length", F.col("id")) * len(sizes)).cast("int")
    draws = spark.range(most).withColumn("_s", pick).select(
        F.col("id").alias("batch"), F.lit(list(seq_lens))[F.col("_s")].alias("seq_len"), F.lit(sizes)[F.col("_s")].cast("bigint").alias("rows"))
    ends = running(draws, [], by_number(F.col("batch")), {"_end": Running("sum", F.col("rows"))})
    start = F.col("_end") - F.col("rows")
    return ends.where(start < rows).select("batch", "seq_len", F.least(F.col("rows"), F.lit(rows) - start).alias("rows"))


def token_batches(df: DataFrame, key: str, seq_lens: Sequence[int], max_tokens: int, divisor: int, seed: int, epoch: int) -> DataFrame:
    """Assigns every row a batch of the schedule: (key, batch, seq_len, batch_rows, place).

    Batch order and row order are shuffled per epoch. Rows find their batch by a
    range join that is an equi-join on blocks: an interval is at most ``width``
    long, so it touches at most two blocks of that width.
    """
    total = df.count()
    schedule = token_schedule(df.sparkSession, total, seq_lens, max_tokens, divisor, seed)
    order = by_hash(md5_key(seed, epoch, "batch", F.col("batch")), F.col("batch"))
    placed = running(schedule, [], order, {"_end": Running("sum", F.col("rows"))}).withColumn("_start", F.col("_end") - F.col("rows"))
    width = max(batch_rows(s, max_tokens, divisor) for s in seq_lens)
    block = lambda x: F.floor(x / width)
    spans = placed.withColumn("_block", F.explode(F.array_distinct(F.array(block(F.col("_start")), block(F.col("_end") - 1)))))
    rows = indexed(df.select(key), [], seeded(seed, epoch, F.col(key)), "_g").withColumn("_block", block(F.col("_g")))
    inside = (F.col("_g") >= F.col("_start")) & (F.col("_g") < F.col("_end"))
    return rows.join(spans, "_block").where(inside).select(
        key, "batch", "seq_len", F.col("rows").alias("batch_rows"), (F.col("_g") - F.col("_start")).alias("place"))


def balanced_split(df: DataFrame, key: str, n: int, seed: int, defaults: dict | None = None) -> DataFrame:
    """Seeded shuffle dealt round-robin into ``n`` parts, with NULLs filled from ``defaults``. Duplicate keys are an error."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate keys: {[r[key] for r in twice]}")
    out = indexed(df, [], seeded(seed, 0, F.col(key)), "_i")
    out = out.withColumns({"part": (F.col("_i") % n).cast("int"), "seq": F.floor(F.col("_i") / n)}).drop("_i")
    return out.fillna(defaults) if defaults else out


def resample_shards(shards: DataFrame, shard: str, n: int, seed: int, epoch: int, worker: int = 0) -> DataFrame:
    """``n`` shards drawn with replacement for one worker and epoch: (draw, shard...)."""
    total = shards.count()
    draws = shards.sparkSession.range(n).select(
        F.col("id").alias("draw"), F.floor(uniform(seed, epoch, worker, F.col("id")) * total).alias("_at"))
    return draws.join(indexed(shards, [], by_number(F.col(shard)), "_at"), "_at").drop("_at")
