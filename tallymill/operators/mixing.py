"""Mixed-label groups and pairs over scheduled rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymill.functions.binding import let
from tallymill.hashing import md5_key, uniform, unit_from_hex
from tallymill.plans.indexing import Order, Running, by_number, indexed, running


def level_weights(k: int, seed: int, epoch: int, level: Column, alpha: float | Column = 1.0) -> Column:
    """Ascending weights of one draw per level from a symmetric Dirichlet distribution.

    ``alpha <= 0`` gives equal weights. For ``alpha = 1`` the draw is the
    normalised ``-ln(u)`` of hash uniforms; other values take gamma draws.
    """
    equal = F.array(*[F.lit(1.0 / k)] * k)
    key = md5_key(seed, epoch, "weights", level)
    if isinstance(alpha, Column):
        return F.when(alpha <= 0, equal).otherwise(_dirichlet(k, key, alpha))
    if alpha <= 0:
        return equal
    if alpha != 1:
        return _dirichlet(k, key, F.lit(float(alpha)))
    ordered = F.array_sort(F.array(*[-F.ln(uniform(seed, epoch, "weights", level, j) + 1e-12) for j in range(k)]))
    return F.transform(ordered, lambda w: w / F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + x))


GAMMA_TRIES = 64


def log_gamma_draw(key: Column, name, alpha: Column) -> Column:
    """Logarithm of a gamma draw (shape ``alpha`` > 0) that depends on ``key`` and ``name`` alone.

    Squeezed normal cubes by Marsaglia and Tsang, tried inside the row until one
    is accepted (at least 95 % a try; a row in 10^83 would need more than there
    are); shapes below one are drawn one higher and scaled by a power of a
    uniform, in logarithms, so that small shapes don't vanish.
    """
    tiny = 2.0 ** -33
    u = lambda what, t: uniform(key, name, what, t) + tiny
    shape = F.when(alpha < 1, alpha + 1).otherwise(alpha) - 1.0 / 3

    def attempt(t: Column) -> Column:
        normal = F.sqrt(-2 * F.ln(u("r", t))) * F.cos(2 * math.pi * u("c", t))
        return let(normal, lambda x: let((1 + x / F.sqrt(9 * shape)) ** 3, lambda v: F.when(
            (v > 0) & (F.ln(u("a", t)) < 0.5 * x * x + shape - shape * v + shape * F.ln(v)), F.ln(shape * v))))

    # A try is only made where the ones before it failed.
    none = F.lit(None).cast("double")
    drawn = F.aggregate(F.sequence(F.lit(0), F.lit(GAMMA_TRIES - 1)), none, lambda found, t: F.when(found.isNotNull(), found).otherwise(attempt(t)))
    return F.coalesce(drawn, F.ln(shape)) + F.when(alpha < 1, F.ln(u("s", 0)) / alpha).otherwise(0.0)


def _dirichlet(k: int, key: Column, alpha: Column, ascending: bool = True) -> Column:
    """A symmetric Dirichlet draw per hex key: normalised gamma draws, as Columns."""
    logs = F.array(*[log_gamma_draw(key, j, F.greatest(alpha, F.lit(1e-6))) for j in range(k)])

    def shares(x: Column) -> Column:
        return let(F.transform(x, lambda v: F.exp(v - F.array_max(x))), lambda e: F.transform(
            F.array_sort(e) if ascending else e, lambda w: w / F.aggregate(e, F.lit(0.0), lambda acc, y: acc + y)))

    return let(logs, shares)


def beta_draw(key: Column, alpha: float) -> Column:
    """Symmetric Beta draw for a hex key: uniform for ``alpha = 1``, else the first share of a two-way draw."""
    if alpha == 1:
        return unit_from_hex(key)
    return _dirichlet(2, key, F.lit(float(alpha)), ascending=False)[0]


def mix_groups(schedule: DataFrame, label: str, key: str, k: int, weights: Column, seed: int, epoch: int) -> DataFrame:
    """Mixed targets from a level schedule (level, pos, level_rows, label, key).

    Consecutive k rows of a level form a group; output s of a group has the
    group's labels rotated by s, with ascending ``weights``. A remainder r < k
    leads a last group filled with seeded earlier rows of the level and gives its
    first r outputs only. Levels below k rows give single-label targets with the
    label in the last slot. Every scheduled row leads exactly one output.

    Places in a level are a seeded shuffle already, so the fill rows are a run of places from a seeded start: no
    further ordering is needed.
    """
    n, pos = F.col("level_rows"), F.col("pos")
    rest = n % k
    full = n - rest
    start = F.floor(uniform(seed, epoch, "fill", F.col("level")) * full)
    fill = F.when((n >= k) & (rest > 0) & (pos < full), F.pmod(pos - start, full))
    rows = schedule.withColumn("_fill", fill)
    group = F.floor(F.col("pos") / k)
    home = F.struct(
        F.when(n < k, pos.cast("bigint")).otherwise(group).alias("group"), F.when(n < k, F.lit(0)).otherwise((pos % k).cast("int")).alias("slot"),
        F.lit(True).alias("leads"))
    guest = F.struct((full / k).cast("bigint").alias("group"), (rest + F.col("_fill")).cast("int").alias("slot"), F.lit(False).alias("leads"))
    fills = F.coalesce(F.col("_fill") < k - rest, F.lit(False))
    member = rows.select("level", "level_rows", key, label, F.inline(F.when(fills, F.array(home, guest)).otherwise(F.array(home))))
    # At most k rows per (level, group).
    packed = member.groupBy("level", "group").agg(
        F.first("level_rows").alias("level_rows"), F.count_if("leads").alias("outputs"),
        F.sort_array(F.collect_list(F.struct("slot", label, key))).alias("_m"))
    out = packed.withColumn("shift", F.explode(F.sequence(F.lit(0), F.col("outputs").cast("int") - 1)))
    ring = lambda name: F.concat(
        F.slice(F.transform("_m", lambda s: s[name]), F.col("shift") + 1, k), F.slice(F.transform("_m", lambda s: s[name]), F.lit(1), F.col("shift")))
    single = F.col("level_rows") < k
    weighed = F.transform(
        F.arrays_zip(ring(label).alias("label"), weights.alias("weight")), lambda s: F.struct(s["label"].alias("label"), s["weight"].alias("weight")))
    lone = F.array(F.struct(F.get(F.transform("_m", lambda s: s[label]), 0).alias("label"), F.lit(1.0).alias("weight")))
    return out.select(
        "level", "group", "shift", ring(key)[0].alias(key), (~single).alias("mixed"), F.when(single, lone).otherwise(weighed).alias("target"))


def batched(df: DataFrame, order: Order, batch_size: int) -> DataFrame:
    """Adds ``batch``, ``pos`` and ``batch_rows`` along a global order; the last batch may be short."""
    total = df.count()
    rows = indexed(df, [], order, "_g")
    batch = F.floor(F.col("_g") / batch_size)
    size = F.least(F.lit(batch_size), F.lit(total) - batch * batch_size)
    return rows.withColumns({"batch": batch, "pos": (F.col("_g") % batch_size).cast("int"), "batch_rows": size.cast("int")}).drop("_g")


def pair_mix(
    rows: DataFrame, key: str, label: str, mode: str = "batch", alpha: float = 1.0, prob: float = 1.0, cut_prob: float = 0.0,
    height: int = 224, width: int = 224, seed: int = 0, epoch: int = 0, payload: str | None = None, cut_alpha: float | None = None,
    box_range: tuple[float, float] | None = None, correct: bool = True,
) -> DataFrame:
    """Each row of a batch mixed with its mirror (position B-1-i): ``lam * own + (1-lam) * partner``.

    ``mode`` says what shares a draw: the ``batch``, the ``pair`` or each ``elem``.
    With ``cut_prob`` a draw cuts a box instead, of lam's area around a centre
    drawn (lam by ``cut_alpha`` if given), and lam becomes one minus the area
    share of what lies inside, unless ``correct`` is off. With ``box_range``
    (least and greatest share of a side) both sides are drawn, the box lies
    inside, and its area always decides. ``rows`` come from :func:`batched`;
    ``payload`` is an ARRAY<DOUBLE> read as height x width for the cut.
    """
    own, mirror = F.col("pos"), F.col("batch_rows") - 1 - F.col("pos")
    scope = {"batch": F.lit(0), "pair": F.least(own, mirror), "elem": own}
    if mode not in scope:
        raise ValueError(f"unknown mode {mode!r}")
    draw = lambda what: md5_key(seed, epoch, what, F.col("batch"), scope[mode])
    unit = lambda what: beta_draw(draw(what), 1)
    right = rows.select(
        F.col("batch"), mirror.alias("pos"), F.col(key).alias("partner"), F.col(label).alias("partner_label"),
        *([F.col(payload).alias("_other")] if payload else []))
    out = rows.join(right, ["batch", "pos"])
    drawn = beta_draw(draw("lam"), alpha)
    if cut_prob > 0 and cut_alpha is not None:
        drawn = F.when(unit("cut") < cut_prob, beta_draw(draw("lam"), cut_alpha)).otherwise(drawn)
    lam = F.when(unit("use") < prob, drawn).otherwise(F.lit(1.0))
    out = out.withColumn("lam", lam)
    if cut_prob > 0:
        # A skipped draw keeps lam = 1: the box is then empty.
        out = out.withColumn("cut", (unit("cut") < cut_prob) & (F.col("lam") < 1))
        out = out.withColumn("_box", _ranged_box(unit, box_range, height, width) if box_range else _lam_box(unit, height, width))
        area = (F.col("_box.y1") - F.col("_box.y0")) * (F.col("_box.x1") - F.col("_box.x0"))
        if correct or box_range:
            out = out.withColumn("lam", F.when(F.col("cut"), F.lit(1.0) - area / float(height * width)).otherwise(F.col("lam")))
    if payload:
        blend = F.zip_with(payload, "_other", lambda a, b: a * F.col("lam") + b * (F.lit(1.0) - F.col("lam")))
        if cut_prob > 0:
            y, x = (lambda i: F.floor(i / width)), (lambda i: i % width)
            inside = lambda i: (y(i) >= F.col("_box.y0")) & (y(i) < F.col("_box.y1")) & (x(i) >= F.col("_box.x0")) & (x(i) < F.col("_box.x1"))
            pasted = F.transform(F.arrays_zip(F.col(payload).alias("a"), F.col("_other").alias("b")), lambda s, i: F.when(inside(i), s["b"]).otherwise(s["a"]))
            blend = F.when(F.col("cut"), pasted).otherwise(blend)
        out = out.withColumn("mixed_payload", blend)
    return out.drop("_box", "_other")


def _box(y0: Column, y1: Column, x0: Column, x1: Column) -> Column:
    return F.struct(*[v.cast("int").alias(n) for n, v in (("y0", y0), ("y1", y1), ("x0", x0), ("x1", x1))])


def _lam_box(unit, height: int, width: int) -> Column:
    """A box of the share one minus lam around a drawn centre, as far as it lies inside."""
    side = F.sqrt(F.lit(1.0) - F.col("lam"))
    half_h, half_w = F.floor(F.floor(side * height) / 2), F.floor(F.floor(side * width) / 2)
    cy, cx = F.floor(unit("cy") * height), F.floor(unit("cx") * width)
    clip = lambda v, top: F.greatest(F.lit(0), F.least(F.lit(top), v))
    return _box(clip(cy - half_h, height), clip(cy + half_h, height), clip(cx - half_w, width), clip(cx + half_w, width))


def _ranged_box(unit, box_range: tuple[float, float], height: int, width: int) -> Column:
    """A box whose sides are drawn between two shares of the whole, at a place where it fits."""
    if not 0 <= box_range[0] < box_range[1] <= 1:
        raise ValueError(f"box range {box_range} is no rising range within [0, 1]")

    def span(size: int, side: str, place: str) -> tuple[Column, Column]:
        low, high = int(size * box_range[0]), int(size * box_range[1])
        long = low + F.floor(unit(side) * max(1, high - low))
        start = F.floor(unit(place) * (F.lit(size) - long))
        return start, start + long

    return _box(*span(height, "h", "cy"), *span(width, "w", "cx"))


def soft_label(label: Column, partner: Column, lam: Column, classes: int, smoothing: float = 0.0) -> Column:
    """Dense target ``lam * y + (1-lam) * y_partner`` with smoothing; sums to one."""
    off = smoothing / classes
    on = 1.0 - smoothing + off
    hot = lambda y, i: F.when(i == y, on).otherwise(off)
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: hot(label, i) * lam + hot(partner, i) * (F.lit(1.0) - lam))


def derangement(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """A seeded partner inside the batch that is never the row itself (batches of one have no partner).

    Batches have a bounded size, so the window holds one batch.
    """
    order = Window.partitionBy("batch").orderBy(md5_key(seed, epoch, F.col(key)), F.col(key))
    nxt = F.lead(key).over(order)
    start = F.first(key).over(order)
    partner = F.coalesce(nxt, start)
    return rows.withColumn("partner", F.when(F.col("batch_rows") > 1, partner))


def four_tile_weights(xc: Column, yc: Column, scale: Column, size: int) -> Column:
    """Visible area shares of four equal tiles around (xc, yc) on a canvas of twice the size, after scaling about its
    middle and cropping to size x size. Equal shares if nothing is visible."""
    s = float(size)

    def seen(lo, hi):
        to = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(s), scale * (v - s) + s / 2))
        return F.greatest(F.lit(0.0), to(hi) - to(lo))

    left = seen(F.greatest(xc - s, F.lit(0.0)), xc)
    right = seen(xc, F.least(xc + s, F.lit(2 * s)))
    top = seen(F.greatest(yc - s, F.lit(0.0)), yc)
    bottom = seen(yc, F.least(yc + s, F.lit(2 * s)))
    total = (left + right) * (top + bottom)
    share = lambda a: F.when(total > 0, a / total).otherwise(F.lit(0.25))
    return F.array(share(left * top), share(right * top), share(left * bottom), share(right * bottom))


def four_groups(
    df: DataFrame, keys: Sequence[str], key: str, label: str, prob: float, seed: int, epoch: int, epochs: int | None = None, close_epochs: int = 0,
    size: int = 224, center: tuple[float, float] = (0.5, 1.5), scale: tuple[float, float] | None = None, flush: bool = True,
) -> DataFrame:
    """Rows grouped by four in key order per stream ``keys``; the rest pass through with one full-weight label.

    Output: stream keys, ``group`` (NULL for a pass-through), member keys, labels[4] and weights[4]. Grouping is off in the last
    ``close_epochs`` epochs. With ``flush=False`` the incomplete last group is returned with weights NULL, for a later batch.
    """
    keys = list(keys)
    on = not (epochs is not None and close_epochs > 0 and epoch >= epochs - close_epochs)
    grouped = (uniform(seed, epoch, "group", F.col(key)) < prob) if on else F.lit(False)
    marked = df.select(*keys, key, label, grouped.cast("int").alias("_in"))
    counted = running(marked, keys, by_number(F.col(key)), {"_n": Running("sum", F.col("_in"))})
    inside = counted.where("_in = 1").withColumn("_group", F.floor((F.col("_n") - 1) / 4))
    # Four rows per (stream, group).
    packed = inside.groupBy(*keys, "_group").agg(F.sort_array(F.collect_list(F.struct(key, label))).alias("_m"))
    parts = lambda name: F.transform("_m", lambda s: s[name])
    whole = F.size("_m") == 4
    complete = packed.where(whole).select(*keys, F.col("_group").alias("group"), parts(key).alias("members"), parts(label).alias("labels"))
    left = packed.where(~whole).select(*keys, F.inline("_m"))
    passed = counted.where("_in = 0").select(*keys, key, label)
    if flush:
        passed = passed.unionByName(left)
    single = lambda rows: rows.select(*keys, F.lit(None).cast("bigint").alias("group"), F.array(key).alias("members"), F.array(label).alias("labels"))
    out = weighted_fours(complete.unionByName(single(passed)), seed, epoch, size, center, scale)
    if flush:
        return out
    return out.unionByName(single(left).withColumn("weights", F.lit(None).cast("array<double>")))


def weighted_fours(
    groups: DataFrame, seed: int, epoch: int, size: int = 224, center: tuple[float, float] = (0.5, 1.5), scale: tuple[float, float] | None = None,
) -> DataFrame:
    """Adds ``weights`` to groups of four ``members`` and ``labels``; a single member becomes one label with the full weight."""
    lead, y = F.get("members", 0), F.get("labels", 0)
    unit = lambda what: uniform(seed, epoch, what, lead)
    at = lambda what: F.round((F.lit(center[0]) + unit(what) * (center[1] - center[0])) * size).cast("double")
    zoom = F.lit(scale[0]) + unit("zoom") * (scale[1] - scale[0]) if scale else F.lit(1.0)
    four = F.size("members") == 4
    # Each place is drawn once, not wherever the tiles' areas use it.
    tiles = let(F.struct(at("cx").alias("x"), at("cy").alias("y"), zoom.alias("z")), lambda p: four_tile_weights(p["x"], p["y"], p["z"], size))
    weights = F.when(four, tiles).otherwise(F.array(*[F.lit(w) for w in (1.0, 0.0, 0.0, 0.0)]))
    return groups.withColumn("weights", weights).withColumn("labels", F.when(four, F.col("labels")).otherwise(F.array(y, y, y, y)))


def pad_batches(df: DataFrame, key: str, size: int, target: str) -> DataFrame:
    """Fills the last batch to ``size`` by repeating its rows cyclically. Copies carry all-zero labels and weights.

    ``target`` is ARRAY<STRUCT<label, weight>>. Adds ``batch``, ``pos`` and ``padding``.
    """
    total = df.count()
    rows = indexed(df, [], by_number(F.col(key)), "_g")
    tail = total % size
    start = total - tail
    placed = rows.withColumns({"_at": F.col("_g"), "padding": F.lit(False)})
    if tail:
        last = rows.where(F.col("_g") >= start)
        first = F.col("_g") - start
        copies = last.withColumn("_at", F.explode(F.when(
            first + tail < size, F.sequence(first + tail, F.lit(size - 1), F.lit(tail).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))))
        zero = F.transform(target, lambda s: F.struct((s["label"] * 0).alias("label"), (s["weight"] * 0).alias("weight")))
        copies = copies.withColumns({"_at": F.col("_at") + start, "padding": F.lit(True), target: zero})
        placed = placed.unionByName(copies)
    return placed.withColumns({"batch": F.floor(F.col("_at") / size), "pos": (F.col("_at") % size).cast("int")}).drop("_at", "_g")
