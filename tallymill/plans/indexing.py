"""Ordered positions and running values without one task per group.

A plain ``row_number().over(partitionBy(key))`` sends a whole group to one
task. Here a group with more than ``cell_rows`` rows is cut into *cells*: slices
of the group's order. Values inside a cell come from an ordinary window
partitioned by (key, cell); what the earlier cells contribute is one small
aggregate per cell, prefix-summed and joined back. The result equals the plain
window exactly, for any skew. With no keys the whole table is one such group.

Cells are a function of the row's own values, never of a partition id, so a
recomputed task puts its rows where they were before. The order value must
therefore be reproducible: an average of doubles, whose last bits depend on the
order of addition, should be written or checkpointed before it is cut.

Cells are bounded by whole order tuples, not by their first value, and rows
equal in the order are told apart by a hash of their other columns. So a value
that many rows repeat spreads over many cells like any other.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import AtomicType, FractionalType, DecimalType

from tallymill.plans.sizing import join_null_safe, pin
from tallymill.session import cut_lineage

CELL_CONF = "tallymill.cell.rows"
CELL_ROWS = 250_000
CARRY_ROWS = 100_000
# Rows looked at per cell to place its bounds, and how many of them a cell is meant to have: a fifth below the limit, so
# that the spread of a hash sample (about a tenth) leaves cells within it.
SAMPLED = 100
AIMED = 0.8
# Rows of the sample that are sorted in one task.
SAMPLE_ROWS = 1_000_000
CELL = "__cell"


@dataclass(frozen=True)
class Order:
    """A total order: ``columns`` sort the rows, ``split`` is a value of any comparable type that never falls along it.

    ``unit`` says that ``split`` is a number spread evenly over [0, 1) inside
    each group (a hash), so that cells need no quantiles.
    """

    columns: tuple[Column, ...]
    split: Column
    unit: bool = False


def by_hash(hex_col: Column, *ties: Column) -> Order:
    from tallymill.hashing import unit_from_hex

    return Order((hex_col, *ties), unit_from_hex(hex_col), unit=True)


def by_number(col: Column, *ties: Column, descending: bool = False) -> Order:
    """Order by a value, NULLs last, then by ``ties`` (plain columns, ascending). Ascending, the value may be a text or
    another comparable type; descending, it is a number."""
    first = col.desc_nulls_last() if descending else col.asc_nulls_last()
    parts = [col.isNull(), -col if descending else col, *ties]
    return Order((first, *ties), F.struct(*[v.alias(f"p{i}") for i, v in enumerate(parts)]))


def _tie(df: DataFrame) -> Column:
    """Hash of a row's plain columns; floating-point and nested ones, whose last bits may differ when recomputed, stay out."""
    plain = [f.name for f in df.schema if isinstance(f.dataType, AtomicType)
             and (isinstance(f.dataType, DecimalType) or not isinstance(f.dataType, FractionalType))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.lit(0).cast("bigint")


@dataclass(frozen=True)
class Running:
    """One running value. ``kind``: ``index`` (1-based), ``sum`` (inclusive), ``max_before`` (exclusive)."""

    kind: str
    value: Column | None = None

    def partial(self) -> Column:
        if self.kind == "index":
            return F.count(F.lit(1))
        if self.kind == "sum":
            return F.sum(self.value)
        if self.kind == "max_before":
            return F.max(self.value)
        raise ValueError(self.kind)

    def carry(self, partial: Column, earlier: Window) -> Column:
        if self.kind == "max_before":
            return F.max(partial).over(earlier)
        return F.sum(partial).over(earlier)

    def local(self, ordered) -> Column:
        if self.kind == "index":
            return F.row_number().over(ordered).cast("bigint")
        if self.kind == "sum":
            return F.sum(self.value).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return F.max(self.value).over(ordered.rowsBetween(Window.unboundedPreceding, -1))

    def combine(self, local: Column, carried: Column) -> Column:
        if self.kind == "max_before":
            return F.greatest(local, carried)
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(local + carried)


def cell_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(CELL_CONF, str(CELL_ROWS)))


def _with_bucket(df: DataFrame, bounds: Column, most: int, x: Column) -> DataFrame:
    """Adds ``CELL``, the number of ``bounds`` <= x, by halving; ``most`` is the length of the longest list of bounds.

    One projection a step: as each uses the last one's value twice, Spark keeps them apart and compiles them to plain code, in
    which ``x`` is computed once a row.
    """
    out = df.withColumns({"__x": x, CELL: F.lit(0)})
    for k in reversed(range(most.bit_length())):
        below = F.get(bounds, F.col(CELL) + ((1 << k) - 1)) <= F.col("__x")
        out = out.withColumn(CELL, F.col(CELL) + F.coalesce(below, F.lit(False)).cast("int") * (1 << k))
    return out.drop("__x")


def with_cells(df: DataFrame, keys, order: Order, sizes: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Adds the cell number, NULL for groups that are left whole; the flag says whether any group was cut.

    ``sizes`` may give the known group sizes (keys, n) and saves counting them.
    """
    keys = list(keys)
    limit = cell_rows(df)
    key_cols = [F.col(f"`{k}`") for k in keys]
    if sizes is None:
        counted = df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("__rows"))
    else:
        counted = sizes.select(*key_cols, F.col("n").alias("__rows"))
    hot, rows = pin(counted.filter(F.col("__rows") > limit))
    if rows is not None and not rows:
        return df.withColumn(CELL, F.lit(None).cast("int")), False
    if order.unit:
        # Without keys the one size is a literal and needs no join.
        wanted = F.ceil(F.col("__rows") / limit) if keys else F.lit(math.ceil(rows[0]["__rows"] / limit))
        out = join_null_safe(df, hot, keys) if keys else df
        cell = F.floor(order.split * wanted).cast("int")
        return out.withColumn(CELL, cell).drop("__rows"), True
    every = max(1, limit // SAMPLED)
    per_cell = max(1, int(AIMED * limit / every))
    x = F.struct(order.split.alias("v"), _tie(df).alias("t"))
    valued = df.select(*key_cols, x.alias("__x")).where(F.pmod(F.xxhash64("__x"), F.lit(every)) == 0)
    picked = join_null_safe(valued, hot.select(*key_cols, "__rows"), keys, "inner").drop("__rows") if keys else valued
    # One row in ``every`` of the cut groups: 2,500 times fewer than they hold at the default size.
    expected = picked.count() if rows is None else sum(r["__rows"] for r in rows) // every
    cuts = _sample_places(picked, keys, expected).where(F.col("__at") % per_cell == 0)
    cuts, brought = pin(cuts.withColumn("__at", (F.col("__at") / per_cell).cast("bigint")), CARRY_ROWS)
    if brought is None:
        return _cells_by_blocks(df, keys, hot, cuts, x), True
    bounds = cuts.groupBy(*key_cols).agg(F.sort_array(F.collect_list("__x")).alias("__bounds"))
    out = join_null_safe(df, F.broadcast(bounds), keys) if keys else df.withColumn("__bounds", bounds.scalar())
    # A hot group too uneven to be given a bound is one cell.
    most = max(Counter(tuple(r[k] for k in keys) for r in brought).values(), default=0)
    out = _with_bucket(out, F.col("__bounds"), most, x).drop("__bounds")
    if keys:
        out = join_null_safe(out, hot.select(*key_cols, F.lit(True).alias("__hot")), keys)
        out = out.withColumn(CELL, F.when(F.col("__hot"), F.col(CELL)))
    return out.drop("__hot"), True


def _sample_places(picked: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """``picked`` with ``__at``, each row's place (from 1) in its group's order of ``__x``.

    A sample beyond ``SAMPLE_ROWS`` is cut by range into as many tasks as it
    needs, whatever its keys, and counted on from task to task; the ranges are
    written first, so that a repeated task finds them again.
    """
    key_cols = [F.col(f"`{k}`") for k in keys]
    along = Window.partitionBy(*(key_cols or [F.lit(0)])).orderBy("__x")
    if expected <= SAMPLE_ROWS:
        return picked.withColumn("__at", F.row_number().over(along))
    ranged = cut_lineage(picked.repartitionByRange(math.ceil(expected / SAMPLE_ROWS) + 1, *key_cols, "__x").withColumn("__task", F.spark_partition_id()))
    sizes = ranged.groupBy(*key_cols, "__task").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*(key_cols or [F.lit(0)])).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task and group.
    ahead = sizes.select(*key_cols, "__task", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy(*key_cols, "__task").orderBy("__x")
    placed = join_null_safe(ranged, ahead, [*keys, "__task"]).withColumn("__at", F.row_number().over(inside) + F.col("__ahead"))
    return placed.drop("__task", "__ahead")


def _cells_by_blocks(df: DataFrame, keys: list[str], hot: DataFrame, cuts: DataFrame, x: Column) -> DataFrame:
    """Cells from more bounds than a row's expression can carry: each row finds its block of bounds, and meets it by a join.

    ``cuts`` has every bound ``__x`` with its number ``__at`` from 1. With ``m``
    bounds a block and the list of blocks both have about the root of ``m``.
    """
    key_cols = [F.col(f"`{k}`") for k in keys]
    most = cuts.groupBy(*key_cols).count().agg(F.max("count")).first()[0]
    wide = math.ceil(math.sqrt(most))
    numbered = cuts.withColumn("__block", F.floor((F.col("__at") - 1) / wide))
    coarse = numbered.where((F.col("__at") - 1) % wide == 0).groupBy(*key_cols).agg(F.array_sort(F.collect_list("__x")).alias("__coarse"))
    fine = numbered.groupBy(*key_cols, "__block").agg(F.array_sort(F.collect_list("__x")).alias("__fine"))
    out = join_null_safe(df, coarse, keys) if keys else df.withColumn("__coarse", coarse.scalar())
    out = out.withColumn("__block", (F.size(F.filter("__coarse", lambda b: b <= x)) - 1).cast("bigint"))
    out = join_null_safe(out, fine, [*keys, "__block"])
    inside = F.coalesce(F.size(F.filter("__fine", lambda b: b <= x)), F.lit(0))
    cell = F.when(F.col("__block") >= 0, F.col("__block") * wide + inside).otherwise(F.lit(0))
    if keys:
        out = join_null_safe(out, hot.select(*key_cols, F.lit(True).alias("__hot")), keys)
        cell = F.when(F.col("__hot"), cell)
    return out.withColumn(CELL, cell.cast("int")).drop("__coarse", "__fine", "__block", "__hot")


def running(df: DataFrame, keys, order: Order, values: dict[str, Running], keep=None, sizes: DataFrame | None = None) -> DataFrame:
    """Adds the running ``values`` of each group in ``order``.

    ``keep`` may name a predicate over ``__before_<name>`` columns (what the
    earlier cells contribute); cells that fail it are dropped before the window
    shuffles them. It must only drop rows the caller drops anyway.
    """
    keys = list(keys)
    tagged, cut = with_cells(df, keys, order, sizes)
    key_cols = [F.col(f"`{k}`") for k in keys]
    if not cut:
        ordered = (Window.partitionBy(*key_cols) if keys else Window.partitionBy(F.col(CELL))).orderBy(*order.columns)
        return tagged.withColumns({n: v.local(ordered) for n, v in values.items()}).drop(CELL)
    cells = tagged.where(F.col(CELL).isNotNull()).groupBy(*key_cols, CELL).agg(
        *[v.partial().alias(f"__part_{n}") for n, v in values.items()])
    # At most one row per cell here: thousands per group, not the group itself.
    earlier = Window.partitionBy(*key_cols).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(
        *key_cols, CELL, *[v.carry(F.col(f"__part_{n}"), earlier).alias(f"__before_{n}") for n, v in values.items()]
    ).where(F.col(CELL) > 0)
    # Rows only for cut groups, so this is about (rows / cell rows) long: normally a checked broadcast, which keeps
    # the big side unshuffled until its window.
    carried, _ = pin(carried, CARRY_ROWS)
    joined = join_null_safe(tagged, carried, [*keys, CELL], "left")
    if keep is not None:
        joined = joined.filter(keep)
    ties = [] if order.unit else [_tie(df)]
    ordered = Window.partitionBy(*key_cols, CELL).orderBy(*order.columns, *ties)
    out = joined.withColumns({n: v.combine(v.local(ordered), F.col(f"__before_{n}")) for n, v in values.items()})
    return out.drop(CELL, *[f"__before_{n}" for n in values])


def indexed(df: DataFrame, keys, order: Order, name: str = "idx", base: int = 0, sizes: DataFrame | None = None) -> DataFrame:
    """Position of each row in its group's order, starting at ``base``."""
    out = running(df, keys, order, {name: Running("index")}, sizes=sizes)
    return out if base == 1 else out.withColumn(name, F.col(name) + (base - 1))


def first_n(df: DataFrame, keys, order: Order, n, name: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; ``n`` is a number or a column constant per group."""
    bound = n if isinstance(n, Column) else F.lit(n)
    col = name or "__rank"
    keep = F.coalesce(F.col(f"__before_{col}"), F.lit(0)) < bound
    out = running(df, keys, order, {col: Running("index")}, keep=keep).filter(F.col(col) <= bound)
    return out if name else out.drop(col)
