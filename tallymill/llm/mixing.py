"""Mixing sources to target weights by budgets on a domain-language-source tree.

Weights are propagated from the root: each node shares its budget among its children by weight. A child can take no more
than its leaves hold in ``max_epochs`` passes. What it can't take goes to its siblings first, and only what all of them
can't take reaches the siblings of the parent, because a parent never receives more than its leaves can hold. At one
level that is water-filling: with children sorted by capacity over weight, those below the water line are full and the
others get the line times their weight. It has a closed form in two running sums over the children, so each level is
one window over a table with a row per node.

A leaf with budget ``T`` and ``S`` tokens gives all its documents ``T div S`` times and, in one more epoch, the prefix of
a seeded order of its documents whose tokens fit in the rest. The prefix needs no sort of the leaf: tokens are summed
per bucket of the order (65,536 a leaf), a running sum finds the bucket in which the rest ends, and only that bucket's
documents are ordered. The result is one cut value per leaf, and documents compare their own order value with it.

Defined cases: NULL domain, language and source are names like any other; NULL and empty texts have no tokens; names
without a weight get ``other``; documents that share an id and text share their place in the order and are taken
together; documents without tokens come along with their leaf's epochs; the budget is at most what the root can hold;
input columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymill.llm.common import kept, words_of

LEVELS = ("domain", "lang", "source")
ADDED = ("domain", "n_tokens", "epoch")


def _weight(level: str, weights: dict[str, float], other: float) -> Column:
    out = F.lit(float(other))
    for name, weight in weights.items():
        out = F.when(F.col(level) == name, F.lit(float(weight))).otherwise(out)
    return out


def fill(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Water-filling among siblings: ``nodes`` has ``budget`` (the parent's), ``weight`` and ``capacity``; adds ``share``."""
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = siblings.orderBy("ratio", *[c for c in LEVELS if c in nodes.columns]).rowsBetween(Window.unboundedPreceding, -1)
    measured = nodes.withColumn("ratio", ratio).withColumns({
        "full_before": F.coalesce(F.sum("capacity").over(before), F.lit(0.0)),
        "weight_left": F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    line = F.when(F.col("weight_left") > 0, (F.col("budget") - F.col("full_before")) / F.col("weight_left")).otherwise(F.lit(0.0))
    lined = measured.withColumn("line", line).withColumn("full", F.col("ratio") <= F.col("line"))
    level = F.max(F.when(~F.col("full"), F.col("line"))).over(siblings)
    shared = lined.withColumn("level", level).withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(
        F.least(F.col("capacity"), F.greatest(F.coalesce("level", F.lit(0.0)), F.lit(0.0)) * F.col("weight"))))
    return shared.drop("ratio", "full_before", "weight_left", "line", "full", "level")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], budget_share: float, max_epochs: int, other: float = 1.0) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with the whole-token ``target`` of each."""
    held = leaves.withColumn("capacity", F.col("tokens") * F.lit(float(max_epochs)))
    totals = leaves.agg(F.sum("tokens")).first()[0] or 0
    above = None
    for depth, level in enumerate(LEVELS):
        names, parents = list(LEVELS[:depth + 1]), list(LEVELS[:depth])
        nodes = held.groupBy(*names).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights.get(level, {}), other))
        if above is None:
            nodes = nodes.withColumn("budget", F.lit(float(totals) * budget_share))
        else:
            up = above.select(*[F.col(p).alias(f"__{p}") for p in parents], F.col("share").alias("budget"))
            match = F.lit(True)
            for p in parents:
                match &= F.col(p).eqNullSafe(F.col(f"__{p}"))
            nodes = nodes.join(up, match).drop(*[f"__{p}" for p in parents])
        above = kept(fill(nodes, parents), f"mix-{level}")
    shares = above.select(*[F.col(p).alias(f"__{p}") for p in LEVELS], F.floor(F.col("share") + 1e-6).cast("bigint").alias("target"))
    return _join(leaves, shares)


def _join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the tree's names, NULL matching NULL; ``right`` has them with two underscores in front."""
    match = F.lit(True)
    for p in LEVELS:
        match &= F.col(p).eqNullSafe(F.col(f"__{p}"))
    return left.join(right, match, how).drop(*[f"__{p}" for p in LEVELS])


def order_value(seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch, "__key")


def epoch_plan(meta: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """``leaves`` with ``whole`` epochs and the ``cut`` of the next one (NULL: none of it)."""
    planned = leaves.select(
        *LEVELS, "target", F.when(F.col("tokens") > 0, F.expr("target div tokens")).otherwise(0).cast("int").alias("whole"),
        F.when(F.col("tokens") > 0, F.expr("target % tokens")).otherwise(0).cast("bigint").alias("rest"))
    planned = kept(planned, "mix-planned")
    as_right = lambda df: df.withColumnsRenamed({p: f"__{p}" for p in LEVELS})
    placed = _join(meta, as_right(planned)).withColumn("at", order_value(seed, F.col("whole") + 1)).withColumn("bucket", F.shiftright("at", 48))
    sums = placed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("tokens"))
    upto = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ending = sums.withColumn("seen", F.sum("tokens").over(upto)).where("seen > rest").groupBy(*LEVELS).agg(
        F.min(F.struct("bucket", (F.col("seen") - F.col("tokens")).alias("before"))).alias("b"))
    ending = kept(ending.select(*LEVELS, F.col("b.bucket").alias("last_bucket"), F.col("b.before").alias("before")), "mix-ending")
    inside = _join(placed, as_right(ending)).where(F.col("bucket") == F.col("last_bucket"))
    units = inside.groupBy(*LEVELS, "at", "before", "rest").agg(F.sum("n_tokens").alias("tokens"))
    within = Window.partitionBy(*LEVELS).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    fits = units.withColumn("seen", F.col("before") + F.sum("tokens").over(within)).where("seen <= rest").groupBy(*LEVELS).agg(F.max("at").alias("cut"))
    known = _join(planned, as_right(ending), "left")
    known = _join(known, as_right(fits), "left")
    start = F.shiftleft(F.col("last_bucket").cast("bigint"), 48)
    before = F.when(start > F.lit(-(1 << 63)), start - 1)
    return known.select(*LEVELS, "target", "whole", F.when(F.col("rest") > 0, F.coalesce("cut", before)).alias("cut"))


def mix(
    docs: DataFrame, weights: dict[str, dict[str, float]], domain: Column, budget_share: float = 1.0, max_epochs: int = 4, seed: int = 0,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", other: float = 1.0,
) -> DataFrame:
    """One row per document and epoch: the columns of ``docs`` with ``domain``, ``n_tokens`` and ``epoch`` (from 1)."""
    named = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], domain.alias("domain"), F.col(f"`{lang}`").alias("lang"),
        F.col(f"`{source}`").alias("source"), F.size(words_of(F.col(f"`{text}`"))).cast("bigint").alias("n_tokens"),
        F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("__key"))
    meta = kept(named.select(*LEVELS, "n_tokens", "__key"), "mix-meta")
    leaves = kept(meta.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    plan = kept(epoch_plan(meta, leaf_budgets(leaves, weights, budget_share, max_epochs, other), seed), "mix-plan")
    joined = _join(named, plan.withColumnsRenamed({p: f"__{p}" for p in LEVELS}))
    more = F.coalesce(order_value(seed, F.col("whole") + 1) <= F.col("cut"), F.lit(False))
    times = F.col("whole") + more.cast("int")
    out = joined.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), times)))
    names = [c for c in docs.columns if c.lower() not in ADDED]
    return out.select(*[F.col(f"c{docs.columns.index(c)}").alias(c) for c in names], "domain", "n_tokens", "epoch")
