"""Report cells: means with deviations, signed deltas, rounding, table rows, label descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def mean_std(mean: Column, std: Column, digits: int = 2, joiner: str = " +/- ") -> Column:
    """``mean +/- std``; a missing mean gives ``-``."""
    spec = f"%.{digits}f"
    spread = F.when(std.isNull(), "nan").otherwise(F.format_string(spec, std))
    return F.when(mean.isNull(), "-").otherwise(F.concat(F.format_string(spec, mean), F.lit(joiner), spread))


def signed(delta: Column, digits: int = 3) -> Column:
    """Always carries a sign; zero is positive."""
    return F.when(
        delta.isNotNull(),
        F.concat(F.when(delta >= 0, "+").otherwise("-"), F.format_string(f"%.{digits}f", F.abs(delta))))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |"))


def round_metrics(df: DataFrame, suffixes: Sequence[str] = ("_mean", "_std"), digits: int = 4, drop: Sequence[str] = ()) -> DataFrame:
    """Rounds the columns with the suffixes half to even, after dropping ``drop``."""
    out = df.drop(*drop)
    chosen = [c for c in out.columns if c.endswith(tuple(suffixes))]
    return out.withColumns({c: F.bround(out[f"`{c}`"].cast("double"), digits) for c in chosen})


def describe_label(names: DataFrame, detailed: bool = False) -> DataFrame:
    """Dimension (idx, description): the name, or ``lemma: definition`` when ``detailed``."""
    text = F.concat_ws(": ", "lemma", "definition") if detailed else F.col("lemma")
    return names.select("idx", text.alias("description"))


def describe_column(df: DataFrame, labels: DataFrame, column: str, out: str = "description") -> DataFrame:
    """Left join of the label dimension; join strategy follows the dimension's size."""
    dim = labels.select(F.col("idx").alias("_idx"), F.col("description").alias(out))
    return df.join(dim, F.col(column) == F.col("_idx"), "left").drop("_idx")


def describe_array(df: DataFrame, labels: DataFrame, column: str, keys: Sequence[str], out: str = "descriptions") -> DataFrame:
    """Descriptions for an array of indices, order kept: explode, join, collect (arrays are top-k sized)."""
    parts = describe_column(df.select(*keys, F.posexplode(column).alias("_pos", "_i")), labels, "_i", "_text")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_text"))), lambda s: s["_text"])
    return df.join(parts.groupBy(*keys).agg(texts.alias(out)), list(keys), "left")
