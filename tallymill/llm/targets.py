"""What the registered queries and the pipeline aim at: the mixture, and the damage to conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MIX_SEED = 7
MIX_WEIGHTS = {
    "domain": {"web": 0.4, "books": 0.3, "reference": 0.2, "forum": 0.1},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
}


def mix_domain(source: Column) -> Column:
    """Domain of a source by the number in its name; ``forum`` without one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    kind = F.when(number != "", number.cast("int") % 4)
    return F.when(kind == 0, "web").when(kind == 1, "books").when(kind == 2, "reference").otherwise("forum")


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Turns with the contract's damage by checksum of ``conv_id:turn``; ``copies`` is how often a turn is left."""
    value = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", value("conv_id"), value("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(value("text"), "[.!?]", "")).otherwise(value("text"))
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(value("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))
