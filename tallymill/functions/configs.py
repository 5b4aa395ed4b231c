"""Free-form JSON configurations as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallymill.functions.binding import let

WRAPPER_KEYS = ("value", "desc", "policy")


def config_map(text: Column) -> Column:
    """Top-level keys of a JSON object with each value as JSON text; bad JSON gives NULL."""
    parsed = F.try_parse_json(text)
    return F.try_variant_get(parsed, "$", "map<string,variant>")


def unwrap_config(text: Column) -> Column:
    """Map of key to value text. ``{"value": x, "desc": ...}`` wrappers give x; plain values stay."""

    def plain(_, v):
        def choose(inner):
            wrapped = inner.isNotNull() & F.map_contains_key(inner, "value") & F.forall(F.map_keys(inner), lambda k: k.isin(*WRAPPER_KEYS))
            return F.when(wrapped, F.try_element_at(inner, F.lit("value"))).otherwise(v)

        return let(F.try_variant_get(v, "$", "map<string,variant>"), choose)

    return F.transform_values(config_map(text), plain)


def flatten_value(value: Column) -> Column:
    """A VARIANT as one text cell: lists joined by ``,``, objects as ``k=v;k=v``, scalars as text."""
    pair = lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("")))
    listed = F.array_join(F.try_variant_get(value, "$", "array<string>"), ",", "")
    fields = F.array_join(F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,string>")), pair), ";")
    # Scalars do not convert to a list or an object, so the first conversion that works is the right one.
    return F.coalesce(listed, fields, F.try_variant_get(value, "$", "string"))


def flatten_keys(text: Column) -> Column:
    """Dotted-key map of a nested JSON object, to its deepest level. Lists become JSON text, whole."""

    def opened(entry):
        def expand(children):
            below = F.transform(F.map_entries(children), lambda c: F.struct(F.concat(entry["key"], F.lit("."), c["key"]).alias("key"), c["value"].alias("value")))
            return F.when(children.isNull(), F.array(entry)).otherwise(below)

        return let(F.try_variant_get(entry["value"], "$", "map<string,variant>"), expand)

    def leaf(value):
        listed = F.when(F.try_variant_get(value, "$", "array<variant>").isNotNull(), F.to_json(value))
        return F.coalesce(listed, F.try_variant_get(value, "$", "string"))

    # A text is nowhere deeper than it has opening braces; each step opens one level.
    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(text, F.lit("\\{"))))
    entries = F.aggregate(levels, F.map_entries(config_map(text)), lambda found, _: F.flatten(F.transform(found, opened)))
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), leaf(e["value"]).alias("value"))))
