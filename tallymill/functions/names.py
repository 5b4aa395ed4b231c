"""Run-name grammar: parsing, classification, rendering and slugs, all as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.functions.binding import let

# Fixed values of the run-name format.
PREFIX_KEYS = ("img", "ma", "a", "k", "ld")

# Ordered (needle, type) rules; the first needle contained in the lower-cased name wins.
TYPE_RULES = (
    ("baseline", "baseline"),
    ("mixup_switch_prob=1.0", "cutmix"),
    ("mixup_switch_prob=0.0", "mixup"),
    ("openmixup-fmix", "fmix"),
    ("openmixup-gridmix", "gridmix"),
    ("openmixup-resizemix", "resizemix"),
    ("openmixup-saliencymix", "saliencymix"),
    ("openmixup-smoothmix", "smoothmix"),
    ("openmixup-tokenmix", "tokenmix"),
    ("openmixup-tla", "tla"),
    ("cutmix", "cutmix"),
    ("mixup", "mixup"),
    ("pl-loss", "groupmix-pl"),
    ("soft-ce", "groupmix-sce"),
    ("mosaic", "mosaic"),
    ("mixed", "groupmix-mixed"),
    ("noaug", "noaug"),
    ("bare", "bare"),
)
# Behind "unbalanced" the same rules apply with "baseline" tried last.
SECONDARY_RULES = (*TYPE_RULES[1:], TYPE_RULES[0])
LONG_HORIZON_TOKEN = "__300__"


def run_name_entries(name: Column) -> Column:
    """Tokens of all sections after the first, as structs (key, value); a plain tag has a NULL key."""
    sections = F.split(name, "__")
    tokens = F.filter(
        F.flatten(F.transform(F.slice(sections, 2, F.greatest(F.size(sections), F.lit(1))), lambda s: F.split(s, "_"))), lambda t: t != ""
    )
    equals = r"^([A-Za-z][A-Za-z0-9_]*)=(.+)$"
    prefixed = "^(" + "|".join(PREFIX_KEYS) + r")([0-9-].*)$"

    def entry(t):
        key = F.when(t.rlike(equals), F.regexp_extract(t, equals, 1)).when(
            t.rlike(prefixed), F.regexp_extract(t, prefixed, 1))
        value = F.when(t.rlike(equals), F.regexp_extract(t, equals, 2)).when(
            t.rlike(prefixed), F.regexp_extract(t, prefixed, 2)).otherwise(t)
        return F.struct(key.alias("key"), value.alias("value"))

    return F.transform(tokens, entry)


def _last_wins(entries: Column) -> Column:
    """Map of the keyed entries; a repeated key keeps its last value."""
    keyed = F.filter(entries, lambda e: e["key"].isNotNull())
    keys = F.array_distinct(F.transform(keyed, lambda e: e["key"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(keyed, lambda e: e["key"] == k), -1)["value"])
    return F.map_from_arrays(keys, last)


def parse_run_name(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds experiment_tag, params MAP<STRING,STRING> and tags ARRAY<STRING>."""
    out = df.withColumn("_entries", run_name_entries(F.col(name)))
    tags = F.transform(F.filter("_entries", lambda e: e["key"].isNull()), lambda e: e["value"])
    return out.withColumns(
        {"experiment_tag": F.split(F.col(name), "__")[0], "params": _last_wins(F.col("_entries")), "tags": tags}
    ).drop("_entries")


def add_parsed_columns(df: DataFrame, keys: Sequence[str], name: str = "name") -> DataFrame:
    """One string column per requested key, next to run_name, experiment_tag and tags.

    A name that is already taken gets the suffix ``_parsed``. The key set is
    given by the caller: a DataFrame has to know its columns before it runs.
    """
    taken = set(df.columns)
    free = lambda c: c if c not in taken else f"{c}_parsed"
    parsed = parse_run_name(df.select(F.struct("*").alias("_row"), F.col(name).cast("string").alias("_name")), "_name")
    return parsed.select(
        "_row.*", F.col("_name").alias(free("run_name")), F.col("experiment_tag").alias(free("experiment_tag")),
        *[F.try_element_at("params", F.lit(k)).alias(free(k)) for k in keys], F.col("tags").alias(free("tags")),
    )


def parsed_keys(df: DataFrame, name: str = "name") -> list[str]:
    """The distinct parameter keys present in the names (one small aggregation)."""
    keys = parse_run_name(df.select(F.col(name).alias("_name")), "_name").select(F.explode(F.map_keys("params")).alias("k"))
    return sorted(r["k"] for r in keys.distinct().collect())


def rule_ladder(text: Column, rules: Sequence[tuple[str, str]], default) -> Column:
    """Label of the first rule whose needle occurs in ``text``."""
    out = None
    for needle, label in rules:
        hit = text.contains(needle)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def _type_of(text: Column) -> Column:
    """The ladder over an already lower-cased name."""
    # The cheap test first: most names do not hold the word at all.
    bare = text.contains("bare") & F.exists(F.split(text, "__"), lambda s: (s == "bare") | s.startswith("bare_"))
    unbalanced = text.contains("unbalanced")
    return (
        F.when(bare & unbalanced, "unbalanced-bare")
        .when(bare, "bare")
        .when(unbalanced, F.concat(F.lit("unbalanced-"), rule_ladder(text, SECONDARY_RULES, "noaug")))
        .otherwise(rule_ladder(text, TYPE_RULES, "unknown"))
    )


def canonical_type(name: Column) -> Column:
    """Experiment type of a run name; NULL and unmatched names give ``unknown``."""
    return F.coalesce(let(F.lower(name), _type_of), F.lit("unknown"))


def with_canonical_type(df: DataFrame, name: str = "name", out: str = "type") -> DataFrame:
    """Adds the experiment type. The lower-cased name is its own projection, so the ladder runs in generated code."""
    lowered = df.withColumn("_lower", F.lower(F.col(name)))
    return lowered.withColumn(out, F.when(F.col("_lower").isNull(), "unknown").otherwise(_type_of(F.col("_lower")))).drop("_lower")


def is_long_horizon(name: Column) -> Column:
    return F.coalesce(name.contains(LONG_HORIZON_TOKEN), F.lit(False))


def optimizer_of(name: Column) -> Column:
    text = F.lower(name)
    return F.when(text.contains("-muon"), "muon").when(text.contains("-adamw"), "adamw")


def seed_of(name: Column) -> Column:
    return F.regexp_extract(name, r"seed[=_-]?([0-9]+)", 1).try_cast("bigint")


def matching_category(name: Column, categories: Sequence[Sequence[str]]) -> Column:
    """First spelling of the first category that occurs in the name; case and ``-``/``_`` do not matter."""

    def match(text):
        out = F.lit(None).cast("string")
        for spellings in reversed(list(categories)):
            for spelling in reversed(list(spellings)):
                out = F.when(text.contains(spelling.lower().replace("-", "_")), spellings[0]).otherwise(out)
        return out

    return let(F.translate(F.lower(name), "-", "_"), match)


def parse_folder(df: DataFrame, column: str, renames: dict[str, str], pattern: str) -> DataFrame:
    """Rows whose folder matches ``pattern`` (groups model, type, ptseed, trseed), with the type renamed."""
    part = lambda i: F.regexp_extract(column, pattern, i)
    names = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv]) if renames else None
    kind = F.coalesce(F.try_element_at(names, part(2)), part(2)) if renames else part(2)
    return df.where(F.col(column).rlike(pattern)).withColumns(
        {"model": part(1), "type": kind, "ptseed": part(3).cast("int"), "trseed": part(4).cast("int")}
    )


def slug(text: Column, fallback: str = "run") -> Column:
    """Runs of characters outside ``[A-Za-z0-9._-]`` become ``_``; outer ``_`` go; empty gives the fallback."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(clean != "", clean).otherwise(fallback)


def group_path(group: Column, name: Column, project: Column | None = None, ungrouped: str = "_ungrouped") -> Column:
    """``[project_]group/name`` in slugs; rows without a group sit below ``ungrouped``."""
    folder = F.when(group != "", slug(group)).otherwise(ungrouped)
    if project is not None:
        folder = F.concat_ws("_", slug(project), folder)
    return F.concat_ws("/", folder, name)


def general(number: Column) -> Column:
    """Up to six significant digits without trailing zeros (values in the plain decimal range)."""
    text = F.format_string("%.6g", number.cast("double"))
    rounded = text.try_cast("decimal(28,10)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(rounded, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(number.isNotNull(), trimmed)


def render_recipe(df: DataFrame) -> Column:
    """Recipe part of a run name from the columns k_min, k_max, k_reverse, a_min, a_max, a_reverse,
    loss, mixed_alpha, k_schedule, a_schedule and variant (set when mixing is off). NULL parts are left out."""
    c = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    flag = lambda n, text: F.when(c(n).cast("boolean"), text)
    alpha = (
        F.when(c("a_min").isNotNull() & c("a_max").isNotNull() & (c("a_min") == c("a_max")), general(c("a_min")))
        .when(c("a_min").isNotNull() & c("a_max").isNotNull(), F.concat(general(c("a_min")), F.lit("-"), general(c("a_max"))))
        .otherwise(F.coalesce(general(c("a_min")), general(c("a_max"))))
    )
    schedule = lambda tag, n: F.when((c(n) != "fixed") & (c(n) != ""), F.concat(F.lit(tag), c(n)))
    mixed = F.concat_ws(
        "_",
        F.concat(F.lit("k"), c("k_min").cast("string"), F.lit("-"), c("k_max").cast("string")),
        F.concat(F.lit("kcd"), c("k_cooldown").cast("string")),
        flag("k_reverse", "krev"),
        F.concat(F.lit("a"), alpha),
        flag("a_reverse", "arev"),
        F.translate(c("loss"), "_", "-"),
        F.concat(F.lit("ma"), general(c("mixed_alpha"))),
        schedule("ks-", "k_schedule"),
        schedule("as-", "a_schedule"),
    )
    return F.coalesce(c("variant"), mixed)


def render_run_name(df: DataFrame, prefix: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """Adds ``name``: ``[prefix__]model__dataset__img{n}[__tags][__lr=x]__recipe__seed=n``."""
    parts = [
        *([F.lit(prefix)] if prefix else []),
        F.col("model"), F.col("dataset"), F.concat(F.lit("img"), F.col("img_size").cast("string")),
        *([F.lit("_".join(tags))] if tags else []),
        *([F.concat(F.lit("lr="), general(F.col("lr")))] if "lr" in df.columns else []),
        render_recipe(df),
        F.concat(F.lit("seed="), F.col("seed").cast("string")),
    ]
    return df.withColumn("name", F.concat_ws("__", *parts))
