"""Quality rules with thresholds that come from the data: mergeable quantile sketches per language and source.

Each document is described by whole-text counts. Five of them become integer rates, per thousand of what they could be,
and five more the same rates as far as they are sure: a count less twice its root, so that a few events are none. Rates
are sketched by counting documents per bucket: values below 32 have a bucket each, larger ones 16 buckets per power of
two, so a quantile is exact to one part in 16. Sketches are rows of counts and merge by adding, in any order. A source's
sketch is blended with its language's, at the weight of ``PRIOR`` documents, and a language's with that of all.

A group's limits come from its sketches alone. The limit of a rate lies as far above the 99.5 % quantile as that lies
above the 95 % quantile: what one document in 200 has goes if nearly all have none of it, and stays if more have some.
The limit of a sure rate is where the sketch falls apart: the last value below the first gap of a factor of two that has
at most ``MAX_OUT`` of the documents above it (buckets of next to no documents count as empty); without such a gap the
sure rate rejects nothing. A document is kept if it passes the two fixed base rules and lies at or below every limit of
its language and source.

Defined cases: NULL and empty texts have no words and fail the base rule; NULL language or source is a group of its own;
repeated rows are judged alike, one output row per input row; input columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymill.llm.common import SPACES, bound, kept, without, words_of
from tallymill.plans.sizing import join_null_safe

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
PRIOR = 200.0
MAX_OUT = 0.25
EMPTY = 0.0005
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("symbol_rate", "upper_rate", "bang_rate", "dup_line_rate", "repeat_rate")
SURE = tuple(f"sure_{r}" for r in RATES)


def _window_hashes(words: Column) -> Column:
    """One hash per 8-word window, from hashes of 2 and of 4 words."""
    def pairs(items: Column, apart: int) -> Column:
        return bound(items, lambda a: F.transform(
            F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - apart)), lambda x, i: F.xxhash64(x, F.get(a, i + apart))))

    return pairs(pairs(pairs(words, 1), 2), WINDOW // 2)


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash is there twice: neighbours in hash order, then a fold over their positions."""
    def fold(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda e, j: F.coalesce(F.get(pairs, j - 1)["h"] == e["h"], F.lit(False)) |
                         F.coalesce(F.get(pairs, j + 1)["h"] == e["h"], F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"])).alias("n"), (i + WINDOW).alias("end")),
            lambda a: a["n"])

    return bound(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), fold)


def repeat_words(words: Column) -> Column:
    """Words that lie in an 8-word window found at least twice in the text."""
    several = bound(_window_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h)))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(several)


def _count(text: Column, chars: str) -> Column:
    """Number of characters of ``text`` in the class ``chars``."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def add_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The whole-text counts of each row, in ``__q_*`` columns."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    by_word = bound(words_of(value), lambda w: F.struct(
        F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(value, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    by_line = bound(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    return docs.withColumns({
        "__q_w": by_word, "__q_l": by_line, "__q_symbols": _count(value, SYMBOLS), "__q_upper": _count(value, "A-Z"),
        "__q_bangs": _count(value, "!?")})


def _columns() -> dict[str, Column]:
    at = lambda name: F.col(f"__q_{name}").cast("bigint")
    words, chars = at("w.n_words"), at("w.word_chars")
    per = lambda a, b: F.when(b > 0, F.floor(F.lit(1000) * a / b)).otherwise(0).cast("bigint")
    sure = lambda a, b, unit=1: per(F.greatest(F.lit(0.0), a / unit - 2 * F.sqrt(a / unit)) * unit, b)
    return {
        "n_words": words, "word_chars": chars, "n_symbols": at("symbols"), "n_dup_lines": at("l.n_dup_lines"),
        "n_repeat_words": at("w.n_repeat_words"), "symbol_rate": per(at("symbols"), chars), "upper_rate": per(at("upper"), chars),
        "bang_rate": per(at("bangs"), chars), "dup_line_rate": per(at("l.n_dup_lines"), at("l.n_lines")),
        "repeat_rate": per(at("w.n_repeat_words"), words), "sure_symbol_rate": sure(at("symbols"), chars),
        "sure_upper_rate": sure(at("upper"), chars), "sure_bang_rate": sure(at("bangs"), chars),
        "sure_dup_line_rate": sure(at("l.n_dup_lines"), at("l.n_lines")), "sure_repeat_rate": sure(at("w.n_repeat_words"), words, WINDOW),
        "base_failed": (words < MIN_WORDS) | (F.lit(100) * at("w.n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * words),
    }


def bucket(value: Column) -> Column:
    """The sketch bucket of a non-negative integer."""
    size = F.length(F.bin(value))
    top = F.floor(value / F.pow(F.lit(2.0), size - 5)).cast("bigint")
    return F.when(value < 32, value).otherwise(F.lit(32) + (size - 6) * 16 + top - 16).cast("int")


def bucket_value(index: Column) -> Column:
    """The least value of a bucket."""
    rest = index - 32
    return F.when(index < 32, index).otherwise((F.lit(16) + rest % 16) * F.pow(F.lit(2.0), F.floor(rest / 16) + 1)).cast("bigint")


def sketch(measured: DataFrame, keys: list[str], rates: tuple[str, ...] = RATES) -> DataFrame:
    """``(keys, rate, bucket, n)``: one mergeable row of counts per bucket; documents that fail the base rules are left out."""
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bucket(F.col(r)).alias("bucket")) for r in rates])).alias("v")
    return measured.where(~F.col("base_failed")).select(*keys, rates).groupBy(*keys, "v.rate", "v.bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups, by adding counts."""
    return sketches.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, rate, total, q50, q75, q95, q995)`` of each sketch."""
    group = Window.partitionBy(*keys, "rate")
    seen = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sketches.withColumns({"seen": seen, "total": F.sum("n").over(group)})
    at = lambda q: F.min(F.when(F.col("seen") >= q * F.col("total"), bucket_value(F.col("bucket"))))
    return ranked.groupBy(*keys, "rate").agg(F.max("total").alias("total"), at(0.5).alias("q50"), at(0.75).alias("q75"), at(0.95).alias("q95"), at(0.995).alias("q995"))


def gaps(sketches: DataFrame, keys: list[str], max_out: float = MAX_OUT, empty: float = EMPTY) -> DataFrame:
    """``(keys, rate, gap)``: the last value below the first gap of each sketch that has few documents above, NULL without one."""
    group = Window.partitionBy(*keys, "rate")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    shares = sketches.withColumns({"total": F.sum("n").over(group), "upto": upto}).where(F.col("n") >= empty * F.col("total"))
    after = F.lead("bucket").over(group.orderBy("bucket"))
    value = bucket_value(F.col("bucket"))
    found = shares.withColumn("after", after).where(F.col("after").isNotNull() & (bucket_value(F.col("after")) > 2 * value))
    return found.where(F.col("total") - F.col("upto") <= max_out * F.col("total")).groupBy(*keys, "rate").agg(F.min(value).alias("gap"))


def blended(fine: DataFrame, coarse: DataFrame, keys: list[str], shared: list[str], prior: float = PRIOR) -> DataFrame:
    """``fine`` sketches plus ``prior`` documents spread as in the ``coarse`` sketch of their ``shared`` keys; counts are fractions."""
    whole = Window.partitionBy(*shared, "rate")
    spread = coarse.select(*shared, "rate", "bucket", (F.lit(prior) * F.col("n") / F.sum("n").over(whole)).alias("n"))
    groups = fine.select(*keys).distinct()
    lent = join_null_safe(groups, spread, shared) if shared else groups.join(F.broadcast(spread))
    return merge(fine.select(*keys, "rate", "bucket", F.col("n").cast("double").alias("n")).unionByName(lent.select(*keys, "rate", "bucket", "n")), keys)


def thresholds(sketches: DataFrame, lang: str, source: str, prior: float = PRIOR, max_out: float = MAX_OUT) -> DataFrame:
    """One row per (language, source): ``max_<rate>`` of each rate and of each sure rate, NULL where nothing is too much."""
    by_lang = blended(merge(sketches, [lang]), merge(sketches, []), [lang], [], prior)
    fine = kept(blended(sketches, by_lang, [lang, source], [lang], prior), "blended")
    keys = [lang, source]
    tails = quantiles(fine.where(F.col("rate").isin(*RATES)), keys).select(*keys, "rate", (2 * F.col("q995") - F.col("q95")).alias("limit"))
    falls = gaps(fine.where(F.col("rate").isin(*SURE)), keys, max_out).select(*keys, "rate", F.col("gap").alias("limit"))
    return tails.unionByName(falls).groupBy(*keys).agg(*[F.max(F.when(F.col("rate") == r, F.col("limit"))).alias(f"max_{r}") for r in (*RATES, *SURE)])


def _limits(measured: DataFrame, lang: str, source: str, **options) -> DataFrame:
    sketches = kept(sketch(measured, [lang, source], (*RATES, *SURE)), "rate-sketches")
    found = kept(thresholds(sketches, lang, source, **options), "limits")
    return found.withColumnsRenamed({lang: "__lang", source: "__source"})


def _judged(measured: DataFrame, limits: DataFrame, lang: str, source: str) -> DataFrame:
    joined = measured.join(limits, measured[lang].eqNullSafe(F.col("__lang")) & measured[source].eqNullSafe(F.col("__source")), "left")
    within = F.lit(True)
    for rate in (*RATES, *SURE):
        within &= F.coalesce(F.col(rate) <= F.col(f"max_{rate}"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & within).drop("__lang", "__source", *[f"max_{r}" for r in (*RATES, *SURE)])


def judge(measured: DataFrame, lang: str, source: str, **options) -> DataFrame:
    """``measured`` (a written table of counts, rates and ``base_failed``) with ``kept``."""
    return _judged(measured, _limits(measured, lang, source, **options), lang, source)


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Counts and rates of each row next to the columns in ``keep``."""
    return add_counts(docs, text).select(*[F.col(f"`{c}`") for c in keep], *[c.alias(n) for n, c in _columns().items()])


def keep_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they came. Texts are measured twice rather than written."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text}`").alias("__text"),
                       F.col(f"`{lang}`").alias("__lang_of"), F.col(f"`{source}`").alias("__source_of"))
    groups = ["__lang_of", "__source_of"]
    limits = _limits(kept(measure(held, groups, "__text"), "measured"), *groups, **options)
    return _judged(measure(held, ["__row", *groups], "__text"), limits, *groups).where("kept").select("__row.*")
