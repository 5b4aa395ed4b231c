"""Personal data: fixed formats, and identifiers found by bootstrapped contexts.

Base spans come from one expression per kind, checked by rule. They are the seeds. Every seed, and every other token
with a digit or an at sign (joined with numbers that follow it), is an instance seen in contexts: the two words before
it, the one word before it, and that word with the one after. Contexts are the lexical patterns, and (pattern, instance)
pairs are a bipartite graph. Spark scores it in rounds: a pattern's confidence for a kind is the mean score of its
instances, an instance's score is the best confidence among its patterns, and seeds stay at one. A pattern that is
confident enough and saw enough different seeds marks the other instances in its context, if they look like its kind.

Pairs are distinct, so copies of a document add nothing, and each round is two joins with aggregation before and after.
Positions are code points. They come from one pass of ``split`` and ``regexp_extract_all`` with the same expression; the
expressions use possessive groups and look-behind, so a long run of digits or letters takes linear time and no recursion.

Defined cases: NULL and empty texts have no spans; an added span never overlaps a base one; of kinds with the same
confidence the first listed is taken; rows that repeat an id and text get the same spans; input columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.llm.common import bound, kept, words_of

KINDS = ("email", "ip", "card", "phone")
# The contract's formats, written so that they can't backtrack: same matches.
FORMATS = {
    "email": "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    "card": "(?<![0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": "\\+[0-9]"}
TOKEN = "(?<!\\S)[^\\s0-9@]*+[0-9@]\\S*+(?: [0-9(]\\S*+)*+"
OCTETS = "^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\\.|$)){4}$"
BEFORE = 80
ROUNDS = 3
MIN_CONFIDENCE = 0.6
MIN_SEEDS = 3
SPAN = "array<struct<start:int,end:int,s:string>>"


def locate(value: Column, pattern: str) -> Column:
    """Matches as ``(start, end, s)``: each lies behind a gap, so places are running sums of gap and match lengths."""
    def place(found: Column, gaps: Column) -> Column:
        sized = F.transform(found, lambda s, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(s).alias("len"), s.alias("s")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(sized, start, lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["len"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["len"]).alias("end"), x["s"].alias("s")))).alias("out")),
            lambda a: a["out"])

    return bound(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), lambda m: bound(F.split(value, pattern, -1), lambda g: place(m, g)))


def _valid(kind: str, s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]+", "")
    if kind == "ip":
        return s.rlike(OCTETS)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(value: Column) -> Column:
    """``array<struct<kind:int, start, end, s>>`` by kind, then start; ``kind`` counts from 0 as listed."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int,s:string>>")
    parts = []
    for k, kind in enumerate(KINDS):
        found = F.filter(locate(value, FORMATS[kind]), lambda x: _valid(kind, x["s"]))
        tagged = F.transform(found, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s")))
        parts.append(F.when(value.rlike(HINTS[kind]), tagged).otherwise(none))
    return F.concat(*parts)


def _other_tokens(value: Column, base: Column) -> Column:
    """Tokens with a digit or an at sign, less outer marks, that touch no base span; ``kind`` is -1."""
    def trimmed(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["s"], "^[^0-9A-Za-z+@]*", 0))
        tail = F.length(F.regexp_extract(x["s"], "[^0-9A-Za-z]*$", 0))
        s = F.substr(x["s"], lead + 1, F.length(x["s"]) - lead - tail)
        return F.struct(F.lit(-1).alias("kind"), (x["start"] + lead).alias("start"), (x["end"] - tail).alias("end"), s.alias("s"))

    tokens = F.transform(locate(value, TOKEN), trimmed)
    free = F.filter(tokens, lambda x: (x["end"] > x["start"]) & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return F.when(value.rlike("[0-9@]"), free).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,s:string>>"))


def _contexts(value: Column, x: Column) -> Column:
    """The patterns around a span; none where the words are missing."""
    plain = lambda text: F.regexp_replace(F.lower(text), "[0-9]+", "0")
    before = words_of(plain(F.substr(value, F.greatest(F.lit(1), x["start"] - BEFORE + 1), F.least(F.lit(BEFORE), x["start"]))))
    after = words_of(plain(F.substr(value, x["end"] + 1, F.lit(BEFORE))))
    return bound(before, lambda w: bound(F.get(w, F.size(w) - 1), lambda one: bound(F.get(after, F.lit(0)), lambda right: F.filter(F.array(
        F.concat(F.lit("2 "), F.get(w, F.size(w) - 2), F.lit(" "), one), F.concat(F.lit("1 "), one),
        F.concat(F.lit("b "), one, F.lit(" _ "), right)), lambda p: p.isNotNull()))))


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, hash, base, seen)`` per row, written once: base spans, and all instances with their patterns."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    based = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(value).alias("hash"), value.alias("v"), base_spans(value).alias("base"))
    tokened = based.withColumn("other", _other_tokens(F.col("v"), F.col("base")))
    seen = F.transform(F.concat("base", "other"), lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lower(x["s"]).alias("s"), _contexts(F.col("v"), x).alias("patterns")))
    return kept(tokened.select("id", "hash", "base", seen.alias("seen")), "spans")


def score_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(pattern, kind, confidence, seeds)`` after the rounds."""
    seen = found.select(F.explode("seen").alias("x")).select("x.kind", "x.s", F.explode("x.patterns").alias("pattern"))
    seeds = kept(seen.where("kind >= 0").select("s", "kind").distinct(), "seeds")
    rooted = seen.where("kind >= 0").select("pattern").distinct()
    pairs = kept(seen.select("pattern", "s").distinct().join(rooted, "pattern", "left_semi"), "pairs")
    sizes = kept(pairs.groupBy("pattern").agg(F.count("*").alias("size")), "pattern-sizes")
    known = seeds.withColumn("score", F.lit(1.0))
    for turn in range(rounds):
        held = pairs.join(known, "s").groupBy("pattern", "kind").agg(F.sum("score").alias("total"), F.count(F.when(F.col("score") == 1.0, 1)).alias("seeds"))
        patterns = kept(held.join(sizes, "pattern").select("pattern", "kind", (F.col("total") / F.col("size")).alias("confidence"), "seeds"), "patterns")
        if turn + 1 < rounds:
            spread = pairs.join(patterns, "pattern").groupBy("s", "kind").agg(F.max("confidence").alias("score"))
            known = kept(spread.join(seeds.withColumn("seed", F.lit(1.0)), ["s", "kind"], "left").select("s", "kind", F.coalesce("seed", F.col("score") * 0.5).alias("score")), "scores")
    return patterns


def _looks_like(kind: Column, s: Column) -> Column:
    digits = F.length(F.regexp_replace(s, "[^0-9]+", ""))
    return (((kind == 0) & s.rlike("^[^@\\s]+@[^@\\s]+$")) | ((kind == 1) & s.rlike("^[0-9a-f]+(?:[.:][0-9a-f]*){3,}$"))
            | ((kind == 2) & digits.between(12, 19) & s.rlike("^[0-9 .-]+$")) | ((kind == 3) & digits.between(7, 15) & s.rlike("^[0-9 ().+/-]+$")))


def discover(found: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """``(id, hash, added)``: spans that confident patterns mark in each document."""
    strong = kept(score_patterns(found, rounds).where((F.col("confidence") >= min_confidence) & (F.col("seeds") >= min_seeds)).withColumnRenamed("kind", "to"), "strong")
    other = found.select("id", "hash", F.explode("seen").alias("x")).where("x.kind < 0").select("id", "hash", "x.start", "x.end", "x.s", F.explode("x.patterns").alias("pattern"))
    marked = other.join(strong, "pattern").where(_looks_like(F.col("to"), F.col("s")))
    best = marked.groupBy("id", "hash", "start", "end").agg(F.max(F.struct("confidence", (-F.col("to")).alias("k"))).alias("m"))
    return best.groupBy("id", "hash").agg(F.collect_list(F.struct((-F.col("m.k")).alias("kind"), "start", "end")).alias("added"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, one row per input row."""
    found = find_spans(docs, doc_id, text)
    added = kept(discover(found, **options), "added").withColumnsRenamed({"id": "__id", "hash": "__hash"})
    joined = found.join(added, F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")), "left")
    plain = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    every = F.array_sort(F.concat(plain, F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    counts = [F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return joined.select(F.col("id").alias(doc_id), *counts, F.sha2(_written(plain).cast("binary"), 256).alias("base_sha256"), _written(every).alias("spans"))
