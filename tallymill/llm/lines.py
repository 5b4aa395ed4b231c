"""Removal of repeated passages by content-defined chunks of lines and sentences, with windows for what chunks can't hold.

A text is cut into units at line ends and sentence ends, as whole paragraphs often sit on one line; blank lines belong to
the unit before them. A unit is hashed without the white space around it, so a passage is the same whatever its last unit
ends with. A rolling hash covers each two neighbouring units, and a chunk begins where it is smaller than before and after:
that depends on four units only, so boundaries inside a passage are the same wherever it is pasted.

A chunk has three units on average, and none may lie inside a short passage, nor reach a passage's ends. So windows stand at
every offset and carry a match on, unit by unit, to the ends: one unit or two if they hold over 50 words or ``LONG``
characters, and any three of ``MIN_CHARS`` characters. A repeated run of whole units with over 50 words is covered by its
own windows, from its first unit to its last: three units and more by those of three, shorter ones by the others. Chunks of
up to three units are such windows already; longer ones count by themselves, also where three units are too short to.

Chunks and windows are counted by hash over all documents. Those seen twice are grouped by two hashes of their units (128
bits); of equal ones the first stays, by document id and place, and the units of the rest are cut out. A unit is cut only if
an earlier piece holds it too, so its first place always stays. Up to here only hashes move, and grouping is pre-aggregated,
so a passage in a third of all documents is no hot group. A document's places come back to it in one join. Before anything
is cut, the bytes of all grouped pieces' units are compared: if two units of equal hashes differ, all is hashed again with another seed.

Defined cases: NULL text stays NULL and has no unit; rows that repeat an id and text count as one document and stay
alike; NULL ids come last; blank pieces are never removed; a passage that begins or ends inside a unit leaves that unit;
what stays is joined as it was, byte for byte; input columns named like an added one are replaced.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from tallymill.llm.common import SPACES, bound, kept, kept_alone, without

MIN_CHARS = 40
LONG = 200
LONG_GAPS = 50  # white space characters: any text of over 50 words has that many
# A unit: what holds no end, and then a sentence end, all line ends that follow each other, or the end of the text. Nothing is
# tried twice, which takes a fraction of the time of looking behind every character.
UNIT = "(?:[^\\n.!?]++|[.!?](?! ))*+(?:[.!?] |\\n++|\\z)"
WINDOW = 3


def units_of(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda s: s != "")


def chunks(text: Column) -> Column:
    """``array<struct<pos, s>>``: place and text of each unit."""
    return F.transform(units_of(text), lambda s, i: F.struct(i.alias("pos"), s.alias("s")))


def _bare(s: Column) -> Column:
    return F.btrim(s, F.lit(" \t\n\r"))


def unit_hashes(s: Column, seed: int) -> tuple[Column, Column]:
    """Two hashes of a unit."""
    return F.xxhash64(F.lit(2 * seed), s), F.xxhash64(F.lit(2 * seed + 1), s)


def _gaps(s: Column) -> Column:
    left = s
    for space in SPACES:
        left = F.replace(left, F.lit(space), F.lit(""))
    return F.length(s) - F.length(left)


def chunk_starts(hashes: Column) -> Column:
    """Places where a chunk begins: the first, and where the rolling hash of two units is less than before and after."""
    rolling = F.transform(hashes, lambda h, i: F.xxhash64(F.get(hashes, i - 1), h))
    return bound(rolling, lambda r: F.filter(
        F.transform(r, lambda x, i: F.when((i == 0) | ((x < F.get(r, i - 1)) & (x < F.get(r, i + 1))), i)), lambda i: i.isNotNull()))


def pieces(docs: DataFrame, doc_id: str, text: str, seed: int) -> DataFrame:
    """``(id, hash, pos, n, a, b)``: first unit, number of units and hashes of the chunks and windows that count."""
    value = F.col(f"`{text}`")
    cut = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(value).alias("hash"), units_of(value).alias("s"))
    bare = cut.select("id", "hash", F.transform("s", _bare).alias("t"), F.transform("s", _gaps).alias("gaps"))
    marked = bare.select(
        "id", "hash", F.transform("t", lambda t: unit_hashes(t, seed)[0]).alias("ua"), F.transform("t", lambda t: unit_hashes(t, seed)[1]).alias("ub"),
        F.transform("t", F.length).alias("chars"), "gaps")
    size = F.size("ua")
    length = lambda c: F.aggregate(F.slice("chars", c["pos"] + 1, c["n"]), F.lit(0), lambda total, x: total + x)
    starts = bound(chunk_starts(F.col("ua")), lambda b: F.transform(b, lambda x, k: F.struct(x.alias("pos"), (F.coalesce(F.get(b, k + 1), size) - x).alias("n"))))
    # A place of length zero stands for the windows that begin there. Long texts: arrays are read in place by what follows, which
    # holds no lambda, so that no row takes a copy of them along. Plain ``inline`` would add a filter that repeats all of this.
    places = F.concat(F.transform("ua", lambda _, i: F.struct(i.alias("pos"), F.lit(0).alias("n"))), F.filter(starts, lambda c: (c["n"] > WINDOW) & (length(c) >= MIN_CHARS)))
    marked = marked.withColumn("places", places)
    placed = marked.select("id", "hash", "ua", "ub", "chars", "gaps", F.inline_outer("places")).where("pos IS NOT NULL")
    pos = F.col("pos")

    def window(n: int) -> Column:
        total = lambda name: sum((F.get(name, pos + k) for k in range(1, n)), F.get(name, pos))
        counts = total("chars") >= MIN_CHARS if n == WINDOW else (total("chars") >= LONG) | (total("gaps") >= LONG_GAPS)
        return F.when((F.col("n") == 0) & (pos + n <= size) & counts, F.struct(
            F.lit(n).alias("n"), *[F.xxhash64(*[F.get(u, pos + k) for k in range(n)]).alias(c) for c, u in (("a", "ua"), ("b", "ub"))]))

    part = lambda name: F.slice(name, pos + 1, F.col("n"))
    chunk = F.when(F.col("n") > 0, F.struct(F.col("n"), F.xxhash64(part("ua")).alias("a"), F.xxhash64(part("ub")).alias("b")))
    found = placed.select("id", "hash", "pos", F.explode(F.array(window(1), window(2), window(WINDOW), chunk)).alias("p")).where("p IS NOT NULL")
    return found.select("id", "hash", "pos", "p.*")


def repeated_places(docs: DataFrame, doc_id: str, text: str, seed: int = 0) -> DataFrame:
    """``(id, hash, places, cited)``: the units that each document loses, and all its units in pieces that are grouped; ``hash`` is of
    its whole text."""
    flat = kept(pieces(docs, doc_id, text, seed), "pieces")
    twice = kept(flat.groupBy("a").agg(F.count("*").alias("times")).where("times > 1").select("a"), "repeated")
    # The table of repeated hashes grows with the documents: joined by shuffle at every size, as below.
    seen = kept(flat.join(twice.hint("merge"), "a", "left_semi"), "occurrences")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "pos")
    first = kept(seen.groupBy("a", "b", "n").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"), "first-places")
    units = F.sequence("pos", F.col("pos") + F.col("n") - 1)
    every = lambda value: F.array_distinct(F.flatten(F.collect_list(value)))
    return seen.join(first.hint("merge"), ["a", "b", "n"]).groupBy("id", "hash").agg(
        every(F.when(~place.eqNullSafe(F.col("first")), units)).alias("places"), every(units).alias("cited"))


def _differing(joined: DataFrame, text: str, seed: int) -> bool:
    """Whether two cited units of equal hashes differ in their bytes."""
    cited = joined.where("__cited IS NOT NULL").select(
        bound(units_of(F.col(f"`{text}`")), lambda u: F.transform("__cited", lambda pos: _bare(F.get(u, pos)))).alias("c"))
    # Plain ``explode`` would add a filter that cuts the text again.
    held = cited.select(F.explode_outer("c").alias("bytes")).where("bytes IS NOT NULL")
    a, b = unit_hashes(F.col("bytes"), seed)
    return not held.distinct().groupBy(a.alias("a"), b.alias("b")).count().where("count > 1").isEmpty()


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and ``n_removed`` units and ``chars_removed``."""
    value = F.col(f"`{text}`")
    base = without(docs, "n_removed", "chars_removed")
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.xxhash64(value) == F.col("__hash"))
    for seed in count():
        places = kept_alone(lambda: repeated_places(docs, doc_id, text, seed), "places").withColumnsRenamed({"id": "__id", "hash": "__hash", "places": "__places", "cited": "__cited"})
        # The table of places grows with the documents: joined by shuffle at every size, never broadcast.
        joined = kept(base.join(places.hint("merge"), same, "left").drop("__id", "__hash"), "placed")
        if not _differing(joined, text, seed):
            break
    stay = bound(units_of(value), lambda u: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(u) - 1), "__places"), lambda i: F.get(u, i)), ""))
    joined = joined.withColumn("__text", F.when(F.coalesce(F.size("__places"), F.lit(0)) == 0, value).otherwise(stay))
    columns = [F.col("__text").alias(c) if c == text else F.col(f"`{c}`") for c in base.columns]
    return joined.select(
        *columns, F.coalesce(F.size("__places"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.length(value) - F.length("__text"), F.lit(0)).cast("bigint").alias("chars_removed"))


def keep_remaining(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with what stays of them; those that lose all they had are left out. Columns as they came."""
    cut = remove_repeated(docs, doc_id, text)
    return cut.where(~((F.col("chars_removed") > 0) & (F.btrim(F.col(f"`{text}`"), F.lit(" \t\n\r")) == ""))).select(*[F.col(f"`{c}`") for c in docs.columns])
