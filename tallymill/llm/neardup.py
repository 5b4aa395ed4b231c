"""SimHash near-duplicates: pigeonhole blocks, verified links, connected components.

The fingerprint of a text has a bit set if it is set in over half of the hashes of its 4-word shingles. Texts link if
their fingerprints differ in at most four bits. All work after hashing is on distinct fingerprints, so exact copies are
one point however many there are.

Fingerprints are cut into ``b`` blocks of bits. Two that differ in four bits agree in at least ``b - 4`` blocks, so they
meet in a bucket under some choice of ``b - 4`` blocks. ``b`` grows with the logarithm of their number so that a bucket
holds few by chance. A bucket of near copies is larger: up to ``BUCKET`` members are compared in a task, which returns
only the links of a spanning forest. The members of a still larger bucket are linked without comparing pairs: each is
written to all 2081 points within two bits. Any two that meet at a point differ in at most four bits, and any two that
differ in at most four meet at some point, so linking each to the least fingerprint of its points loses nothing and the
work stays in proportion to the members.

``keep_one``, the corpus stage, has its own rule: texts link if the Jaccard similarity of their sets of 5-word shingles is
0.8 or more. Candidates are first the SimHash links above (of 5-word shingles, at four bits), and then, as a pair at 0.8
differs in some ten bits, texts that share one of 20 bands of five minimum hashes, which a pair at 0.8 does in all but 4 of
10,000 cases. All candidates are verified by their whole sets: first each bucket's members with its least one, then pairs of a
bucket that the links found so far leave in different components. Up to ``PAIRED`` members that is all pairs. A larger bucket may
hold a crowd of copies of one text, each with too many changes of its own to link to the others. There the most typical member,
the one with the least share of shingles of its own, is compared with all, and what is left is met by prefixes (Chaudhuri et al.,
2006; Xiao et al., 2008): shingles are ordered from the rarest on, without those of a single set, which no pair shares, and two
similar sets share one of their first few. A copy with more shingles of its own than a link allows has no such prefix and meets
nobody. Prefixes are the shorter the closer the sizes are, so that they are met by classes of sizes. Nothing that links is lost;
what still costs more than its members is a crowd whose changes are common to many of them and which lies just under the limit.

``drop_copies`` goes before it where passages were cut out of the texts: it drops documents whose whole text, as it came, is
a near copy of that of an earlier document which is still there. Rows meet whole texts by id; an id with several texts is
dropped only if all of them are such copies.

Components: large-star and small-star rounds (Kiveris et al., 2014) over the links, each written to the shared folder.

Defined cases: NULL and empty texts have fingerprint zero and link like any other; a text of fewer words than a shingle
is one shingle; the least non-NULL id names a component, NULL if it has none; repeated rows are members like others;
input columns named like an added one are replaced.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallymill.llm.common import kept, kept_alone

SHINGLE = 4
SEED = 42
MAX_BITS = 4
BUCKET = 4096
# The corpus stage.
STAGE_SHINGLE = 5
MIN_PERCENT = 80
BANDS, BAND_ROWS = 20, 5
# Buckets of more members are not paired but joined by rare shingles, in classes of sizes about a fiftieth apart.
PAIRED = 16
CLASSES = 50
FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """The hash of each window of ``shingle`` words; of all words if they are fewer."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())], dtype="<u8")


def simhash(text: bytes | None) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or b"").lower().split()
    return majority(shingle_hashes(words, SHINGLE)) if words else 0


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([simhash(t.as_py()) for t in texts], pa.int64())


def fingerprint(text: str) -> Column:
    return F.arrow_udf(_fingerprints, "bigint")(F.col(f"`{text}`").cast("binary"))


def block_masks(n_points: int) -> list[int]:
    """Bit masks (signed) of all choices of ``b - 4`` out of ``b`` blocks."""
    blocks = MAX_BITS + 1
    while 64 // blocks * (blocks - MAX_BITS) < max(n_points, 1).bit_length() and blocks < 16:
        blocks += 1
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - MAX_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(buckets: pa.Array) -> pa.Array:
    """Links of a spanning forest of each bucket's graph of close members."""
    out = []
    for bucket in buckets:
        points = np.unique(bucket.values.to_numpy(zero_copy_only=False))
        left, links = np.ones(len(points), dtype=bool), []
        while left.any():
            queue = [int(np.flatnonzero(left)[0])]
            left[queue[0]] = False
            while queue:
                here = queue.pop()
                rest = np.flatnonzero(left)
                near = rest[np.bitwise_count((points[rest] ^ points[here]).view(np.uint64)) <= MAX_BITS]
                left[near] = False
                links += [{"a": int(points[here]), "b": int(points[k])} for k in near]
                queue += near.tolist()
        out.append(links)
    return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))


def _balls() -> list[int]:
    """All patterns of at most two bits, signed."""
    flips = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)]
    return [f - (1 << 64) if f >> 63 else f for f in flips]


def links(points: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints (column ``fp``) that give their components."""
    masks = block_masks(points.count())
    keyed = points.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "bits"))
    sizes = kept(keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    met = keyed.join(sizes.where(F.col("n") <= bucket), ["choice", "bits"])
    forest = F.arrow_udf(_forest, "array<struct<a:bigint,b:bigint>>")
    close = met.groupBy("choice", "bits").agg(F.collect_list("fp").alias("fps")).select(F.explode(forest("fps")).alias("e")).select("e.a", "e.b")
    large = sizes.where(F.col("n") > bucket)
    if large.isEmpty():
        return close.distinct()
    crowd = kept(keyed.join(large, ["choice", "bits"], "left_semi").select("fp").distinct(), "crowd")
    flips = F.lit(np.array(_balls(), dtype=np.int64))
    at = crowd.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    least = at.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    around = at.join(least, "point").where("fp <> a").select("a", F.col("fp").alias("b"))
    return close.unionByName(around).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for the nodes of ``edges`` (``a, b``); the label is the component's least node."""
    def checked(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = kept(df.distinct(), "stars")
        digest = df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return df, tuple(digest)

    def both(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")

    tree, state = checked(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    while state[0]:
        ways = both(tree)
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        larger = ways.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = kept(larger.distinct(), "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        smaller = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        tree, after = checked(smaller.select("e.u", "e.v").where("u <> v"))
        if after == state:
            break
        state = after
    top = tree.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return tree.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(top)


def named_components(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``(fp, component, component_id)`` of each of ``points`` (``fp``, ``first_id``)."""
    found = components(edges)
    named = points.join(found, points["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("label", "fp").alias("component"))
    named = kept(named, "named")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return named.select("fp", "component").join(least, "component")


def label_points(marked: DataFrame, doc_id: str, bucket: int = BUCKET) -> DataFrame:
    """``(fp, component, component_id)`` of each distinct fingerprint in ``marked`` (a written table with ``fp``)."""
    points = kept(marked.groupBy("fp").agg(F.min(F.col(f"`{doc_id}`")).alias("first_id")), "points")
    return named_components(points, links(points.select("fp"), bucket))


def banded(text: bytes | None) -> tuple[int, int, list[int]]:
    """A hash of all words, the fingerprint, and one hash per band of minimum hashes; all signed, 0 and none without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0, 0, []
    every = shingle_hashes(words, STAGE_SHINGLE)
    hashes, least = np.unique(every), np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 1 << 12):
        mixed = (hashes[k:k + (1 << 12), None] ^ (hashes[k:k + (1 << 12), None] >> np.uint64(29))) * FACTORS
        least = np.minimum(least, (mixed >> np.uint64(20)).min(axis=0))
    signed = lambda data, seed: int(np.uint64(xxhash.xxh64_intdigest(data, seed)).view(np.int64))
    return signed(b" ".join(words), SEED), majority(every), [signed(least[k * BAND_ROWS:(k + 1) * BAND_ROWS].tobytes(), k) for k in range(BANDS)]


def _banded(texts: pa.Array) -> pa.Array:
    found = [banded(t.as_py()) for t in texts]
    fps, sims, bands = ([f[k] for f in found] for k in range(3))
    return pa.StructArray.from_arrays([pa.array(fps, pa.int64()), pa.array(sims, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["fp", "sim", "bands"])


def _shingle_sets(texts: pa.Array) -> pa.Array:
    return pa.array([np.unique(shingle_hashes((t.as_py() or b"").lower().split(), STAGE_SHINGLE)).view(np.int64) for t in texts], pa.list_(pa.int64()))


def _similar(left: pa.Array, right: pa.Array) -> pa.Array:
    """Whether the Jaccard similarity of two sets is ``MIN_PERCENT`` or more."""
    out = []
    for a, b in zip(left, right):
        a, b = a.values.to_numpy(), b.values.to_numpy()
        both = len(np.intersect1d(a, b, assume_unique=True))
        out.append(100 * both >= MIN_PERCENT * (len(a) + len(b) - both))
    return pa.array(out, pa.bool_())


def close_pairs(points: DataFrame) -> DataFrame:
    """``(a, b)``, ``a < b``: points (``fp``, ``sim``) linked by their fingerprints ``sim``, one of each fingerprint for all."""
    least = kept(points.groupBy("sim").agg(F.min("fp").alias("least")), "fingerprints")
    equal = points.join(least.hint("merge"), "sim").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    one, other = (least.select(F.col("sim").alias(c), F.col("least").alias(f"fp_{c}")) for c in "ab")
    near = links(least.select(F.col("sim").alias("fp"))).join(one.hint("merge"), "a").join(other.hint("merge"), "b")
    return equal.unionByName(near.select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")))


def similar_links(docs: DataFrame, points: DataFrame, text: str) -> DataFrame:
    """``(a, b)``: verified links among ``points`` (a written table of ``fp``, the ``hash`` of a text, ``sim``, ``bands``)."""
    keyed = points.select("fp", "hash", F.explode("bands").alias("key"))
    several = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1").drop("n")
    met = kept(keyed.join(several.hint("merge"), "key"), "buckets")
    close = close_pairs(points.where(F.size("bands") > 0).select("fp", "sim"))
    stars = kept(close.unionByName(met.where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))).distinct(), "candidates")
    named = met.select("fp").unionByName(stars.select(F.explode(F.array("a", "b")).alias("fp"))).distinct()
    wanted = points.select("fp", "hash").join(named.hint("merge"), "fp", "left_semi")
    value = F.col(f"`{text}`")
    texts = docs.select(F.xxhash64(value).alias("hash"), value.cast("binary").alias("text")).join(wanted.hint("merge"), "hash")
    sets = kept(texts.select("fp", F.arrow_udf(_shingle_sets, "array<bigint>")("text").alias("s")).dropDuplicates(["fp"]), "shingle-sets")

    def verified(pairs: DataFrame, sets: DataFrame = sets) -> DataFrame:
        left, right = (sets.select(F.col("fp").alias(c), F.col("s").alias(f"s_{c}")) for c in "ab")
        both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
        return kept(both.where(F.arrow_udf(_similar, "boolean")("s_a", "s_b")).select("a", "b"), "links")

    first = verified(stars)
    left = still_apart(met, first)
    sizes = kept(left.groupBy("key").agg(F.count("*").alias("n")), "bucket-sizes")
    few, many = (left.join(sizes.where(c).hint("merge"), "key", "left_semi") for c in (F.col("n") <= PAIRED, F.col("n") > PAIRED))
    one, other = (few.select("key", F.col("fp").alias(c), F.col("part").alias(f"part_{c}")) for c in "ab")
    pairs = one.join(other.hint("merge"), "key").where("a < b AND part_a <> part_b").select("a", "b")
    if sizes.where(F.col("n") > PAIRED).isEmpty():
        return first.unionByName(verified(pairs.distinct().join(stars.hint("merge"), ["a", "b"], "left_anti")))
    crowded = kept(sets.join(many.select("fp").distinct().hint("merge"), "fp", "left_semi"), "crowded-sets")
    ordered = kept(rare_first(crowded), "rare-first")
    asked = kept(pairs.unionByName(centre_pairs(many, ordered)).distinct().join(stars.hint("merge"), ["a", "b"], "left_anti"), "candidates")
    second = first.unionByName(verified(asked))
    rest = rare_pairs(still_apart(many.select("key", "fp"), second), ordered)
    return second.unionByName(verified(rest.join(stars.unionByName(asked).hint("merge"), ["a", "b"], "left_anti"), crowded))


def still_apart(met: DataFrame, found: DataFrame) -> DataFrame:
    """``(key, fp, part)``: members of buckets (``key``, ``fp``) that the links ``found`` leave in several components, and their own one."""
    labels = components(found)
    placed = kept(met.join(labels.hint("merge"), met["fp"] == labels["node"], "left").select("key", "fp", F.coalesce("label", "fp").alias("part")), "placed")
    apart = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    return kept(placed.join(apart.hint("merge"), "key", "left_semi"), "apart")


def rare_first(sets: DataFrame) -> DataFrame:
    """``(fp, size, class, rare)`` of the ``sets`` (``fp``, ``s``): their size and its class, and the shingles that another one holds too,
    the rarest first."""
    flat = sets.select("fp", F.explode("s").alias("shingle"))
    shared = flat.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    found = flat.join(shared.hint("merge"), "shingle").groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("r"))
    size_class = F.floor(F.log(F.col("size").cast("double")) * CLASSES)
    sized = sets.select("fp", F.size("s").alias("size")).join(found.hint("merge"), "fp")
    return sized.select("fp", "size", size_class.alias("class"), F.col("r.shingle").alias("rare"))


def centre_pairs(members: DataFrame, ordered: DataFrame) -> DataFrame:
    """``(a, b)``, ``a < b``: each of ``members`` with the one of its bucket that has the least share of shingles of its own, as the
    text that all others were made from."""
    shares = members.join(ordered.select("fp", (F.size("rare") / F.col("size")).alias("share")).hint("merge"), "fp")
    centre = shares.groupBy("key").agg(F.max(F.struct("share", "fp", "part")).alias("c")).select("key", F.col("c.fp").alias("centre"), F.col("c.part").alias("its"))
    other = members.join(centre.hint("merge"), "key").where("part <> its")
    return other.select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b"))


def rare_pairs(members: DataFrame, ordered: DataFrame) -> DataFrame:
    """``(a, b)``, ``a < b``: pairs of different parts that hold all similar ones of a bucket, among ``members`` (``key``, ``fp``, ``part``)
    with their sets as ``rare_first`` orders them."""
    # The sizes that a set meets in its buckets: by class, the least one.
    sized = members.join(ordered.select("fp", "size", "class").hint("merge"), "fp").select("key", "fp", F.col("class").alias("own"), "size")
    met = sized.groupBy("key", F.col("own").alias("class")).agg(F.min("size").alias("low"))
    mates = sized.join(met.hint("merge"), "key").where("class <= own").groupBy("fp", "class").agg(F.min("low").alias("low"))
    # Sets of this size or more that are similar share at least that many shingles, so one of the first ``length``.
    low = F.greatest("low", F.ceil(F.col("size") * MIN_PERCENT / 100))
    length = F.size("rare") - F.ceil(MIN_PERCENT * (F.col("size") + low) / (100 + MIN_PERCENT)) + 1
    begun = ordered.withColumnRenamed("class", "own").join(members.select("fp", "part").distinct().hint("merge"), "fp").join(mates.hint("merge"), "fp")
    begun = begun.withColumn("length", length.cast("int")).where("length > 0").withColumn("n", F.size("rare"))
    heads = begun.select("fp", "part", "size", "own", "class", "n", F.posexplode(F.slice("rare", 1, F.col("length"))).alias("at", "shingle"))
    heads = kept(heads.withColumn("rest", F.col("n") - F.col("at")).drop("n", "at"), "prefixes")
    mixed = heads.groupBy("shingle", "class").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("shingle", "class")
    heads = heads.join(mixed.hint("merge"), ["shingle", "class"], "left_semi")
    # A set meets those of its own class and of smaller ones.
    a, b = (df.select("shingle", "class", F.col("own").alias(f"own_{c}"), *[F.col(x).alias(f"{x}_{c}") for x in ("fp", "part", "size", "rest")])
            for df, c in ((heads, "a"), (heads.where("own = class"), "b")))
    enough = (100 + MIN_PERCENT) * F.least("rest_a", "rest_b") >= MIN_PERCENT * (F.col("size_a") + F.col("size_b"))
    once = (F.col("own_a") > F.col("own_b")) | (F.col("fp_a") < F.col("fp_b"))
    close = a.join(b.hint("merge"), ["shingle", "class"]).where((F.col("part_a") != F.col("part_b")) & once & enough)
    return close.select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row."""
    marked = kept(docs.select(F.col(f"`{doc_id}`"), fingerprint(text).alias("fp")), "fingerprints")
    labels = label_points(marked, doc_id, **options)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return marked.join(labels, "fp").select(F.col(f"`{doc_id}`"), hexed, "component_id")


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(id, hash, n, component)``: rows of one id and text, how many they are, and their near-duplicate group."""
    sketch = F.arrow_udf(_banded, "struct<fp:bigint,sim:bigint,bands:array<bigint>>")(F.col(f"`{text}`").cast("binary"))
    marked = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("hash"), sketch.alias("k"))
    marked = kept(marked.select("id", "hash", "k.fp", "k.sim", "k.bands"), "sketches")
    points = kept(marked.groupBy("fp").agg(F.min("id").alias("first_id"), F.min(F.struct("hash", "sim", "bands")).alias("k")).select("fp", "first_id", "k.*"), "points")
    labels = named_components(points.select("fp", "first_id"), similar_links(docs, points, text))
    return marked.groupBy("id", "hash", "fp").agg(F.count("*").alias("n")).join(labels, "fp").select("id", "hash", "n", "component")


def _first_key() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), "id", "hash")


def drop_copies(docs: DataFrame, whole: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those whose texts in ``whole`` are near copies of the text there of an earlier id in ``docs``."""
    own = F.col(f"`{doc_id}`")

    def copies() -> DataFrame:
        here = docs.select(own.alias("__here")).distinct()
        present = whole.select(own, F.col(f"`{text}`")).join(here.hint("merge"), own.eqNullSafe(F.col("__here")), "left_semi")
        units = kept(_grouped(kept(present, "whole"), doc_id, text), "units")
        first = units.groupBy("component").agg(F.min(_first_key()).alias("first"))
        later = ~F.col("id").eqNullSafe(F.col("first.id"))
        gone = units.join(first.hint("merge"), "component").groupBy("id").agg(F.bool_and(later).alias("gone"))
        return gone.where("gone").select(F.col("id").alias("__gone"))

    return docs.join(kept_alone(copies, "copies").hint("merge"), own.eqNullSafe(F.col("__gone")), "left_anti")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the least id of each component (least text hash among rows of one id), columns as they came.

    Ids and hashes are written and grouped; ``docs`` is read again to verify candidates and to meet the chosen ones.
    """
    own_id, own_hash = F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`"))

    def firsts() -> DataFrame:
        # Rows of one id and text are one unit, so that the rare repeated row is all that is left to thin out.
        first = _grouped(docs, doc_id, text).groupBy("component").agg(F.min(F.struct(_first_key().alias("key"), "n")).alias("k"))
        return first.select(F.col("k.key.id").alias("__id"), F.col("k.key.hash").alias("__hash"), F.col("k.n").alias("__n"))

    chosen = kept_alone(firsts, "chosen")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), own_id.alias("__own"), own_hash.alias("__of"))
    same = F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__hash"))
    single = rows.join(chosen.where("__n = 1"), same, "left_semi").select("__row.*")
    several = rows.join(chosen.where("__n > 1"), same, "left_semi").groupBy("__own", "__of").agg(F.first("__row").alias("__row")).select("__row.*")
    return single.unionByName(several)
