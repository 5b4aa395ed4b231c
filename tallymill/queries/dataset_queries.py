"""Queries that build training sets, epoch orders and mixed targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.operators import mixing as X
from tallymill.operators import sampling as D
from tallymill.plans.indexing import by_number
from tallymill.queries.registry import query


def h(*parts) -> str:
    """Check SQL for the md5 of the parts."""
    return f"md5(concat_ws('|', {', '.join(str(p) for p in parts)}))"


def u(*parts) -> str:
    """Check SQL for the uniform draw of the parts."""
    return f"(('0x' || substr({h(*parts)}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def r6(*columns):
    return [F.round(c, 6).alias(c) for c in columns]


@query("d1_long_tail_profile", """
SELECT rank, CASE WHEN rank = 0 THEN 1280 WHEN rank = c - 1 THEN 5 ELSE CAST(greatest(5, least(1280, round_even(1280.0::DOUBLE * pow(5.0::DOUBLE / 1280, rank::DOUBLE / (c - 1)), 0))) AS BIGINT) END AS rows
FROM (SELECT row_number() OVER (ORDER BY l_suppkey) - 1 AS rank, count(*) OVER () AS c FROM (SELECT DISTINCT l_suppkey FROM lineitem) d) q
""")
def long_tail_profile(t):
    return D.long_tail_profile(t.lineitem.select("l_suppkey").distinct(), 1280, 5)


@query("d1_assign_ranks", f"""
WITH n AS (SELECT l_suppkey AS label, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT min(n) AS big, count(*) AS c FROM n)
SELECT label, CAST(rank AS INTEGER) AS rank, CASE WHEN rank = 0 THEN big WHEN rank = c - 1 THEN 1 ELSE CAST(greatest(1, least(big, round_even(big::DOUBLE * pow(1.0::DOUBLE / big, rank::DOUBLE / (c - 1)), 0))) AS BIGINT) END AS rows
FROM (SELECT label, row_number() OVER (ORDER BY {h(42, 'label')}) - 1 AS rank FROM n) q, s
""")
def assign_ranks(t):
    counts = t.lineitem.groupBy(F.col("l_suppkey").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    smallest = counts.agg(F.min("n")).first()[0]
    # Every class has enough rows for every count, so the choice is the seeded order itself.
    return D.assign_ranks(counts, D.long_tail_profile(counts, smallest, 1), 42)


@query("d2_select_long_tail", f"""
WITH n AS (SELECT lang, count(*) // 3 AS rows FROM documents GROUP BY lang),
p AS (SELECT d.lang, d.doc_id, row_number() OVER (PARTITION BY d.lang ORDER BY {h(42, 0, 'd.doc_id')}, d.doc_id) AS rk FROM documents d)
SELECT p.lang, p.doc_id, row_number() OVER (ORDER BY {h(42, "'order'", 'p.doc_id')}, p.doc_id) - 1 AS position FROM p JOIN n ON n.lang = p.lang AND p.rk <= n.rows
""")
def select_long_tail(t):
    counts = t.documents.groupBy(F.col("lang").alias("label")).agg(F.floor(F.count(F.lit(1)) / 3).alias("rows"))
    return D.select_long_tail(t.documents.select("lang", "doc_id"), "lang", "doc_id", counts, 42)


@query("d3_source_pool", f"""
WITH c AS (SELECT concat('img', doc_id // 2, '.jpg') AS base, concat('shard', doc_id % 7, '/img', doc_id // 2, '.jpg') AS path, n_chars FROM documents),
k AS (SELECT base, min(path) AS path FROM c GROUP BY base),
o AS (SELECT *, row_number() OVER (ORDER BY {h(7, 0, 'base')}, base) - 1 AS position FROM k)
SELECT o.base, o.path, o.position, c.n_chars FROM o JOIN c ON c.base = o.base AND c.path = o.path WHERE position < 80
""")
def source_pool(t):
    base = F.concat(F.lit("img"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".jpg"))
    path = F.concat(F.lit("shard"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), base)
    pool = D.source_pool(t.documents.select(base.alias("base"), path.alias("path"), "n_chars"), "base", "path", 80, 7)
    return pool.withColumn("position", F.col("position") - 1)


@query("d4_stratified_cap", f"""
SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {h(5, 0, 'doc_id')}, doc_id) AS rk FROM documents) q WHERE rk <= 40
""")
def stratified_cap(t):
    return D.stratified_cap(t.documents.select("lang", "doc_id"), "lang", "doc_id", 40, 5)


@query("d5_capped_label_sample", """
WITH a AS (SELECT doc_id, source, n_chars, CASE WHEN source IN ('src3', 'src4') THEN 0 ELSE 1 END AS allowed,
    CASE WHEN source NOT IN ('src3', 'src4') AND n_chars >= 300 THEN 1 ELSE 0 END AS fits FROM documents),
b AS (SELECT *, coalesce(sum(fits) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a),
o AS (SELECT *, CASE WHEN allowed = 0 THEN 'label' WHEN before >= 4 THEN 'cap' WHEN fits = 0 THEN 'size' ELSE 'accepted' END AS outcome FROM b),
n AS (SELECT *, CAST(sum(CASE WHEN outcome = 'accepted' THEN 1 ELSE 0 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS acc FROM o)
SELECT doc_id, source, outcome, CASE WHEN outcome = 'accepted' THEN acc ELSE 0 END AS number FROM n WHERE acc - CASE WHEN outcome = 'accepted' THEN 1 ELSE 0 END < 50
""")
def capped_label_sample(t):
    allowed = [f"src{i}" for i in range(20) if i not in (3, 4)]
    out = D.capped_label_sample(t.documents.select("doc_id", "source", "n_chars"), "source", "doc_id", F.col("n_chars"), 50, 4, 300, allowed)
    return out.select("doc_id", "source", "outcome", F.coalesce("number", F.lit(0)).alias("number"))


@query("d6_resampled_schedule", f"""
WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
m AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents),
d AS (SELECT r.range AS cycle, n.lang, CAST(floor({u(3, 2, 'r.range', 'n.lang')} * n.n) AS BIGINT) AS i FROM n, range(1000000) r WHERE r.range < (SELECT min(n) FROM n))
SELECT d.cycle, row_number() OVER (PARTITION BY d.cycle ORDER BY {h(3, 2, "'cycle'", 'd.cycle', 'd.lang')}) - 1 AS pos, d.lang, m.doc_id FROM d JOIN m ON m.lang = d.lang AND m.i = d.i
""")
def resampled_schedule(t):
    return D.resampled_schedule(t.documents, "lang", "doc_id", "min", 3, 2)


LEVELS = f"""lv0 AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {h(42, 0, 'doc_id')}, doc_id) - 1 AS level FROM documents),
lv AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY {h(42, 0, "'level'", 'doc_id')}, doc_id) - 1 AS pos, count(*) OVER (PARTITION BY level) AS n FROM lv0)"""


def schedule(t):
    return D.natural_schedule(t.documents.select("lang", "doc_id"), "lang", "doc_id", 42, 0)


@query("d7_natural_schedule", f"WITH {LEVELS} SELECT lang, doc_id, level, pos, n AS level_rows FROM lv")
def natural_schedule(t):
    return schedule(t)


@query("d8_natural_mixed_schedule", f"""
WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), tot AS (SELECT count(*)::DOUBLE AS total FROM documents),
i AS (SELECT d.lang, d.doc_id, n.n, total, row_number() OVER (PARTITION BY d.lang ORDER BY {h(9, 1, 'd.doc_id')}, d.doc_id) - 1 AS i FROM documents d JOIN n ON n.lang = d.lang, tot),
p AS (SELECT *, greatest(0, least(total - 1, CASE WHEN n = 1 THEN 0.5 * total ELSE (i + 0.5::DOUBLE) * (total / n) END + ({u(9, 1, "'jitter'", 'doc_id')} - 0.5::DOUBLE) * least(total / n, 1.0))) AS place FROM i),
g AS (SELECT *, row_number() OVER (ORDER BY place, doc_id) - 1 AS g FROM p),
s AS (SELECT *, (g // 64) * 64 + row_number() OVER (PARTITION BY g // 64 ORDER BY {h(9, 1, "'chunk'", 'doc_id')}, doc_id) - 1 AS slot FROM g)
SELECT doc_id, lang, round(place, 6) AS place, slot, slot // 6 AS "row", CAST(slot % 6 AS INTEGER) AS col FROM s
""")
def natural_mixed_schedule(t):
    out = D.natural_mixed_schedule(t.documents.select("lang", "doc_id"), "lang", "doc_id", 9, 1, 64, 6)
    return out.select("doc_id", "lang", F.round("place", 6).alias("place"), "slot", "row", "col")


K = 3
RAW = ", ".join(f"-ln({u(42, 0, chr(39) + 'weights' + chr(39), 'level', j)} + 1e-12)" for j in range(K))


@query("d9_mix_groups", f"""
WITH {LEVELS},
home AS (SELECT level, n, doc_id, lang, CASE WHEN n < {K} THEN pos ELSE pos // {K} END AS grp, CASE WHEN n < {K} THEN 0 ELSE pos % {K} END AS slot, 1 AS leads FROM lv),
fill AS (SELECT *, ((pos - CAST(floor({u(42, 0, "'fill'", 'level')} * (n - n % {K})) AS BIGINT)) % (n - n % {K}) + (n - n % {K})) % (n - n % {K}) AS f
  FROM lv WHERE n >= {K} AND n % {K} > 0 AND pos < n - n % {K}),
guest AS (SELECT level, n, doc_id, lang, n // {K} AS grp, n % {K} + f AS slot, 0 AS leads FROM fill WHERE f < {K} - n % {K}),
mem AS (SELECT * FROM home UNION ALL SELECT * FROM guest),
packed AS (SELECT level, grp, max(n) AS n, sum(leads) AS outs, list(lang ORDER BY slot) AS ls, list(doc_id ORDER BY slot) AS ks FROM mem GROUP BY level, grp),
o AS (SELECT level, grp, n, ls, ks, unnest(range(outs::BIGINT)) AS s FROM packed),
w AS (SELECT level, list_sort([{RAW}]) AS w FROM (SELECT DISTINCT level FROM lv) q)
SELECT o.level, o.grp AS "group", CAST(s AS INTEGER) AS shift, ks[1 + s] AS doc_id, n >= {K} AS mixed,
  CASE WHEN n < {K} THEN ls[1] ELSE concat_ws(',', ls[1 + s % {K}], ls[1 + (s + 1) % {K}], ls[1 + (s + 2) % {K}]) END AS labels,
  CASE WHEN n < {K} THEN 1.0::DOUBLE ELSE round(w.w[{K}] / list_sum(w.w), 6) END AS top_weight
FROM o JOIN w ON w.level = o.level
""")
def mix_groups(t):
    weights = X.level_weights(K, 42, 0, F.col("level"))
    out = X.mix_groups(schedule(t), "lang", "doc_id", K, weights, 42, 0)
    return out.select(
        "level", "group", "shift", "doc_id", "mixed", F.array_join(F.transform("target", lambda s: s["label"]), ",").alias("labels"),
        F.round(F.element_at("target", -1)["weight"], 6).alias("top_weight"))


@query("d10_dirichlet_weights", f"""
WITH {LEVELS}, w AS (SELECT level, list_sort([{RAW}]) AS w FROM (SELECT DISTINCT level FROM lv) q)
SELECT level, CAST(i.i AS INTEGER) AS slot, round(w[i.i + 1] / list_sum(w), 6) AS weight FROM w, (VALUES (0), (1), (2)) i(i)
""")
def dirichlet_weights(t):
    levels = schedule(t).select("level").distinct()
    return levels.select("level", F.posexplode(X.level_weights(K, 42, 0, F.col("level"))).alias("slot", "weight")).withColumn("weight", F.round("weight", 6))


def gu(what: str, t: str = "t") -> str:
    """Check SQL for a uniform of a gamma draw."""
    return f"({u('key', 'j', what, t)} + {2.0 ** -33!r}::DOUBLE)"


@query("d10_dirichlet_weights_general", f"""
WITH {LEVELS}, a AS (SELECT level, j.range AS j, t.range AS t, {h(42, 0, "'weights'", 'level')} AS key, CASE WHEN level % 3 = 2 THEN 2.5::DOUBLE ELSE 0.4::DOUBLE END AS alpha
  FROM (SELECT DISTINCT level FROM lv) q, range(4) j, range(12) t),
n AS (SELECT *, CASE WHEN alpha < 1 THEN alpha + 1 ELSE alpha END - 1 / 3.0::DOUBLE AS d, sqrt(-2 * ln({gu("'r'")})) * cos(2 * pi() * {gu("'c'")}) AS x FROM a),
v AS (SELECT *, power(1 + x / sqrt(9 * d), 3) AS v FROM n),
g AS (SELECT level, j, arg_min(ln(d * v), t) AS lg, any_value(CASE WHEN alpha < 1 THEN ln({gu("'s'", '0')}) / alpha ELSE 0 END) AS boost
  FROM v WHERE v > 0 AND ln({gu("'a'")}) < 0.5::DOUBLE * x * x + d - d * v + d * ln(greatest(v, 1e-300)) GROUP BY level, j),
e AS (SELECT level, exp(lg + boost - max(lg + boost) OVER (PARTITION BY level)) AS e FROM g)
SELECT level, CAST(row_number() OVER (PARTITION BY level ORDER BY e) - 1 AS INTEGER) AS slot, round(e / sum(e) OVER (PARTITION BY level), 6) AS weight FROM e
""")
def dirichlet_general(t):
    """Shapes below and above one."""
    alpha = F.when(F.col("level") % 3 == 2, 2.5).otherwise(0.4)
    levels = schedule(t).select("level").distinct()
    return levels.select("level", F.posexplode(X.level_weights(4, 42, 0, F.col("level"), alpha)).alias("slot", "weight")).withColumn("weight", F.round("weight", 6))


def embedded(t):
    return t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("payload"))


BATCHES = """r AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS g, count(*) OVER () AS total FROM embeddings),
b AS (SELECT vec_id, label, embedding, g // 48 AS batch, g % 48 AS pos, least(48, total - g // 48 * 48) AS rows FROM r)"""


@query("d11_pair_mix", f"""
WITH {BATCHES},
p AS (SELECT a.vec_id, a.label, a.embedding AS e, b.embedding AS o, b.vec_id AS partner, b.label AS partner_label, a.batch, least(a.pos, a.rows - 1 - a.pos) AS scope FROM b a JOIN b ON b.batch = a.batch AND b.pos = a.rows - 1 - a.pos),
l AS (SELECT *, CASE WHEN {u(1, 0, "'use'", 'batch', 'scope')} < 0.8::DOUBLE THEN {u(1, 0, "'lam'", 'batch', 'scope')} ELSE 1.0::DOUBLE END AS lam FROM p)
SELECT vec_id, partner, round(lam, 6) AS lam, round(list_sum(list_transform(e, lambda x: x::DOUBLE)) * lam + list_sum(list_transform(o, lambda x: x::DOUBLE)) * (1 - lam), 6) AS payload_sum,
  round((0.9::DOUBLE + 0.01) * (lam + CASE WHEN label = partner_label THEN 1 - lam ELSE 0 END) + 0.01::DOUBLE * (CASE WHEN label = partner_label THEN 0 ELSE 1 - lam END), 6) AS own_target FROM l
""")
def pair_mix(t):
    rows = X.batched(embedded(t), by_number(F.col("vec_id")), 48)
    out = X.pair_mix(rows, "vec_id", "label", mode="pair", prob=0.8, seed=1, payload="payload")
    # In its own projection: inside a lambda, "lam" next to an alias "lam" would mean the rounded alias.
    out = out.withColumn("target", X.soft_label(F.col("label"), F.col("partner_label"), F.col("lam"), 10, 0.1))
    total = F.aggregate("mixed_payload", F.lit(0.0), lambda acc, x: acc + x)
    return out.select("vec_id", "partner", F.round("lam", 6).alias("lam"), F.round(total, 6).alias("payload_sum"), F.round(F.get("target", F.col("label")), 6).alias("own_target"))


@query("d11_pair_cut", f"""
WITH {BATCHES},
p AS (SELECT a.vec_id, a.embedding AS e, b.embedding AS o, b.vec_id AS partner, a.batch, a.pos FROM b a JOIN b ON b.batch = a.batch AND b.pos = a.rows - 1 - a.pos),
l AS (SELECT *, {u(1, 3, "'lam'", 'batch', 'pos')} AS lam, {u(1, 3, "'cut'", 'batch', 'pos')} < 0.5::DOUBLE AS cut, CAST(floor({u(1, 3, "'cy'", 'batch', 'pos')} * 8) AS INTEGER) AS cy,
   CAST(floor({u(1, 3, "'cx'", 'batch', 'pos')} * 8) AS INTEGER) AS cx FROM p),
x AS (SELECT *, CAST(floor(floor(sqrt(1 - lam) * 8) / 2) AS INTEGER) AS half FROM l),
z AS (SELECT *, greatest(0, cy - half) AS y0, least(8, cy + half) AS y1, greatest(0, cx - half) AS x0, least(8, cx + half) AS x1 FROM x),
f AS (SELECT *, CASE WHEN cut THEN 1 - (y1 - y0) * (x1 - x0) / 64.0::DOUBLE ELSE lam END AS fl FROM z),
v AS (SELECT vec_id, partner, fl, cut, y0, y1, x0, x1, unnest(e)::DOUBLE AS a, unnest(o)::DOUBLE AS b, generate_subscripts(e, 1) - 1 AS i FROM f)
SELECT vec_id, partner, cut, round(fl, 6) AS lam, round(sum(CASE WHEN NOT cut THEN a * fl + b * (1 - fl) WHEN i // 8 >= y0 AND i // 8 < y1 AND i % 8 >= x0 AND i % 8 < x1 THEN b ELSE a END), 6) AS payload_sum
FROM v GROUP BY vec_id, partner, cut, fl
""")
def pair_cut(t):
    rows = X.batched(embedded(t), by_number(F.col("vec_id")), 48)
    out = X.pair_mix(rows, "vec_id", "label", mode="elem", cut_prob=0.5, height=8, width=8, seed=1, epoch=3, payload="payload")
    total = F.aggregate("mixed_payload", F.lit(0.0), lambda acc, x: acc + x)
    return out.select("vec_id", "partner", "cut", F.round("lam", 6).alias("lam"), F.round(total, 6).alias("payload_sum"))


@query("d11_pair_box", f"""
WITH {BATCHES},
p AS (SELECT a.vec_id, a.embedding AS e, b.embedding AS o, b.vec_id AS partner, a.batch, least(a.pos, a.rows - 1 - a.pos) AS scope FROM b a JOIN b ON b.batch = a.batch AND b.pos = a.rows - 1 - a.pos),
l AS (SELECT *, {u(1, 4, "'lam'", 'batch', 'scope')} AS lam, {u(1, 4, "'cut'", 'batch', 'scope')} < 0.6::DOUBLE AS cut, 2 + CAST(floor({u(1, 4, "'h'", 'batch', 'scope')} * 5) AS INTEGER) AS h,
   2 + CAST(floor({u(1, 4, "'w'", 'batch', 'scope')} * 5) AS INTEGER) AS w, {u(1, 4, "'cy'", 'batch', 'scope')} AS uy, {u(1, 4, "'cx'", 'batch', 'scope')} AS ux FROM p),
z AS (SELECT *, CAST(floor(uy * (8 - h)) AS INTEGER) AS y0, CAST(floor(ux * (8 - w)) AS INTEGER) AS x0, CASE WHEN cut THEN 1 - h * w / 64.0::DOUBLE ELSE lam END AS fl FROM l),
v AS (SELECT vec_id, partner, fl, cut, h, w, y0, x0, unnest(e)::DOUBLE AS a, unnest(o)::DOUBLE AS b, generate_subscripts(e, 1) - 1 AS i FROM z)
SELECT vec_id, partner, cut, round(fl, 6) AS lam, round(sum(CASE WHEN NOT cut THEN a * fl + b * (1 - fl) WHEN i // 8 >= y0 AND i // 8 < y0 + h AND i % 8 >= x0 AND i % 8 < x0 + w THEN b ELSE a END), 6) AS payload_sum
FROM v GROUP BY vec_id, partner, cut, fl
""")
def pair_box(t):
    """Boxes with drawn sides, shared by the two rows of a pair."""
    rows = X.batched(embedded(t), by_number(F.col("vec_id")), 48)
    out = X.pair_mix(rows, "vec_id", "label", mode="pair", cut_prob=0.6, height=8, width=8, seed=1, epoch=4, payload="payload", box_range=(0.25, 0.875))
    total = F.aggregate("mixed_payload", F.lit(0.0), lambda acc, x: acc + x)
    return out.select("vec_id", "partner", "cut", F.round("lam", 6).alias("lam"), F.round(total, 6).alias("payload_sum"))


@query("d12_derangement_pairs", f"""
WITH {BATCHES}, o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY {h(4, 0, 'vec_id')}, vec_id) AS rk FROM b)
SELECT x.vec_id, x.batch, y.vec_id AS partner FROM o x JOIN o y ON y.batch = x.batch AND y.rk = x.rk % x.rows + 1
""")
def derangement(t):
    rows = X.batched(t.embeddings.select("vec_id"), by_number(F.col("vec_id")), 48)
    return X.derangement(rows, "vec_id", 4, 0).select("vec_id", "batch", "partner")


def seen_sql(lo: str, hi: str) -> str:
    to = lambda v: f"greatest(0.0, least(224.0::DOUBLE, z * ({v} - 224) + 112))"
    return f"greatest(0.0, {to(hi)} - {to(lo)})"


@query("d13_group_of_four", f"""
WITH e AS (SELECT vec_id % 3 AS stream, vec_id, label, {u(8, 2, "'group'", 'vec_id')} < 0.7::DOUBLE AS inn FROM embeddings),
n AS (SELECT *, (row_number() OVER (PARTITION BY stream, inn ORDER BY vec_id) - 1) // 4 AS grp FROM e),
g AS (SELECT stream, grp, count(*) AS c, min(vec_id) AS lead, list(label ORDER BY vec_id) AS ls FROM n WHERE inn GROUP BY stream, grp),
d AS (SELECT *, round((0.5 + {u(8, 2, "'cx'", 'lead')}) * 224)::DOUBLE AS xc, round((0.5 + {u(8, 2, "'cy'", 'lead')}) * 224)::DOUBLE AS yc, 0.5::DOUBLE + {u(8, 2, "'zoom'", 'lead')} AS z FROM g WHERE c = 4),
s AS (SELECT *, {seen_sql('greatest(xc - 224, 0)', 'xc')} AS l, {seen_sql('xc', 'least(xc + 224, 448)')} AS r, {seen_sql('greatest(yc - 224, 0)', 'yc')} AS t, {seen_sql('yc', 'least(yc + 224, 448)')} AS b FROM d)
SELECT stream, lead, array_to_string(ls, ',') AS labels, round(l * t / ((l + r) * (t + b)), 6) AS w0, round(r * t / ((l + r) * (t + b)), 6) AS w1, round(l * b / ((l + r) * (t + b)), 6) AS w2, round(r * b / ((l + r) * (t + b)), 6) AS w3 FROM s
UNION ALL SELECT n.stream, n.vec_id, concat_ws(',', label, label, label, label), 1, 0, 0, 0 FROM n LEFT JOIN g ON n.inn AND g.stream = n.stream AND g.grp = n.grp WHERE NOT n.inn OR g.c < 4
""")
def group_of_four(t):
    df = t.embeddings.select((F.col("vec_id") % 3).alias("stream"), "vec_id", "label")
    out = X.four_groups(df, ["stream"], "vec_id", "label", 0.7, 8, 2, epochs=10, close_epochs=3, scale=(0.5, 1.5))
    return out.select("stream", F.get("members", 0).alias("lead"), F.array_join("labels", ",").alias("labels"), *[F.round(F.get("weights", i), 6).alias(f"w{i}") for i in range(4)])


TUPLE_SQL = f"""
WITH r AS (SELECT g.range AS i, c.n, {', '.join(f"CAST(floor({u(42, 5, 'g.range', j)} * (c.n - {4 - j})) AS BIGINT) AS r{j}" for j in range(5))}
  FROM range(10000000) g, (SELECT count(*) AS n FROM embeddings) c WHERE g.range < (SELECT count(*) FROM supplier)),
p0 AS (SELECT *, r0 AS a FROM r), p1 AS (SELECT *, CASE WHEN r1 = a THEN n - 4 ELSE r1 END AS b FROM p0), p2 AS (SELECT *, CASE WHEN r2 IN (a, b) THEN n - 3 ELSE r2 END AS c FROM p1),
p3 AS (SELECT *, CASE WHEN r3 IN (a, b, c) THEN n - 2 ELSE r3 END AS d FROM p2), p4 AS (SELECT *, CASE WHEN r4 IN (a, b, c, d) THEN n - 1 ELSE r4 END AS e FROM p3),
t AS (SELECT i, unnest([a, b, c, d, e]) AS spot, unnest([0, 1, 2, 3, 4]) AS slot FROM p4),
k AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS spot FROM embeddings)
SELECT printf('k05_%05d', t.i) AS sample_id, t.slot, k.vec_id FROM t JOIN k ON k.spot = t.spot
"""


@query("d14_random_tuples", TUPLE_SQL)
def random_tuples(t):
    # One tuple per supplier: the work grows with the tables.
    return D.random_tuples(t.embeddings.select("vec_id"), "vec_id", t.supplier.count(), 5, 42)


@query("d15_shard_assign", """
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
e AS (SELECT range AS s, CAST(round_even(range * n::DOUBLE / 7, 0) AS BIGINT) AS lo, CAST(round_even((range + 1) * n::DOUBLE / 7, 0) AS BIGINT) AS hi FROM range(7), (SELECT count(*) AS n FROM orders) c)
SELECT 'round_robin' AS mode, o_orderkey, i % 7 AS shard, i // 7 AS seq FROM o
UNION ALL SELECT 'strided', o_orderkey, i % 7, i // 7 FROM o UNION ALL SELECT 'strided', o_orderkey, (i + n) % 7, (i + n) // 7 FROM o WHERE i < (7 - n % 7) % 7
UNION ALL SELECT 'contiguous', o_orderkey, e.s, i - e.lo FROM o JOIN e ON o.i >= e.lo AND o.i < e.hi
""")
def shard_assign(t):
    orders = t.orders.select("o_orderkey")
    out = None
    for mode in ("round_robin", "strided", "contiguous"):
        part = D.shard_assign(orders, "o_orderkey", 7, mode).select(F.lit(mode).alias("mode"), "o_orderkey", "shard", "seq")
        out = part if out is None else out.unionByName(part)
    return out


@query("d15_shard_assign_text", """
SELECT name, (row_number() OVER (ORDER BY name) - 1) % 7 AS shard, (row_number() OVER (ORDER BY name) - 1) // 7 AS seq
FROM (SELECT 'train/' || c_mktsegment || '/é' || c_custkey AS name FROM customer)
""")
def shard_assign_text(t):
    """Text keys with long common beginnings and letters beyond ASCII."""
    name = F.concat(F.lit("train/"), F.col("c_mktsegment"), F.lit("/é"), F.col("c_custkey").cast("string"))
    return D.shard_assign(t.customer.select(name.alias("name")), "name", 7, "round_robin").select("name", "shard", "seq")


@query("d16_repeat_sampler", f"""
WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY {h(0, 4, 'o_orderkey')}, o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders),
s AS (SELECT '3' AS repeats, o_orderkey, p * 3 + r.range AS s, n, 3.0::DOUBLE AS f FROM p, range(3) r
  UNION ALL SELECT '1.5', o_orderkey, r.range, n, 1.5::DOUBLE FROM range(1000000) r JOIN p ON p.p = CAST(floor(r.range / 1.5::DOUBLE) AS BIGINT) WHERE r.range < ceil(n * 1.5::DOUBLE)),
a AS (SELECT *, CAST(ceil(n * f / 7) * 7 AS BIGINT) AS padded, CAST(ceil(n * f) AS BIGINT) AS len FROM s),
b AS (SELECT repeats, o_orderkey, s, n FROM a UNION ALL SELECT repeats, o_orderkey, s + len, n FROM a WHERE s < padded - len)
SELECT repeats, o_orderkey, CAST(s % 7 AS INTEGER) AS rank, s // 7 AS seq FROM b WHERE s // 7 < CAST(floor(n // 256 * 256 / 7.0::DOUBLE) AS BIGINT)
""")
def repeat_sampler(t):
    whole = D.repeat_sampler(t.orders, "o_orderkey", 3, 7, 4).select(F.lit("3").alias("repeats"), "*")
    return whole.unionByName(D.repeat_sampler(t.orders, "o_orderkey", 1.5, 7, 4).select(F.lit("1.5").alias("repeats"), "*"))


@query("d17_token_batches", f"""
WITH tot AS (SELECT count(*) AS n FROM documents),
d AS (SELECT range AS batch, CASE CAST(floor({u(6, "'length'", 'range')} * 3) AS INTEGER) WHEN 0 THEN 128 WHEN 1 THEN 256 ELSE 576 END AS seq_len FROM range(200000)),
z AS (SELECT *, CASE seq_len WHEN 128 THEN 28 WHEN 256 THEN 12 ELSE 4 END AS size FROM d),
c AS (SELECT *, sum(size) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM z),
k AS (SELECT batch, seq_len, CAST(least(size, n - (e - size)) AS BIGINT) AS rows FROM c, tot WHERE e - size < n),
s AS (SELECT *, CAST(sum(rows) OVER (ORDER BY {h(6, 1, "'batch'", 'batch')}, batch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS e FROM k),
g AS (SELECT doc_id, row_number() OVER (ORDER BY {h(6, 1, 'doc_id')}, doc_id) - 1 AS g FROM documents)
SELECT g.doc_id, s.batch, CAST(s.seq_len AS INTEGER) AS seq_len, s.rows AS batch_rows, g.g - (s.e - s.rows) AS place FROM g JOIN s ON g.g >= s.e - s.rows AND g.g < s.e
""")
def token_batches(t):
    return D.token_batches(t.documents.select("doc_id"), "doc_id", [128, 256, 576], 3600, 4, 6, 1)


@query("d18_balanced_split", f"""
SELECT p_partkey, coalesce(brand, 'unbranded') AS brand, CAST(i % 5 AS INTEGER) AS part, i // 5 AS seq FROM (
  SELECT p_partkey, CASE WHEN p_size % 9 <> 0 THEN p_brand END AS brand, row_number() OVER (ORDER BY {h(11, 0, 'p_partkey')}, p_partkey) - 1 AS i FROM part) q
""")
def balanced_split(t):
    parts = t.part.select("p_partkey", F.when(F.col("p_size") % 9 != 0, F.col("p_brand")).alias("brand"))
    return D.balanced_split(parts, "p_partkey", 5, 11, {"brand": "unbranded"})


@query("d19_resample_shards", f"""
WITH s AS (SELECT l_suppkey, count(*) AS rows FROM lineitem GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY l_suppkey) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT r.range AS draw, i.l_suppkey, i.rows FROM range(1000000) r, (SELECT count(*) AS n FROM s) c JOIN i ON i.i = CAST(floor({u(2, 5, 1, 'r.range')} * c.n) AS BIGINT) WHERE r.range < 2 * c.n
""")
def resample_shards(t):
    shards = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("rows"))
    return D.resample_shards(shards, "l_suppkey", 2 * shards.count(), 2, 5, worker=1)


@query("d20_pad_batches", """
WITH r AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS g, count(*) OVER () AS n FROM embeddings),
a AS (SELECT vec_id, label, 1.0::DOUBLE AS weight, g AS spot, false AS padding FROM r
  UNION ALL SELECT r.vec_id, 0, 0, p.range + (n - n % 130), true FROM r, range(130) p WHERE r.n % 130 > 0 AND p.range >= n % 130 AND r.g = n - n % 130 + p.range % (n % 130))
SELECT spot // 130 AS batch, CAST(spot % 130 AS INTEGER) AS pos, vec_id, label, weight, padding FROM a
""")
def pad_batches(t):
    rows = t.embeddings.select("vec_id", F.array(F.struct("label", F.lit(1.0).alias("weight"))).alias("target"))
    out = X.pad_batches(rows, "vec_id", 130, "target")
    return out.select("batch", "pos", "vec_id", F.get("target", 0)["label"].alias("label"), F.get("target", 0)["weight"].alias("weight"), "padding")
