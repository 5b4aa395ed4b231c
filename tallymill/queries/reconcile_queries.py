"""Queries that match, validate and compare tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.functions.names import general
from tallymill.operators import reconcile as J
from tallymill.operators.sampling import stratified_cap
from tallymill.queries.dataset_queries import h
from tallymill.queries.registry import query


def r6(*columns):
    return [F.round(c, 6).alias(c) for c in columns]


@query("j1_match_report", """
WITH l AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0), r AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2)
SELECT l.o_custkey, l.o_orderstatus, coalesce(n, 0) AS hits, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status
FROM l LEFT JOIN r ON r.o_custkey = l.o_custkey AND r.o_orderstatus = l.o_orderstatus
""")
def match_report(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    return J.match_report(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), ["o_custkey", "o_orderstatus"])


@query("j1_strict_match", """
WITH r AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1), m AS (SELECT o_custkey FROM r WHERE n = 1)
SELECT 'run' AS source, o_orderkey, o_custkey, o_totalprice AS price, NULL::DOUBLE AS ref_price FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey IN (SELECT o_custkey FROM m)
UNION ALL SELECT 'reference', o_orderkey, o_custkey, NULL, o_totalprice FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey IN (SELECT o_custkey FROM m) AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)
""")
def strict_match(t):
    left = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    ref = t.orders.where("o_orderkey % 2 = 1").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("ref_price"))
    return J.strict_match(left, ref, ["o_custkey"], strict=False)


@query("j2_resolve_manifest", """
WITH s AS (SELECT page_id, concat('p', page_id % 200, '.html') AS base, split_part(url, '/', 4) AS label FROM pages),
m AS (SELECT concat('p', page_id % 230, '.html') AS base, CASE WHEN page_id % 6 = 0 THEN 'xx' ELSE split_part(url, '/', 4) END AS label FROM pages WHERE page_id % 3 = 0),
mb AS (SELECT base, count(*) AS listed, min(label) AS wanted_label FROM m GROUP BY base), sb AS (SELECT base, count(*) AS copies, min(label) AS label FROM s GROUP BY base)
SELECT mb.base, mb.listed, CASE WHEN listed > 1 THEN 'duplicate_selection' WHEN copies IS NULL THEN 'missing' WHEN copies > 1 THEN 'duplicate_source' WHEN label <> wanted_label THEN 'label_mismatch' ELSE 'ok' END AS status
FROM mb LEFT JOIN sb ON sb.base = mb.base
""")
def resolve_manifest(t):
    label = F.split("url", "/")[3]
    name = lambda n: F.concat(F.lit("x/p"), (F.col("page_id") % n).cast("string"), F.lit(".html"))
    source = t.pages.select(name(200).alias("path"), label.alias("label"))
    manifest = t.pages.where("page_id % 3 = 0").select(name(230).alias("path"), F.when(F.col("page_id") % 6 == 0, "xx").otherwise(label).alias("label"))
    return J.manifest_report(source, manifest).select("base", "listed", "status")


@query("j2_class_count_fallback", f"""
WITH w AS (SELECT lang, count(*) AS rows FROM documents WHERE doc_id % 4 = 0 GROUP BY lang),
p AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {h(42, 0, 'doc_id')}, doc_id) AS rk FROM documents)
SELECT 'class-counts' AS strategy, p.lang AS label, p.doc_id FROM p JOIN w ON w.lang = p.lang AND p.rk <= w.rows
""")
def class_count_fallback(t):
    source = t.documents.select("doc_id", F.concat(F.lit("unnamed/"), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("label"))
    manifest = t.documents.where("doc_id % 4 = 0").select(F.concat(F.lit("a/img_"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"), F.col("lang").alias("label"))
    chosen, strategy = J.resolve_manifest(source, manifest, "doc_id")
    return chosen.select(F.lit(strategy).alias("strategy"), "label", "doc_id")


@query("j3_first_existing", """
WITH c AS (SELECT o_orderkey, o_custkey, unnest([0, 1, 2]) AS pos FROM orders),
f AS (SELECT c.o_orderkey, min(c.pos) AS pos FROM c JOIN customer k ON k.c_custkey = c.o_custkey + c.pos * 17 AND k.c_acctbal > 5000 GROUP BY c.o_orderkey)
SELECT o.o_orderkey, CASE WHEN f.pos IS NOT NULL THEN concat('ck/', o.o_custkey + f.pos * 17) END AS found,
  CASE WHEN f.pos IS NULL THEN concat('ck/', o.o_custkey, '; ck/', o.o_custkey + 17, '; ck/', o.o_custkey + 34) END AS tried
FROM orders o LEFT JOIN f ON f.o_orderkey = o.o_orderkey
""")
def first_existing(t):
    path = lambda c: F.concat(F.lit("ck/"), c.cast("string"))
    rows = t.orders.select("o_orderkey", F.array(*[path(F.col("o_custkey") + 17 * i) for i in range(3)]).alias("candidates"))
    inventory = t.customer.where("c_acctbal > 5000").select(path(F.col("c_custkey")).alias("path"))
    return J.first_existing(rows, ["o_orderkey"], "candidates", inventory).select("o_orderkey", "found", "tried")


@query("j4_nearest_checkpoint", """
WITH r AS (SELECT o_orderkey AS run, (50000 + 1000 * (o_custkey % 3)) / (64.0::DOUBLE * greatest(1, o_custkey % 4)) AS per, 20 * (o_orderkey % 4000) AS num_steps, 500 * (o_custkey % 5) AS warm FROM orders),
d AS (SELECT *, (num_steps + warm) / per AS a, num_steps / per AS b FROM r WHERE num_steps > 0),
e AS (SELECT *, CASE WHEN abs(a - 120) <= abs(b - 120) THEN a ELSE b END AS detected, abs(a - 120) <= abs(b - 120) AS w, per * 110 AS target FROM d),
c AS (SELECT l_orderkey AS run, l_partkey * 25 AS step FROM lineitem),
k AS (SELECT e.run, e.w, e.detected, c.step, row_number() OVER (PARTITION BY e.run ORDER BY abs(c.step - e.target), c.step) AS rk, e.per FROM e JOIN c ON c.run = e.run WHERE abs(detected - 120) <= 15)
SELECT run, w AS with_warmup, round(detected, 6) AS detected_epochs, step, round(step / per, 6) AS epoch FROM k WHERE rk = 1
""")
def nearest_checkpoint(t):
    runs = t.orders.select(
        F.col("o_orderkey").alias("run"), (50000 + 1000 * (F.col("o_custkey") % 3)).alias("train_size"), F.lit(64).alias("batch_size"), (F.col("o_custkey") % 4).alias("world_size"),
        (20 * (F.col("o_orderkey") % 4000)).alias("num_steps"), (500 * (F.col("o_custkey") % 5)).alias("warmup_steps"))
    checkpoints = t.lineitem.select(F.col("l_orderkey").alias("run"), (F.col("l_partkey") * 25).alias("step"))
    out = J.nearest_checkpoint(runs, checkpoints, "run", 110, 120, 15)
    return out.select("run", "with_warmup", "step", *r6("detected_epochs", "epoch"))


@query("j5_inventory_diff", """
WITH f AS (SELECT page_id, concat(page_id, '/', regexp_replace(url, '[?#].*$', '')) AS path, length(html) AS size FROM pages),
s AS (SELECT * FROM f WHERE page_id % 7 <> 1), d AS (SELECT path, size + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS size FROM f WHERE page_id % 11 <> 2)
SELECT coalesce(s.path, d.path) AS path, CAST(s.size AS INTEGER) AS source_size, CAST(d.size AS INTEGER) AS target_size,
  CASE WHEN d.path IS NULL THEN 'MISSING' WHEN s.path IS NULL THEN 'EXTRA' ELSE 'SIZE MISMATCH' END AS problem
FROM s FULL OUTER JOIN d ON s.path = d.path WHERE s.path IS NULL OR d.path IS NULL OR s.size <> d.size
""")
def inventory_diff(t):
    files = t.files.withColumn("path", F.concat_ws("/", F.col("page_id").cast("string"), "path"))
    source = files.where("page_id % 7 <> 1")
    target = files.where("page_id % 11 <> 2").withColumn("size", F.col("size") + F.when(F.col("page_id") % 5 == 0, 1).otherwise(0))
    return J.inventory_diff(source, target)


@query("j6_spot_verify", """
WITH f AS (SELECT page_id, concat('f', page_id) AS path, html FROM pages),
c AS (SELECT path FROM (SELECT path FROM f ORDER BY path LIMIT 5) a UNION SELECT path FROM (SELECT path FROM f ORDER BY path DESC LIMIT 5) b UNION SELECT path FROM (SELECT path FROM f ORDER BY md5(concat_ws('|', 13, path)) LIMIT 5) r)
SELECT path, CASE WHEN page_id % 4 = 1 THEN 'missing' WHEN page_id % 4 = 2 THEN 'differs' ELSE 'same' END AS status FROM f WHERE path IN (SELECT path FROM c)
""")
def spot_verify(t):
    path = F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("path")
    source = t.pages.select(path, F.col("html").alias("content"))
    target = t.pages.where("page_id % 4 <> 1").select(path, F.when(F.col("page_id") % 4 == 2, F.concat("html", F.lit("!"))).otherwise(F.col("html")).alias("content"))
    return J.spot_verify(source, target, 5, 13)


@query("j7_validate_selection", """
WITH sel AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 500 = 3 UNION ALL SELECT o_orderkey + 100000000 FROM orders WHERE o_orderkey % 1000 = 7),
k AS (SELECT o_orderkey, count(*) AS n FROM sel GROUP BY 1), want AS (SELECT o_orderstatus, count(*) AS want FROM orders WHERE o_orderkey % 10 = 3 GROUP BY 1),
have AS (SELECT o.o_orderstatus, count(*) AS have FROM sel JOIN orders o ON o.o_orderkey = sel.o_orderkey GROUP BY 1)
SELECT CAST((SELECT sum(n) FROM k) AS BIGINT) AS rows, (SELECT count(*) FROM k WHERE n > 1) AS duplicates, (SELECT count(*) FROM k WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS unknown,
  (SELECT count(*) FROM want FULL OUTER JOIN have ON want.o_orderstatus = have.o_orderstatus WHERE coalesce(want, 0) <> coalesce(have, 0)) AS wrong_classes,
  CAST((SELECT sum(want) FROM want) AS BIGINT) AS expected_rows, (SELECT bit_xor(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT) FROM sel) AS digest,
  (SELECT CAST(sum(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT) AS VARCHAR) FROM sel) AS total, 'invalid' AS status
""")
def validate_selection(t):
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    chosen = orders.where("o_orderkey % 10 = 3")
    selection = chosen.select("o_orderkey").union(orders.where("o_orderkey % 500 = 3").select("o_orderkey")).union(
        orders.where("o_orderkey % 1000 = 7").select(F.col("o_orderkey") + 100000000))
    expected = chosen.groupBy(F.col("o_orderstatus").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    meta = {"seed": 42, "dataset": "orders"}
    return J.validate_selection(selection, orders, expected, "o_orderkey", "o_orderstatus", meta, meta)


def leaf_sql(name: str, table: str) -> str:
    """Check SQL for the leaves of a table (lang, doc_id, n_chars, source)."""
    return f"""{name}_m AS (SELECT lang, doc_id, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), coalesce(CAST(n_chars AS VARCHAR), chr(0)), coalesce(source, chr(0)))) AS mark,
  sum(CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % 20 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY doc_id) AS leaf FROM {table}),
{name} AS (SELECT lang, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n, sha256(string_agg(mark, '' ORDER BY doc_id)) AS digest FROM {name}_m GROUP BY lang, leaf)"""


@query("j7_ordered_digests", f"""
WITH {leaf_sql('a', 'documents')}, i AS (SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY first) - 1) // 1000 AS node FROM a),
u AS (SELECT lang, node, sum(n) AS n, sha256(string_agg(digest, '' ORDER BY first)) AS digest FROM i GROUP BY lang, node)
SELECT lang AS label, CAST(sum(n) AS BIGINT) AS n, CASE WHEN count(*) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY node)) END AS digest FROM u GROUP BY lang
""")
def ordered_digests(t):
    return J.ordered_digests(J.digest_leaves(t.documents, "lang", "doc_id", ["n_chars", "source"], 20))


@query("j7_differing_ranges", f"""
WITH copy AS (SELECT lang, doc_id, n_chars + CASE WHEN doc_id % 97 = 0 THEN 1 ELSE 0 END AS n_chars, source FROM documents WHERE doc_id % 101 <> 5),
{leaf_sql('a', 'documents')}, {leaf_sql('b', 'copy')}
SELECT coalesce(a.lang, b.lang) AS label, coalesce(a.first, b.first) AS first, greatest(coalesce(a.last, b.last), coalesce(b.last, a.last)) AS last, coalesce(a.n, 0) AS left_rows, coalesce(b.n, 0) AS right_rows
FROM a FULL OUTER JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.first = b.first WHERE a.digest IS DISTINCT FROM b.digest
""")
def differing_ranges(t):
    """All documents against a copy with changed and missing rows."""
    copy = t.documents.where("doc_id % 101 <> 5").withColumn("n_chars", F.col("n_chars") + (F.col("doc_id") % 97 == 0).cast("int"))
    leaves = [J.digest_leaves(df, "lang", "doc_id", ["n_chars", "source"], 20) for df in (t.documents, copy)]
    return J.differing_ranges(*leaves)


@query("j7_selection_status", """
WITH d AS (SELECT count(*) AS rows, bit_xor(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT) AS digest, CAST(sum(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT) AS VARCHAR) AS total FROM orders)
SELECT 'as stored' AS kind, 'valid' AS status, rows, digest, total FROM d UNION ALL SELECT 'other seed', 'stale', rows, digest, total FROM d
UNION ALL SELECT 'other digest', 'invalid', rows, digest, total FROM d UNION ALL SELECT 'other total', 'invalid', rows, digest, total FROM d
""")
def selection_status(t):
    """A stored selection of all orders against its own fingerprint, another seed and two other fingerprints."""
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    expected = orders.groupBy(F.col("o_orderstatus").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    mark = J.fingerprint(orders, "o_orderkey").first()
    stored = {"seed": 42}
    cases = [("as stored", stored, mark["digest"], mark["total"]), ("other seed", {"seed": 43}, mark["digest"], mark["total"]),
             ("other digest", stored, mark["digest"] + 1, mark["total"]), ("other total", stored, mark["digest"], "0")]
    out = None
    for kind, current, digest, total in cases:
        report = J.validate_selection(
            orders.select("o_orderkey"), orders, expected, "o_orderkey", "o_orderstatus", stored, current, digest, total)
        part = report.select(F.lit(kind).alias("kind"), "status", "rows", "digest", "total")
        out = part if out is None else out.unionByName(part)
    return out


@query("j8_harmonised_union", """
WITH a AS (SELECT model, CASE WHEN contains(recipe, 'bare_') THEN 'bare' WHEN contains(recipe, 'baseline') THEN 'baseline' ELSE 'other' END AS type, count(DISTINCT seed) AS n_seeds, avg(top1_acc) AS tm, stddev_samp(top1_acc) AS ts, avg(brier) AS em, stddev_samp(brier) AS es FROM runs GROUP BY 1, 2)
SELECT 'baseline' AS kind, CASE type WHEN 'bare' THEN 'single image' ELSE 'baseline' END AS label, NULL AS loss, NULL::DOUBLE AS alpha, NULL::INTEGER AS k, n_seeds, round(tm, 6) AS eval_top1_mean, round(ts, 6) AS eval_top1_std, round(em * 100, 6) AS eval_ece_mean, round(es * 100, 6) AS eval_ece_std
FROM a WHERE model = 'vit-wee' AND type IN ('bare', 'baseline')
UNION ALL SELECT 'groupmix', 'soft_ce', 'soft_ce', 0.1, CAST(4 + seed % 2 AS INTEGER), 1, round(top1_acc, 6), NULL, round(nll, 6), NULL FROM runs WHERE contains(recipe, 'soft-ce')
""", uses=("runs",))
def harmonised_union(t):
    kind = F.when(F.col("recipe").contains("bare_"), "bare").when(F.col("recipe").contains("baseline"), "baseline").otherwise("other")
    base = t.runs.groupBy("model", kind.alias("type")).agg(
        F.count_distinct("seed").alias("n_seeds"), F.avg("top1_acc").alias("top1_mean"), F.stddev_samp("top1_acc").alias("top1_std"), F.avg("brier").alias("ece_mean"), F.stddev_samp("brier").alias("ece_std"))
    sweep = t.runs.where(F.col("recipe").contains("soft-ce")).select(
        F.lit("soft_ce").alias("loss"), F.lit(0.1).alias("alpha"), (4 + F.col("seed") % 2).alias("k"), F.col("top1_acc").alias("eval_top1"), F.col("nll").alias("eval_ece"))
    out = J.harmonised_union(base, sweep, {"bare": "single image", "baseline": "baseline"}, "vit-wee")
    return out.select("kind", "label", "loss", "alpha", "k", "n_seeds", *r6("eval_top1_mean", "eval_top1_std", "eval_ece_mean", "eval_ece_std"))


@query("j9_experiment_grid", """
SELECT concat(b.p_brand, '__', r.r_name, '__lr=', l.txt, '__m', m.m, '__seed=', s.seed) AS name FROM (SELECT DISTINCT p_brand FROM part) b, region r, (VALUES ('0.001'), ('0.0005')) l(txt), (VALUES (5), (9)) m(m), (VALUES (42), (43)) s(seed)
""")
def experiment_grid(t):
    grid = J.experiment_grid(t.part.select("p_brand").distinct(), {"region": t.region.select("r_name"), "lr": [0.001, 0.0005], "magnitude": [5, 9], "seed": [42, 43]})
    return grid.select(F.concat_ws(
        "__", "p_brand", "region", F.concat(F.lit("lr="), general(F.col("lr"))), F.concat(F.lit("m"), F.col("magnitude").cast("string")), F.concat(F.lit("seed="), F.col("seed").cast("string"))).alias("name"))


@query("j9_expand_configs", """
SELECT DISTINCT p_name AS name, CAST(size AS INTEGER) AS size, crop FROM (
  SELECT p_name, 32 * (1 + p_size % 4) AS size, 0.9::DOUBLE AS crop FROM part UNION ALL SELECT p_name, CASE WHEN p_size % 2 = 0 THEN 320 ELSE 32 * (1 + p_size % 4) END, CASE WHEN p_size % 3 = 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END FROM part) q
""")
def expand_configs(t):
    size = F.col("p_size")
    configs = t.part.select(
        F.col("p_name").alias("name"), (32 * (1 + size % 4)).alias("size"), F.lit(0.9).alias("crop"), F.when(size % 2 == 0, 320).alias("test_size"), F.when(size % 3 == 0, 1.0).alias("test_crop"))
    return J.expand_configs(configs, ["name"])


@query("j10_verify_split", """
SELECT coalesce(d.lang, m.lang) AS label, coalesce(d.found, 0) AS found, coalesce(m.rows, 0) AS expected, coalesce(d.empty, 0) AS empty, coalesce(d.found, 0) = coalesce(m.rows, 0) AND coalesce(d.empty, 0) = 0 AS ok
FROM (SELECT lang, count(*) AS found, count(*) FILTER (WHERE doc_id % 97 = 5) AS empty FROM documents GROUP BY lang) d
FULL OUTER JOIN (SELECT lang, count(*) - CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS rows FROM documents WHERE lang <> 'es' GROUP BY lang UNION ALL SELECT 'it', 4) m ON m.lang = d.lang
""")
def verify_split(t):
    data = t.documents.select("lang", F.when(F.col("doc_id") % 97 != 5, F.col("text")).otherwise("").alias("text"))
    counts = t.documents.where("lang <> 'es'").groupBy(F.col("lang").alias("label")).agg((F.count(F.lit(1)) - F.when(F.col("lang") == "fr", 1).otherwise(0)).alias("rows"))
    extra = t.region.where("r_regionkey = 0").select(F.lit("it").alias("label"), F.lit(4).alias("rows"))
    return J.verify_split(data, "lang", F.col("text"), counts.unionByName(extra))


@query("j11_resolve_run_id", """
WITH e AS (SELECT o_orderkey AS ord, 'c' || o_custkey AS name, CASE WHEN o_orderkey % 3 = 0 THEN '/out/' || (o_custkey + o_orderkey % 2) ELSE '' END AS output,
   CASE WHEN o_orderkey % 4 <> 0 THEN 'id' || o_orderkey WHEN o_orderkey % 8 = 0 THEN 'log' || o_orderkey END AS id,
   CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS stamp FROM orders),
u AS (SELECT * FROM e WHERE id IS NOT NULL), o AS (SELECT output, arg_min(id, ord) AS id FROM u WHERE output <> '' GROUP BY output),
n AS (SELECT name, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY stamp DESC, ord DESC) AS rk FROM u) q WHERE rk = 1)
SELECT c.c_custkey, coalesce(o.id, n.id) AS run_id FROM customer c LEFT JOIN o ON o.output = '/out/' || c.c_custkey LEFT JOIN n ON n.name = 'c' || c.c_custkey
""")
def resolve_run_id(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    day = lambda d: F.date_format(F.date_sub(F.col("o_orderdate").cast("date"), d), "yyyy-MM-dd")
    status = t.orders.select(
        key.alias("ord"), F.concat(F.lit("c"), cust.cast("string")).alias("name"), F.when(key % 3 == 0, F.concat(F.lit("/out/"), (cust + key % 2).cast("string"), F.lit("/"))).otherwise("").alias("output"),
        F.when(key % 4 != 0, F.concat(F.lit("id"), key.cast("string"))).otherwise(" ").alias("run_id"), F.when(key % 8 == 0, F.concat(F.lit("log"), key.cast("string"))).alias("log_id"),
        F.when(key % 5 != 0, day(0)).otherwise("").alias("updated_at"), day(1).alias("created_at"))
    runs = t.customer.select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.concat(F.lit("/out/"), F.col("c_custkey").cast("string")).alias("output"))
    return J.resolve_run_id(runs, status).select("c_custkey", "run_id")


@query("j12_common_across", """
WITH e AS (SELECT DISTINCT 's' || l_suppkey % 3 AS model, l_partkey AS sample, l_linenumber AS class FROM lineitem),
c AS (SELECT sample, class FROM e WHERE model = 's0' INTERSECT SELECT sample, class FROM e WHERE model = 's1' INTERSECT SELECT sample, class FROM e WHERE model = 's2')
SELECT 'common' AS what, sample, CAST(class AS BIGINT) AS value FROM c
UNION ALL SELECT concat('dropped ', model), -1, count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.sample = e.sample AND c.class = e.class) GROUP BY model
""")
def common_across(t):
    entries = t.lineitem.select(F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("model"), F.col("l_partkey").alias("sample"), F.col("l_linenumber").alias("class"))
    common = J.common_across(entries, "model", "sample", "class", 3)
    dropped = J.dropped_entries(entries, "model", "sample", "class", 3)
    first = common.select(F.lit("common").alias("what"), "sample", F.col("class").cast("bigint").alias("value"))
    return first.unionByName(dropped.select(F.concat(F.lit("dropped "), "model").alias("what"), F.lit(-1).cast("bigint").alias("sample"), F.col("dropped").alias("value")))


@query("j12_common_capped", f"""
WITH e AS (SELECT DISTINCT l_suppkey % 2 AS model, l_partkey AS sample, l_linenumber AS class FROM lineitem),
c AS (SELECT sample, class FROM e WHERE model = 0 INTERSECT SELECT sample, class FROM e WHERE model = 1)
SELECT class, sample FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {h(3, 0, 'sample')}, sample) AS rk FROM c) q WHERE rk <= 10
""")
def common_capped(t):
    entries = t.lineitem.select((F.col("l_suppkey") % 2).alias("model"), F.col("l_partkey").alias("sample"), F.col("l_linenumber").alias("class"))
    return stratified_cap(J.common_across(entries, "model", "sample", "class", 2), "class", "sample", 10, 3).select("class", "sample")
