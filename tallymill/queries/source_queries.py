"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.queries.registry import query
from tallymill.session import scratch_path
from tallymill.sources import paths, results, shards, versions


@query("s1_union_by_name", """
SELECT n_nationkey, n_name, n_regionkey, NULL AS r_regionkey, NULL AS r_name FROM nation
UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region
""")
def union_tables(t):
    return results.union_by_name([t.nation, t.region])


@query("s1_load_results", """
SELECT coalesce(o_orderstatus, 'x') AS status, count(*) AS n, count(metric_a) AS with_a, count(metric_b) AS with_b, round(sum(metric_a), 2) AS sum_a FROM (
 SELECT o_orderstatus, o_totalprice AS metric_a, NULL::DOUBLE AS metric_b FROM orders WHERE o_orderkey % 2 = 0
 UNION ALL SELECT o_orderstatus, CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice END, 1.5::DOUBLE FROM orders WHERE o_orderkey % 2 = 1) q GROUP BY 1
""")
def load_results(t):
    folder = scratch_path(t.spark, "results")
    even = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("metric_a"))
    odd = t.orders.where("o_orderkey % 2 = 1").select(
        "o_orderkey", F.lit(1.5).alias("metric_b"), "o_orderstatus", F.when(F.col("o_custkey") % 3 != 0, F.col("o_totalprice")).alias("metric_a"))
    even.write.option("header", True).csv(f"{folder}/a")
    odd.write.option("header", True).csv(f"{folder}/b")
    loaded = results.load_results(t.spark, [f"{folder}/a/*.csv", f"{folder}/b/*.csv"])
    number = lambda c: F.col(c).try_cast("double")
    return loaded.groupBy(F.coalesce("o_orderstatus", F.lit("x")).alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.count("metric_a").alias("with_a"), F.count("metric_b").alias("with_b"), F.round(F.sum(number("metric_a")), 2).alias("sum_a"))


@query("s2_path_label_index", """
WITH f AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS raw FROM pages),
g AS (SELECT page_id, CASE WHEN regexp_matches(raw, '\\.html$') THEN raw ELSE concat(rtrim(raw, '/'), CASE WHEN page_id % 3 = 0 THEN '.JPG' WHEN page_id % 3 = 1 THEN '.png' ELSE '.gif' END) END AS path FROM f)
SELECT page_id, split_part(path, '/', -2) AS label, replace(regexp_replace(path, '/[^/]*$', ''), '/', '_') AS full_label
FROM g WHERE regexp_matches(path, '\\.(JPG|png)$')
""")
def path_label_index(t):
    ending = F.lit([".JPG", ".png", ".gif"])[F.col("page_id") % 3]
    raw = F.col("path")
    files = t.files.select("page_id", F.when(raw.rlike(r"\.html$"), raw).otherwise(F.concat(F.regexp_replace(raw, "/+$", ""), ending)).alias("path"))
    out = paths.path_label_index(files)
    return out.select("page_id", "label", paths.label_from_path(F.col("path"), leaf_only=False).alias("full_label"))


@query("s3_class_map", """
SELECT d.source AS label, m.idx, count(*) AS n FROM documents d JOIN (
  SELECT source, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(source, '[0-9]+') AS INTEGER)) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT source FROM documents) s) m
ON m.source = d.source GROUP BY d.source, m.idx
""")
def class_map(t):
    mapping = paths.class_map(t.documents, "source")
    counted = t.documents.groupBy(F.col("source").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return paths.apply_class_map(counted, mapping, "label")


@query("s3_supplied_class_map", """
SELECT lang, 'kept' AS outcome, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang
UNION ALL SELECT lang, 'dropped', count(*) FROM documents WHERE lang NOT IN ('en', 'fr') GROUP BY lang
""")
def supplied_class_map(t):
    mapping = paths.class_map(t.documents.where(F.col("lang").isin("en", "fr")), "lang")
    kept = paths.apply_class_map(t.documents.select("lang"), mapping, "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    dropped = paths.dropped_count(t.documents.select("lang"), mapping, "lang").withColumnRenamed("dropped", "n")
    return kept.select("lang", F.lit("kept").alias("outcome"), "n").unionByName(dropped.select("lang", F.lit("dropped").alias("outcome"), "n"))


UPSERT_SQL = """
SELECT 'o' || o_orderkey AS name, o_totalprice AS metric_a, NULL::DOUBLE AS metric_b, NULL AS run_dir, NULL AS error FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 10 <> 4
UNION ALL SELECT 'o' || o_orderkey, NULL, o_totalprice * 2, NULL, NULL FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'o' || o_orderkey, NULL, NULL, '/runs/' || o_custkey, 'lost' FROM orders WHERE o_orderkey % 10 = 4 AND o_orderkey % 3 <> 0
"""


def upserted(t, existing=None):
    name = F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name")
    before = t.orders.select(name, F.col("o_totalprice").alias("metric_a"), F.lit(None).cast("string").alias("error"))
    new = t.orders.where("o_orderkey % 3 = 0").select(name, (F.col("o_totalprice") * 2).alias("metric_b"))
    errors = t.orders.where("o_orderkey % 10 = 4 AND o_orderkey % 3 <> 0").select(name, F.lit("lost").alias("error"))
    mapping = t.orders.select(name, F.concat(F.lit("/runs/"), F.col("o_custkey").cast("string")).alias("run_dir"))
    out = results.upsert_results(before if existing is None else existing(before), new, errors, mapping)
    return out.select("name", "metric_a", "metric_b", "run_dir", "error")


@query("s4_upsert_results", UPSERT_SQL)
def upsert_results(t):
    return upserted(t)


@query("s4_commit_table", UPSERT_SQL)
def commit_table(t):
    """The table before is committed, read, and replaced by what is made from it."""
    root = scratch_path(t.spark, "table")

    def stored(before):
        versions.commit_table(before, root)
        return versions.read_table(t.spark, root)

    versions.commit_table(upserted(t, stored), root)
    return versions.read_table(t.spark, root)


@query("s5_pending", """
SELECT 'c' || c_custkey AS name, c_nationkey FROM customer WHERE c_custkey NOT IN (5, 6)
  AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 31 <> 1)
  AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 31 = 1)
""")
def pending(t):
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("name")
    mapping = t.customer.select(name("c_custkey"), "c_nationkey")
    first = t.orders.where("o_orderkey % 31 <> 1").select(name("o_custkey"), F.when(F.col("o_orderstatus") == "P", " ").otherwise("failed").alias("error"))
    second = t.orders.where("o_orderkey % 31 = 1").select(name("o_custkey"))
    return results.pending(mapping, [first, second], skip_names=["c5", "c6"])


@query("s6_write_predictions", """
SELECT vec_id, label, round(logits[1], 6) AS logits_0, round(logits[2], 6) AS logits_1, round(logits[3], 6) AS logits_2 FROM preds
""", uses=("preds",))
def write_predictions(t):
    path = scratch_path(t.spark, "predictions")
    slim = t.preds.select("vec_id", "label", F.slice("logits", 1, 3).alias("logits"))
    results.write_predictions(slim, path, "parquet", {"logits": 3})
    back = t.spark.read.parquet(path)
    return back.select("vec_id", "label", *[F.round(f"logits_{i}", 6).alias(f"logits_{i}") for i in range(3)])


SPLIT_SQL = """
SELECT CASE WHEN sample_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, class_name, count(*) AS n, CAST(sum(size + CASE WHEN sample_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS size
FROM samples GROUP BY 1, 2
"""


@query("s7_commit_splits", SPLIT_SQL, uses=("samples",))
def commit_splits(t):
    """Both splits in one commit, then one of them replaced by another."""
    root = scratch_path(t.spark, "committed")
    versions.commit_splits(t.samples, root, F.when(F.col("sample_id") % 5 == 0, "val").otherwise("train"))
    versions.commit_splits(t.samples.where("sample_id % 5 = 0").withColumn("size", F.col("size") + 1), root, F.lit("val"), force=True)
    return versions.read_splits(t.spark, root).groupBy("split", "class_name").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("s7_write_split", SPLIT_SQL, uses=("samples",))
def write_split(t):
    root = scratch_path(t.spark, "splits")
    split = F.when(F.col("sample_id") % 5 == 0, "val").otherwise("train")
    results.write_split(t.samples, root, split)
    # The second write replaces only the split it carries.
    results.write_split(t.samples.where("sample_id % 5 = 0").withColumn("size", F.col("size") + 1), root, F.lit("val"), force=True)
    back = t.spark.read.parquet(root)
    return back.groupBy("split", "class_name").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("s8_shard_completeness", """
WITH f AS (SELECT p_size AS grp, 8 + p_size % 3 AS total, p_partkey % 11 AS shard FROM part),
ix AS (SELECT grp, total, shard, count(*) AS copies FROM f GROUP BY ALL)
SELECT concat('d', grp) AS dir, total::INTEGER AS total, CAST(sum(copies) AS BIGINT) AS files, total - count(*) FILTER (WHERE shard < total) AS missing,
  count(*) FILTER (WHERE copies > 1) AS duplicates, count(*) FILTER (WHERE shard >= total) AS out_of_range,
  total = count(*) FILTER (WHERE shard < total) AND count(*) FILTER (WHERE copies > 1 OR shard >= total) = 0 AS complete
FROM ix GROUP BY grp, total
""")
def shard_completeness(t):
    path = F.format_string("d%d/set-train-%05d-of-%05d.arrow", F.col("p_size"), F.col("p_partkey") % 11, 8 + F.col("p_size") % 3)
    return shards.shard_completeness(t.part.select(path.alias("path"))).drop("prefix")


@query("s8_missing_shards", """
WITH f AS (SELECT DISTINCT p_size AS grp, 8 + p_size % 3 AS total, p_partkey * p_partkey % 11 AS shard FROM part)
SELECT concat('d', g.grp) AS dir, CAST(r.range AS INTEGER) AS shard FROM (SELECT DISTINCT grp, total FROM f) g JOIN range(20) r ON r.range < g.total
WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.grp = g.grp AND f.shard = r.range)
""")
def missing_shards(t):
    path = F.format_string("d%d/set-train-%05d-of-%05d.arrow", F.col("p_size"), F.col("p_partkey") * F.col("p_partkey") % 11, 8 + F.col("p_size") % 3)
    return shards.missing_shards(t.part.select(path.alias("path"))).select("dir", "shard")


@query("s9_select_split", """
SELECT 'range' AS spec, count(*) AS shards, CAST(sum(n) AS BIGINT) AS num_samples FROM (SELECT l_suppkey AS shard, count(*) AS n FROM lineitem GROUP BY 1) s WHERE shard % 2 = 0 AND shard BETWEEN 10 AND 40
UNION ALL SELECT 'counted', count(*), 500 FROM (SELECT DISTINCT l_suppkey AS shard FROM lineitem) s WHERE shard % 2 = 0 AND shard BETWEEN 10 AND 40
UNION ALL SELECT 'split', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT l_suppkey AS shard, count(*) AS n FROM lineitem GROUP BY 1) s WHERE shard % 2 = 1
""")
def select_split(t):
    lengths = t.lineitem.groupBy(F.col("l_suppkey").alias("shard")).agg(F.count(F.lit(1)).alias("shard_length"))
    named = lengths.withColumn("split", F.when(F.col("shard") % 2 == 0, "train").otherwise("val"))
    out = None
    for tag, spec in (("range", "train-{10..40}"), ("counted", "train-{10..40}|500"), ("split", "val")):
        part = shards.select_split(named, spec)[1].select(F.lit(tag).alias("spec"), "shards", "num_samples")
        out = part if out is None else out.unionByName(part)
    return out
