"""Queries over result tables: aggregation over seeds, ranking, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.functions import names
from tallymill.operators import aggregates as G
from tallymill.operators import metrics as M
from tallymill.operators import ranking as W
from tallymill.queries.metric_queries import AREA_CTE, area_samples
from tallymill.queries.registry import query
from tallymill.session import cut_lineage


def r6(*columns):
    return [F.round(c, 6).alias(c) for c in columns]


@query("g1_aggregate_over_seeds", """
SELECT model, error_key, round(avg(top1_acc), 6) AS top1_acc_mean, round(stddev_samp(top1_acc), 6) AS top1_acc_std, round(avg(nll), 6) AS nll_mean,
       round(stddev_samp(nll), 6) AS nll_std, count(DISTINCT seed) AS n_seeds FROM (SELECT *, nullif(error, '') AS error_key FROM runs) q GROUP BY model, error_key
""", uses=("runs",))
def over_seeds(t):
    runs = t.runs.select("model", F.when(F.col("error") != "", F.col("error")).alias("error_key"), "seed", "top1_acc", "nll")
    out = G.aggregate_over_seeds(runs, ["model", "error_key"])
    return out.select("model", "error_key", *r6("top1_acc_mean", "top1_acc_std", "nll_mean", "nll_std"), "n_seeds")


TYPE_CASE = """CASE WHEN contains(recipe, 'bare_') THEN 'bare' WHEN contains(recipe, 'baseline') THEN 'baseline' WHEN contains(recipe, 'switch_prob=1.0') THEN 'cutmix'
  WHEN contains(recipe, 'switch_prob=0.0') THEN 'mixup' WHEN contains(recipe, 'fmix') THEN 'fmix' WHEN contains(recipe, 'pl-loss') THEN 'groupmix-pl'
  WHEN contains(recipe, 'soft-ce') THEN 'groupmix-sce' ELSE 'mosaic' END"""
G2_SQL = f"""
SELECT type, dataset, model, long_horizon, count(DISTINCT seed) AS n_seeds, string_agg(DISTINCT CAST(seed AS VARCHAR), ',' ORDER BY CAST(seed AS VARCHAR)) AS seeds_present,
  concat_ws(',', CASE WHEN count(*) FILTER (WHERE seed = 42) = 0 THEN '42' END, CASE WHEN count(*) FILTER (WHERE seed = 43) = 0 THEN '43' END, CASE WHEN count(*) FILTER (WHERE seed = 44) = 0 THEN '44' END) AS missing_seeds,
  CASE WHEN count(DISTINCT seed) = 3 THEN 'complete' ELSE 'unfinished' END AS status, avg(top1_acc) AS top1_acc_mean, coalesce(stddev_samp(top1_acc), 0) AS top1_acc_std,
  avg(brier) AS brier_mean, coalesce(stddev_samp(brier), 0) AS brier_std
FROM (SELECT *, {TYPE_CASE} AS type, horizon <> '' AS long_horizon FROM runs) q GROUP BY type, dataset, model, long_horizon"""


def by_type(t):
    # Narrow projections before the one shuffle.
    typed = names.with_canonical_type(t.runs.select("name", "dataset", "model", "seed", "top1_acc", "brier")).withColumn(
        "long_horizon", names.is_long_horizon(F.col("name"))).drop("name")
    return G.aggregate_by_type(typed, ["top1_acc", "brier", "ece/n_bins=15"])


@query("g2_aggregate_by_type", f"""SELECT type, dataset, model, long_horizon, CAST(n_seeds AS INTEGER) AS n_seeds, seeds_present, missing_seeds, status,
  round(top1_acc_mean, 6) AS top1_acc_mean, round(top1_acc_std, 6) AS top1_acc_std, round(brier_mean, 6) AS brier_mean, round(brier_std, 6) AS brier_std FROM ({G2_SQL}) z""", uses=("runs",))
def aggregate_by_type(t):
    out = by_type(t)
    return out.select(*out.columns[:8], *r6(*out.columns[8:]))


@query("g2_horizon_split", f"""SELECT CASE WHEN status <> 'complete' THEN 'unfinished' WHEN long_horizon THEN 'long' ELSE 'short' END AS part, count(*) AS n_groups,
  round(sum(top1_acc_mean), 4) AS total FROM ({G2_SQL}) z GROUP BY 1""", uses=("runs",))
def horizon_split(t):
    out = None
    for name, part in zip(("short", "long", "unfinished"), G.split_by_horizon(by_type(t))):
        row = part.groupBy(F.lit(name).alias("part")).agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.sum("top1_acc_mean"), 4).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


@query("g3_confidence_95", """
SELECT model, recipe, seed, nll, eval_time_s, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN 1.96::DOUBLE * stddev_samp(top1_acc) / sqrt(count(*)) END, 6) AS ci95
FROM runs GROUP BY model, recipe, seed, nll, eval_time_s
""", uses=("runs",))
def confidence(t):
    agg = t.runs.groupBy("model", "recipe", "seed", "nll", "eval_time_s").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("top1_acc").alias("s"))
    return agg.select("model", "recipe", "seed", "nll", "eval_time_s", "n", F.round(G.confidence_95(F.col("s"), F.col("n")), 6).alias("ci95"))


@query("g4_runtime_summary", """
SELECT configuration, loss, count(*) AS runs, string_agg(DISTINCT CAST(seed AS VARCHAR), ',' ORDER BY CAST(seed AS VARCHAR)) AS seeds_present,
       round(avg(seconds), 6) AS seconds_mean, round(stddev_samp(seconds), 6) AS seconds_std
FROM (SELECT *, CASE WHEN seconds > 0.5 THEN 'slow' END AS loss FROM lat) q GROUP BY configuration, loss
""", uses=("lat",))
def runtime_summary(t):
    timed = t.timings.withColumn("loss", F.when(F.col("seconds") > 0.5, "slow"))
    return G.runtime_summary(timed, ["configuration", "loss"], ["seconds"]).select("configuration", "loss", "runs", "seeds_present", *r6("seconds_mean", "seconds_std"))


@query("g5_last_eval_summary", """
WITH lines AS (SELECT user_id, event_id, user_id % 4 AS model, user_id % 3 AS seed, CAST(props->>'$.k' AS DOUBLE) AS k, value FROM events WHERE event_id % 3 = 0 AND event_id % 4 <> 0),
last AS (SELECT user_id, model, seed, arg_max(k, event_id) AS k, arg_max(value, event_id) AS v FROM lines GROUP BY ALL)
SELECT model, count(*) AS n_seeds, round(avg(k), 6) AS k_mean, round(coalesce(stddev_samp(k), 0), 6) AS k_std, round(avg(v), 6) AS v_mean, round(coalesce(stddev_samp(v), 0), 6) AS v_std,
       string_agg(CAST(seed AS VARCHAR), ',' ORDER BY seed) AS seeds FROM last GROUP BY model
""")
def last_eval_summary(t):
    k = F.get_json_object("props", "$.k")
    good = F.concat(F.lit('{"k": '), k, F.lit(', "v": '), F.col("value").cast("string"), F.lit("}"))
    body = F.when(F.col("event_id") % 4 == 0, '{"k": 1, broken').when(F.col("event_id") % 3 == 0, good).otherwise(F.concat(F.lit('{"other": '), k, F.lit("}")))
    lines = t.events.select(F.col("user_id").alias("run"), (F.col("user_id") % 4).alias("model"), (F.col("user_id") % 3).alias("seed"), F.col("event_id").alias("line_no"), body.alias("text"))
    out = G.last_eval_summary(lines, ["k", "v"], "k", ["model"])
    return out.select("model", "n_seeds", *r6("k_mean", "k_std", "v_mean", "v_std"), "seeds")


@query("g6_latency_profile", """
SELECT configuration, seed, round(quantile_cont(seconds, 0.5) FILTER (WHERE batch_no > 21), 6) AS p50_seconds, round(quantile_cont(seconds, 0.95) FILTER (WHERE batch_no > 21), 6) AS p95_seconds,
       round(sum(items) FILTER (WHERE batch_no > 21) / sum(seconds) FILTER (WHERE batch_no > 21), 6) AS items_per_second, max(seconds) FILTER (WHERE batch_no = 1) AS first_batch_seconds,
       count(*) FILTER (WHERE batch_no > 21) AS measured FROM lat GROUP BY configuration, seed
""", uses=("lat",))
def latency_profile(t):
    out = G.latency_profile(t.lat, ["configuration", "seed"], 20)
    return out.select("configuration", "seed", *r6("p50_seconds", "p95_seconds", "items_per_second"), "first_batch_seconds", "measured")


@query("g6_latency_sketch", """
SELECT configuration, n, level, TRUE AS within FROM (SELECT configuration, count(*) AS n FROM lat WHERE batch_no > 21 GROUP BY configuration) c,
  (VALUES ('p05'), ('p50'), ('p95'), ('p99')) v(level)
""", uses=("lat",))
def latency_sketch(t):
    """Sketches per configuration and seed, merged per configuration; ranks are held against the exact ones, off by at most half a percent."""
    levels = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    late = t.lat.where("batch_no > 21")
    merged = G.merge_sketches(G.quantile_sketches(late, ["configuration", "seed"], F.col("seconds")), ["configuration"])
    found = cut_lineage(G.sketch_quantiles(merged, ["configuration"], levels))
    errors = G.rank_errors(late, found, ["configuration"], F.col("seconds"), levels)
    return errors.join(found.select("configuration", "n"), "configuration").select(
        "configuration", "n", F.col("name").alias("level"), (F.col("error") <= 0.005).alias("within"))


@query("g7_metrics_across_seeds", AREA_CTE + """,
rows AS (SELECT 'M' || (CAST(substr(model, 2) AS INTEGER) // 2 % 2) AS family, model AS seed, lv.k AS k, avg(rho) AS spearman_mean,
   sum(ok)::DOUBLE / nullif(sum(pairs), 0) AS pair_acc FROM contrib, (VALUES ('3'), ('4'), ('5'), ('6'), ('all')) lv(k)
   WHERE lv.k = 'all' OR lv.k = CAST(contrib.k AS VARCHAR) GROUP BY 1, 2, 3)
SELECT f.family, f.k, round(avg(spearman_mean), 6) AS spearman_mean_mean, round(stddev_samp(spearman_mean), 6) AS spearman_mean_std, round(avg(pair_acc), 6) AS pair_acc_mean,
   round(stddev_samp(pair_acc), 6) AS pair_acc_std, count(pair_acc) AS pair_acc_n, CASE WHEN f.k = 'all' THEN 2147483647 ELSE CAST(f.k AS INTEGER) END AS level_order
FROM (SELECT DISTINCT r.family, lv.k FROM rows r, (VALUES ('3'), ('4'), ('5'), ('6'), ('all')) lv(k)) f LEFT JOIN rows r ON r.family = f.family AND r.k = f.k GROUP BY f.family, f.k
""", uses=("preds", "mixed_scores"))
def across_seeds(t):
    rows = M.area_score_metrics(area_samples(t))
    family = F.concat(F.lit("M"), (F.floor(F.substring("model", 2, 9).cast("int") / 2) % 2).cast("string"))
    out = G.metrics_across_seeds(rows.withColumn("family", family), ["family", "k"], ["spearman_mean", "pair_acc"])
    return out.select("family", "k", *r6("spearman_mean_mean", "spearman_mean_std", "pair_acc_mean", "pair_acc_std"), "pair_acc_n", "level_order")


@query("g8_class_balance", """
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), s AS (SELECT count(*) AS classes, min(n) AS smallest, max(n) AS largest, CAST(sum(n) AS BIGINT) AS original FROM c)
SELECT s.*, m.mode, CAST(classes * CASE m.mode WHEN 'min' THEN smallest WHEN 'max' THEN largest ELSE 200 END AS BIGINT) AS epoch_size,
  round((classes * CASE m.mode WHEN 'min' THEN smallest WHEN 'max' THEN largest ELSE 200 END - original) * 100.0::DOUBLE / original, 6) AS diff_percent
FROM s, (VALUES ('min'), ('max'), ('fixed')) m(mode)
""")
def class_balance(t):
    return G.class_balance(t.documents, "lang", 200).withColumn("diff_percent", F.round("diff_percent", 6))


@query("g9_natural_stats", """
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
lv AS (SELECT r.range AS l, count(*) AS active FROM range(1000000) r JOIN c ON c.n > r.range WHERE r.range < (SELECT max(n) FROM c) GROUP BY 1)
SELECT CAST(coalesce(sum(active) FILTER (WHERE active >= 3), 0) AS BIGINT) AS mixed_primary, CAST(coalesce(sum(active) FILTER (WHERE active < 3), 0) AS BIGINT) AS single_primary,
  count(*) FILTER (WHERE active >= 3) AS mixed_rows, count(*) FILTER (WHERE active < 3) AS single_rows, count(*) FILTER (WHERE active >= 3 AND active % 3 > 0) AS padded_groups,
  CAST(coalesce(sum(active % 3) FILTER (WHERE active >= 3), 0) AS BIGINT) AS remainder_outputs, CAST(sum(active) AS BIGINT) AS total_primary FROM lv
""")
def natural_stats(t):
    return G.natural_stats(t.documents, "lang", 3)


@query("g10_grid_coverage", """
SELECT m.model, r.recipe, CAST(s.seed AS BIGINT) AS seed FROM (SELECT DISTINCT model FROM runs) m, (SELECT DISTINCT recipe FROM runs) r, (VALUES (42), (43), (44), (45)) s(seed)
WHERE NOT EXISTS (SELECT 1 FROM runs x WHERE x.model = m.model AND x.recipe = r.recipe AND x.seed = s.seed)
""", uses=("runs",))
def grid_coverage(t):
    axes = {"recipe": G.distinct_values(t.runs, "recipe"), "seed": [42, 43, 44, 45]}
    return G.grid_coverage(t.runs, ["model"], axes).withColumn("seed", F.col("seed").cast("bigint"))


@query("g11_method_tables", """
SELECT model, method, round(avg(top1_acc), 6) AS top1_acc_mean, round(stddev_samp(top1_acc), 6) AS top1_acc_std, round(avg(ece), 6) AS ece_mean, round(avg(nll), 6) AS nll_mean, count(DISTINCT seed) AS n_seeds
FROM (SELECT *, brier / 2 AS ece, CASE WHEN contains(recipe, 'pl-loss') THEN 'given' WHEN contains(recipe, 'baseline') THEN 'baseline' ELSE 'groupmix' END AS method FROM runs) q GROUP BY model, method
""", uses=("runs",))
def method_tables(t):
    given = F.when(F.col("name").contains("pl-loss"), "given")
    # Tags are those of the name; parse once per distinct name, then attach.
    tags = names.parse_run_name(t.runs.select("name").distinct()).select("name", "tags")
    runs = t.runs.select("name", "model", "seed", "top1_acc", "nll", (F.col("brier") / 2).alias("ece/n_bins=15"), given.alias("method")).join(tags, "name")
    acc, cal = G.method_tables(G.with_method(runs), ["model", "method"])
    both = acc.join(cal.drop("n_seeds"), ["model", "method"])
    return both.select("model", "method", *r6("top1_acc_mean", "top1_acc_std"), F.round("`ece/n_bins=15_mean`", 6).alias("ece_mean"), F.round("nll_mean", 6).alias("nll_mean"), "n_seeds")


@query("g12_pivot_matrix", """
SELECT recipe, round(avg(nll) FILTER (WHERE seed = 42), 6) AS s42, round(avg(nll) FILTER (WHERE seed = 43), 6) AS s43, round(avg(nll) FILTER (WHERE seed = 44), 6) AS s44 FROM runs GROUP BY recipe
""", uses=("runs",))
def pivot_matrix(t):
    out = G.pivot_matrix(t.runs, "recipe", "seed", "nll", [42, 43, 44])
    return out.select("recipe", *[F.round(f"`{s}`", 6).alias(f"s{s}") for s in (42, 43, 44)])


@query("g13_average_parameters", """
WITH best AS (SELECT vec_id FROM embeddings ORDER BY vec_id * 7 % 101 DESC, 'ck' || vec_id DESC LIMIT 40),
p AS (SELECT vec_id, 'w' AS key, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings
      UNION ALL SELECT vec_id, 'b', unnest(embedding)::DOUBLE * 2, generate_subscripts(embedding, 1) - 1 FROM embeddings WHERE vec_id % 2 = 0)
SELECT key, CAST(pos AS INTEGER) AS pos, round(avg(value), 6) AS value, count(*) AS copies FROM p WHERE vec_id IN (SELECT vec_id FROM best) GROUP BY key, pos
""")
def average_parameters(t):
    e = t.embeddings
    base = e.select(F.col("vec_id").alias("ckpt"), F.posexplode("embedding").alias("pos", "value"))
    params = base.select("ckpt", F.lit("w").alias("key"), "pos", F.col("value").cast("double").alias("value")).unionByName(
        base.where("ckpt % 2 = 0").select("ckpt", F.lit("b").alias("key"), "pos", (F.col("value").cast("double") * 2).alias("value")))
    checkpoints = e.select(
        F.col("vec_id").alias("ckpt"), (F.col("vec_id") * 7 % 101).cast("double").alias("metric"), F.concat(F.lit("ck"), F.col("vec_id").cast("string")).alias("path"))
    return G.average_parameters(params, checkpoints, 40).withColumn("value", F.round("value", 6))


@query("g14_merge_class_weights", """
SELECT m.g, CAST(m.label AS VARCHAR) AS class, round(sum(m.weight), 6) AS weight, max(c.n) AS n_present FROM mix_slots m JOIN (SELECT g, CAST(count(DISTINCT label) AS INTEGER) AS n FROM mix_slots GROUP BY g) c ON c.g = m.g GROUP BY m.g, m.label
""", uses=("mix_slots",))
def merge_class_weights(t):
    out = G.merge_class_weights(t.mix_slots, ["g"])
    return out.select("g", F.explode("weights").alias("class", "weight"), F.size("present").alias("n_present")).withColumn("weight", F.round("weight", 6))


@query("g15_common_value", """
SELECT 'dataset' AS "column", count(DISTINCT dataset) AS n_values, CASE WHEN count(DISTINCT dataset) = 1 THEN min(dataset) END AS value FROM runs
UNION ALL SELECT 'model', count(DISTINCT model), CASE WHEN count(DISTINCT model) = 1 THEN min(model) END FROM runs
""", uses=("runs",))
def common_value(t):
    return G.common_value(t.runs, "dataset").unionByName(G.common_value(t.runs, "model"))


@query("g15_unique_key", """
SELECT 'orders' AS source, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS duplicate_keys, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1) q
UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (WHERE n > 1), CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) q
""")
def unique_key(t):
    orders = G.unique_key(t.orders, ["o_orderkey"]).select(F.lit("orders").alias("source"), "*")
    return orders.unionByName(G.unique_key(t.lineitem, ["l_orderkey", "l_linenumber"]).select(F.lit("lineitem").alias("source"), "*"))


@query("g15_seed_sets", """
SELECT seeds, count(*) AS groups FROM (SELECT model, recipe, string_agg(DISTINCT CAST(seed AS VARCHAR), ',' ORDER BY CAST(seed AS VARCHAR)) AS seeds FROM runs GROUP BY 1, 2) q GROUP BY seeds
""", uses=("runs",))
def seed_sets(t):
    return G.seed_set_consistency(t.runs, ["model", "recipe"])


@query("g16_sensitivity_band", """
WITH z AS (SELECT CASE WHEN model = 'vit-wee' AND contains(recipe, 'fmix') THEN 'vit-other' ELSE model END AS model, recipe, nll FROM runs)
SELECT m.model, r.recipe, round(median(x.nll), 6) AS median, round(min(x.nll), 6) AS lo, round(max(x.nll), 6) AS hi FROM (SELECT DISTINCT model FROM z) m CROSS JOIN (SELECT DISTINCT recipe FROM z) r
LEFT JOIN z x ON x.model = m.model AND x.recipe = r.recipe GROUP BY m.model, r.recipe
""", uses=("runs",))
def sensitivity_band(t):
    model = F.when((F.col("model") == "vit-wee") & F.col("recipe").contains("fmix"), "vit-other").otherwise(F.col("model"))
    runs = t.runs.select(model.alias("model"), "recipe", "nll")
    return G.sensitivity_band(runs, "recipe", "model", "nll").select("model", "recipe", *r6("median", "lo", "hi"))


@query("g17_robust_range", """
SELECT model, round(c, 6) AS center, round(vmin, 6) AS vmin, round(vmax, 6) AS vmax, (lo < vmin OR hi > vmax) AS clipped FROM (
  SELECT model, c, greatest(c - half, 71) AS vmin, c + half AS vmax, lo, hi FROM (
    SELECT model, 74.0::DOUBLE AS c, greatest(quantile_cont(abs(top1_acc - 74.0::DOUBLE), 0.9), 1.5) AS half, min(top1_acc) AS lo, max(top1_acc) AS hi FROM runs GROUP BY model) q) z
""", uses=("runs",))
def robust_range(t):
    out = G.robust_range(t.runs, ["model"], F.col("top1_acc"), F.lit(74.0), 0.9, 1.5, 71.0)
    return out.select("model", *r6("center", "vmin", "vmax"), "clipped")


@query("w1_average_rank", """
WITH cells AS (SELECT model, seed, recipe, avg(nll) AS v FROM runs GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY model, seed ORDER BY v) + (count(*) OVER (PARTITION BY model, seed, v) - 1) / 2.0::DOUBLE AS rk FROM cells)
SELECT recipe, round(avg(rk), 6) AS mean_rank, count(*) AS n_groups FROM r GROUP BY recipe
""", uses=("runs",))
def average_rank(t):
    return W.average_rank(t.runs, ["model", "seed"], "recipe", F.col("nll"), higher_is_better=False).withColumn("mean_rank", F.round("mean_rank", 6))


@query("w2_shared_order", """
WITH cells AS (SELECT model, recipe, avg(nll) AS nll, avg(top1_acc) AS acc FROM runs GROUP BY ALL),
r AS (SELECT recipe, rank() OVER (PARTITION BY model ORDER BY nll) AS a, rank() OVER (PARTITION BY model ORDER BY acc DESC) AS b FROM cells),
m AS (SELECT recipe, (avg(a) + avg(b)) / 2 AS mean_rank FROM r GROUP BY recipe)
SELECT recipe, round(mean_rank, 6) AS mean_rank, CAST(row_number() OVER (ORDER BY CASE WHEN starts_with(recipe, 'k6') THEN 0 WHEN starts_with(recipe, 'baseline') THEN 1 ELSE 2 END, mean_rank, recipe) AS INTEGER) AS place FROM m
""", uses=("runs",))
def shared_order(t):
    return W.shared_order(t.runs, ["model"], "recipe", {"nll": False, "top1_acc": True}, ["k6", "baseline"]).withColumn("mean_rank", F.round("mean_rank", 6))


@query("w3_best_and_delta", """
WITH a AS (SELECT model, recipe, round(avg(top1_acc), 6) AS top1, round(avg(nll), 1) AS nll FROM runs GROUP BY ALL)
SELECT model, recipe, top1, nll, top1 = max(top1) OVER w AS top1_best, nll = min(nll) OVER w AS nll_best,
  round(top1 - max(top1) FILTER (WHERE recipe = 'openmixup-fmix') OVER w, 6) AS top1_delta, round(nll - max(nll) FILTER (WHERE recipe = 'openmixup-fmix') OVER w, 6) AS nll_delta
FROM a WINDOW w AS (PARTITION BY model)
""", uses=("runs",))
def best_and_delta(t):
    agg = t.runs.groupBy("model", "recipe").agg(F.round(F.avg("top1_acc"), 6).alias("top1"), F.round(F.avg("nll"), 1).alias("nll"))
    out = W.best_and_delta(agg, ["model"], "recipe", {"top1": True, "nll": False}, "openmixup-fmix")
    return out.select("model", "recipe", "top1", "nll", "top1_best", "nll_best", *r6("top1_delta", "nll_delta"))


@query("w4_robustness_diff", """
WITH b AS (SELECT model, 224 AS img_size, round(sum(s_acctbal), 2) AS top1, max(s_acctbal) AS top5 FROM (SELECT *, CASE WHEN s_nationkey < 20 THEN 'n' ELSE 'other' END || s_nationkey AS model FROM supplier) s GROUP BY 1),
x AS (SELECT 'n' || c_nationkey AS model, 224 AS img_size, round(sum(c_acctbal), 2) AS top1, max(c_acctbal) AS top5 FROM customer GROUP BY 1),
br AS (SELECT *, row_number() OVER (ORDER BY top1 DESC, top5 DESC, model) - 1 AS place FROM b), xr AS (SELECT *, row_number() OVER (ORDER BY top1 DESC, top5 DESC, model) - 1 AS place FROM x)
SELECT xr.model, xr.img_size, xr.top1, xr.top5, xr.place, coalesce(printf('%+.3f', xr.top1 - br.top1), '') AS top1_diff, coalesce(printf('%+.3f', xr.top5 - br.top5), '') AS top5_diff,
  CASE WHEN br.place IS NULL THEN '' WHEN br.place = xr.place THEN '0' ELSE printf('%+d', br.place - xr.place) END AS rank_diff
FROM xr LEFT JOIN br ON br.model = xr.model AND br.img_size = xr.img_size
""")
def robustness_diff(t):
    def scores(df, key, value, most=24):
        kind = F.when(F.col(key) <= most, "n").otherwise("other")
        return df.groupBy(F.concat(kind, F.col(key).cast("string")).alias("model"), F.lit(224).alias("img_size")).agg(
            F.round(F.sum(value), 2).alias("top1"), F.max(value).alias("top5"))

    return W.robustness_diff(scores(t.supplier, "s_nationkey", "s_acctbal", 19), scores(t.customer, "c_nationkey", "c_acctbal"))


@query("w5_relative_to_reference", """
WITH a AS (SELECT configuration, avg(seconds) AS v FROM lat GROUP BY 1)
SELECT configuration, round(v, 6) AS seconds, round(100 * (1 - v / (SELECT v FROM a WHERE configuration = 'view')), 6) AS reduction_percent FROM a
""", uses=("lat",))
def relative_to_reference(t):
    agg = t.timings.groupBy("configuration").agg(F.avg("seconds").alias("seconds"))
    return W.relative_to_reference(agg, F.col("configuration") == "view", "seconds").select("configuration", *r6("seconds", "reduction_percent"))


@query("w6_best_checkpoints", """
WITH h AS (SELECT user_id AS run_id, event_id AS step, CASE WHEN event_type <> 'error' THEN value END AS metric FROM events),
f AS (SELECT *, max(metric) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
   row_number() OVER (PARTITION BY run_id ORDER BY metric DESC NULLS LAST, step) AS rk FROM h)
SELECT run_id, step, metric, metric IS NOT NULL AND (before IS NULL OR metric > before) AS is_best, metric IS NULL OR rk <= 3 AS retained FROM f
""")
def best_checkpoints(t):
    hist = t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.when(F.col("event_type") != "error", F.col("value")).alias("metric"))
    return W.best_checkpoints(hist, "run_id", "step", "metric", 3)


@query("w6_best_of_run", """
SELECT user_id AS run_id, min(value) AS best_metric, arg_min(event_id, value * 1e6 + event_id / 1e6) AS best_step FROM events WHERE event_type <> 'error' GROUP BY user_id
""")
def best_of_run(t):
    hist = t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.when(F.col("event_type") != "error", F.col("value")).alias("metric"))
    return W.best_of_run(hist, "run_id", "step", "metric", decreasing=True)


@query("w7_preferred_order", """
SELECT recipe, CAST(row_number() OVER (ORDER BY CASE recipe WHEN 'mosaic__mosaic' THEN 1 WHEN 'absent' THEN 2 WHEN 'baseline__baseline' THEN 3 ELSE 4 END, recipe) AS INTEGER) AS place
FROM (SELECT DISTINCT recipe FROM runs) q
""", uses=("runs",))
def preferred_order(t):
    return W.preferred_order(t.runs, "recipe", ["mosaic__mosaic", "absent", "baseline__baseline"])
