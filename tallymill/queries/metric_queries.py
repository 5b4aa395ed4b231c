"""Metric queries over scored predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.functions import scores
from tallymill.operators import metrics as M
from tallymill.plans.indexing import by_number
from tallymill.queries.registry import query


def r6(col, name):
    return F.round(col, 6).alias(name)


DIMS, CLASSES = 64, 10
WEIGHTS = [[((c * 7 + d * 3) % 11 - 5) / 10 for d in range(DIMS)] for c in range(CLASSES)]


@query("m1_batch_score", """
SELECT vec_id, label, CAST(arg_max(c, s) AS INTEGER) AS pred, round(max(s), 6) AS score FROM (
  SELECT e.vec_id, e.label, cls.c, sum(e.x * (((cls.c * 7 + e.d * 3) % 11) - 5) / 10.0::DOUBLE) AS s
  FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) e,
       (SELECT range AS c FROM range(10)) cls
  GROUP BY e.vec_id, e.label, cls.c) q GROUP BY vec_id, label
""")
def batch_score(t):
    features = F.transform("embedding", lambda x: x.cast("double"))
    scored = t.embeddings.select("vec_id", "label", M.linear_scores(features, WEIGHTS).alias("logits"))
    return scored.select("vec_id", "label", scores.argmax(F.col("logits")).alias("pred"), r6(F.array_max("logits"), "score"))


@query("m1_batch_score_udf", """
SELECT label, count(*) AS n, round(avg(s), 3) AS mean_best FROM (
 SELECT vec_id, label, max(s) AS s FROM (
  SELECT e.vec_id, e.label, cls.c, sum(e.x * (((cls.c * 7 + e.d * 3) % 11) - 5) / 10.0::DOUBLE) AS s
  FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) e,
       (SELECT range AS c FROM range(10)) cls
  GROUP BY e.vec_id, e.label, cls.c) q GROUP BY vec_id, label) z GROUP BY label
""")
def batch_score_udf(t):
    def make_predict():
        import numpy as np

        weights = np.array(WEIGHTS, dtype="float64").T
        return lambda batch: (batch.astype("float64") @ weights).astype("float32")

    scored = M.batch_score(t.embeddings.select("vec_id", "label", "embedding"), "embedding", make_predict, CLASSES, DIMS)
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.array_max("logits")), 3).alias("mean_best"))


@query("m2_topk_acc", """
SELECT model, round(avg(CASE WHEN label_rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS top1_acc,
       round(avg(CASE WHEN label_rank <= 3 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS top3_acc,
       round(avg(CASE WHEN label_rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS top5_acc FROM scored GROUP BY model
""", uses=("scored",))
def topk_acc(t):
    out = M.topk_accuracy(t.preds, ["model"], (1, 3, 5))
    return out.select("model", *[r6(F.col(c), c) for c in ("top1_acc", "top3_acc", "top5_acc")])


@query("m3_nll", "SELECT model, round(avg(nll), 6) AS nll FROM scored GROUP BY model", uses=("scored",))
def nll(t):
    return M.mean_nll(t.preds, ["model"]).select("model", r6(F.col("nll"), "nll"))


@query("m4_brier", "SELECT model, round(avg(brier), 6) AS brier FROM scored GROUP BY model", uses=("scored",))
def brier(t):
    return M.mean_brier(t.preds, ["model"]).select("model", r6(F.col("brier"), "brier"))


ECE_SQL = """
SELECT model, bins, sum(abs(acc - cf) * n) / sum(n) AS ece FROM (
  SELECT model, bins, least(floor(conf * bins), bins - 1) AS b, count(*) AS n, avg(conf) AS cf,
         avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0 END) AS acc
  FROM scored, (VALUES (5), (10), (15), (20)) v(bins) GROUP BY 1, 2, 3) q GROUP BY model, bins"""


@query("m5_ece", f"SELECT model, CAST(bins AS INTEGER) AS bins, round(ece, 6) AS ece FROM ({ECE_SQL}) z", uses=("scored",))
def ece(t):
    return M.calibration_error(t.preds, ["model"]).select("model", "bins", r6(F.col("ece"), "ece"))


@query("m6_ece_meter", f"SELECT model, round(ece * 100, 6) AS ece_percent FROM ({ECE_SQL}) z WHERE bins = 15", uses=("scored",))
def ece_meter(t):
    soft = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == F.col("label"), 0.91).otherwise(0.01))
    out = M.calibration_meter(t.preds.withColumn("soft", soft), ["model"], "soft")
    return out.select("model", r6(F.col("ece_percent"), "ece_percent"))


@query("m7_reliability", """
SELECT m.model, CAST(b.range AS INTEGER) AS bin, round((b.range + 0.5::DOUBLE) / 15, 6) AS center,
       round(c.acc, 6) AS accuracy, round(coalesce(c.n, 0) / m.total, 6) AS fraction
FROM (SELECT model, count(*)::DOUBLE AS total FROM scored GROUP BY model) m CROSS JOIN range(15) b
LEFT JOIN (SELECT model, least(floor(conf * 15), 14)::INTEGER AS bin, count(*) AS n,
                  avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM scored GROUP BY 1, 2) c
  ON c.model = m.model AND c.bin = b.range
""", uses=("scored",))
def reliability(t):
    out = M.reliability(t.preds, ["model"], 15)
    return out.select("model", "bin", r6(F.col("center"), "center"), r6(F.col("accuracy"), "accuracy"), r6(F.col("fraction"), "fraction"))


@query("m8_metric_registry", f"""
SELECT model, metric, round(value, 6) AS value FROM (
  SELECT model, 'top1_acc' AS metric, avg(CASE WHEN label_rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS value FROM scored GROUP BY model
  UNION ALL SELECT model, 'top5_acc', avg(CASE WHEN label_rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) * 100 FROM scored GROUP BY model
  UNION ALL SELECT model, 'nll', avg(nll) FROM scored GROUP BY model
  UNION ALL SELECT model, 'brier', avg(brier) FROM scored GROUP BY model
  UNION ALL SELECT model, concat('ece/n_bins=', CAST(bins AS VARCHAR)), ece FROM ({ECE_SQL}) z) u
""", uses=("scored",))
def metric_registry(t):
    return M.REGISTRY.evaluate(t.preds, ["model"], ["top1_acc", "top5_acc", "nll", "brier", "ece"]).select(
        "model", "metric", r6(F.col("value"), "value"))


@query("m8_metric_kinds", """
WITH s AS (SELECT model, label, nll, round(conf, 9) AS conf, pred = label AS hit FROM scored),
r AS (SELECT model, hit, rank() OVER w + (count(*) OVER (PARTITION BY model, conf) - 1) / 2.0::DOUBLE AS rk FROM s WINDOW w AS (PARTITION BY model ORDER BY conf)),
a AS (SELECT model, sum(rk) FILTER (WHERE hit) AS rs, count(*) FILTER (WHERE hit)::DOUBLE AS p, count(*) FILTER (WHERE NOT hit)::DOUBLE AS q FROM r GROUP BY model),
c AS (SELECT model, avg(nll) AS m, var_pop(nll) AS v, stddev_samp(nll) AS sd FROM s GROUP BY model),
k AS (SELECT s.model, avg((nll - m) * (nll - m) * (nll - m)) / power(max(v), 1.5::DOUBLE) AS skew FROM s JOIN c ON c.model = s.model GROUP BY s.model)
SELECT model, metric, round(value, 6) AS value FROM (
  SELECT model, 'top1_acc' AS metric, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END) * 100 AS value FROM s GROUP BY model
  UNION ALL SELECT model, 'class_acc', avg(acc) FROM (SELECT model, label, avg(CASE WHEN hit THEN 100.0::DOUBLE ELSE 0 END) AS acc FROM s GROUP BY model, label) z GROUP BY model
  UNION ALL SELECT model, 'median_nll', quantile_cont(nll, 0.5) FROM s GROUP BY model
  UNION ALL SELECT model, 'auroc', (rs - p * (p + 1) / 2) / (p * q) FROM a
  UNION ALL SELECT model, 'nll_shape/mean', m FROM c UNION ALL SELECT model, 'nll_shape/std', sd FROM c
  UNION ALL SELECT model, 'nll_shape/skew', skew FROM k) u
""", uses=("scored",))
def metric_kinds(t):
    return M.REGISTRY.evaluate(t.preds, ["model"], ["top1_acc", "class_acc", "median_nll", "auroc", "nll_shape"]).select(
        "model", "metric", r6(F.col("value"), "value"))


@query("m9_multi_label_acc", """
SELECT model, round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS real_top3, count(*) AS n FROM (
  SELECT vec_id, model, bool_or(c = label OR c = (label + 3) % 10) AS ok FROM soft
  WHERE rk <= 3 AND vec_id % 5 <> 0 GROUP BY vec_id, model) q GROUP BY model
""", uses=("soft",))
def multi_label_acc(t):
    preds = t.preds.withColumn("path", F.concat(F.lit("val/n"), F.col("vec_id").cast("string"), F.lit(".jpg")))
    sets = F.when(F.col("vec_id") % 5 != 0, F.array(F.col("label"), (F.col("label") + 3) % 10)).otherwise(F.array().cast("array<int>"))
    labels = t.embeddings.select(F.concat(F.lit("real/n"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("path"), sets.alias("labels"))
    return M.multi_label_accuracy(preds, labels, ["model"], 3).select("model", r6(F.col("real_top3"), "real_top3"), "n")


@query("m10_restrict_classes", """
SELECT model, count(*) AS n, round(avg(CASE WHEN best = label THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS top1_acc,
       round(avg(lse - own), 6) AS nll FROM (
  SELECT vec_id, model, label, arg_max(c, l) AS best, max(l) + ln(sum(exp(l - mx))) AS lse, max(CASE WHEN c = label THEN l END) AS own
  FROM (SELECT *, max(l) OVER (PARTITION BY vec_id) AS mx FROM plong WHERE c IN (1, 3, 5, 7, 9)) q
  WHERE label IN (1, 3, 5, 7, 9) GROUP BY vec_id, model, label) z GROUP BY model
""", uses=("plong",))
def restrict_classes(t):
    small = M.restrict_classes(t.preds, [9, 3, 7, 1, 5])
    row = scores.with_scores(small)
    return row.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("_pred") == F.col("label")).cast("double")) * 100, "top1_acc"),
        r6(F.avg("_nll"), "nll"))


@query("m11_topk_predictions", """
SELECT vec_id, CAST(rk AS INTEGER) AS rank, c AS class, round(p, 6) AS score FROM soft WHERE rk <= 5
""", uses=("soft",))
def topk_predictions(t):
    return M.topk_predictions(t.preds, ["vec_id"], 5, probabilities=True).withColumn("score", F.round("score", 6))


@query("m12_tta_mean", """
SELECT source_id, label, CAST(arg_max(c, l) AS INTEGER) AS pred, round(max(l), 6) AS best FROM (
  SELECT p.vec_id // 5 AS source_id, p.c, avg(p.l) AS l, arg_min(p.label, p.vec_id) AS label FROM plong p GROUP BY 1, 2) q
GROUP BY source_id, label
""", uses=("plong",))
def tta_mean(t):
    mean = M.average_copies(t.preds, F.floor(F.col("vec_id") / 5), 64)
    return mean.select("source_id", "label", scores.argmax(F.col("logits")).alias("pred"), r6(F.array_max("logits"), "best"))


@query("m13_weighted_meter", """
SELECT user_id, event_id, round(sum(value * n) OVER w / sum(n) OVER w + 1e-9, 6) AS avg
FROM (SELECT *, (1 + event_id % 4) AS n FROM events) q
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def running_meter(t):
    events = t.events.select("user_id", "event_id", "value", (1 + F.col("event_id") % 4).alias("n"))
    out = M.running_meter(events, ["user_id"], by_number(F.col("event_id")), F.col("value"), F.col("n"))
    # Exact ties at the seventh decimal are common here; both engines get the same nudge before rounding.
    return out.select("user_id", "event_id", r6(F.col("avg") + 1e-9, "avg"))


@query("m13_meter_total", """
SELECT user_id, round(sum(value * (1 + event_id % 4)) / sum(1 + event_id % 4), 6) AS avg,
       CAST(sum(1 + event_id % 4) AS BIGINT) AS count, arg_max(value, event_id) AS val FROM events GROUP BY user_id
""")
def meter_total(t):
    out = M.weighted_meter(t.events, ["user_id"], F.col("value"), 1 + F.col("event_id") % 4, F.col("event_id"))
    return out.select("user_id", r6(F.col("avg"), "avg"), "count", "val")


def mixed(t):
    """Every scored row with the mixed target of its group."""
    return t.mix_samples.join(t.mix_targets, "g")


@query("m14_mixed_target_ce", """
SELECT k, count(*) AS n, round(sum(loss) / greatest(count(*) FILTER (WHERE w > 0), 1), 6) AS loss FROM (
  SELECT g, k, sum(-logp * weight) AS loss, sum(weight) AS w FROM mixed_scores GROUP BY g, k) q GROUP BY k
""", uses=("mixed_scores",))
def mixed_target_ce(t):
    df = mixed(t)
    loss = scores.mixed_cross_entropy(F.col("logits"), F.col("target"))
    return df.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), r6(scores.mean_over_valid(loss, scores.target_weight(F.col("target"))), "loss"))


@query("m14_soft_and_smoothed_ce", """
SELECT model, round(avg(soft), 6) AS soft_ce, round(avg(0.9::DOUBLE * nll + 0.1::DOUBLE * flat), 6) AS smoothed_ce FROM (
  SELECT vec_id, model, sum(-logp * (CASE WHEN c = label THEN 0.91::DOUBLE ELSE 0.01::DOUBLE END)) AS soft,
         sum(CASE WHEN c = label THEN -logp ELSE 0 END) AS nll, avg(-logp) AS flat
  FROM soft GROUP BY vec_id, model) q GROUP BY model
""", uses=("soft",))
def soft_and_smoothed_ce(t):
    dense = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == F.col("label"), 0.91).otherwise(0.01))
    return t.preds.groupBy("model").agg(
        r6(F.avg(scores.soft_cross_entropy(F.col("logits"), dense)), "soft_ce"),
        r6(F.avg(scores.smoothed_cross_entropy(F.col("logits"), F.col("label"), 0.1)), "smoothed_ce"))


@query("m15_ranked_loss", """
SELECT k, round(sum(pl) / count(*), 6) AS ranked, round(sum(blend) / count(*), 6) AS blended FROM (
  SELECT g, k, sum(weight * (ln(greatest(mass, 1e-12)) - logp)) AS pl,
         sum(weight * ((1 - 0.37::DOUBLE) * ln(greatest(mass, 1e-12)) - logp)) AS blend FROM (
    SELECT g, k, weight, logp, greatest(1 - sum(p) OVER (PARTITION BY g), 0) + sum(p) OVER (PARTITION BY g ORDER BY slot
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mass FROM mixed_scores) q GROUP BY g, k) z GROUP BY k
""", uses=("mixed_scores",))
def ranked_loss(t):
    df = mixed(t)
    weight = scores.target_weight(F.col("target"))
    pure = scores.ranked_loss(F.col("logits"), F.col("target"))
    blend = scores.ranked_loss(F.col("logits"), F.col("target"), alpha=0.37)
    return df.groupBy("k").agg(
        r6(scores.mean_over_valid(pure, weight), "ranked"), r6(scores.mean_over_valid(blend, weight), "blended"))


AREA_SQL = """
SELECT model, k, n_samples, round(spearman_mean, 6) AS spearman_mean, spearman_n, round(pair_acc, 6) AS pair_acc, pair_n,
       round(top_acc, 6) AS top_acc, top_n FROM (
  SELECT s.model, s.k, count(x.g) AS n_samples, avg(x.rho) AS spearman_mean, count(x.rho) AS spearman_n,
         sum(x.ok)::DOUBLE / nullif(sum(x.pairs), 0) AS pair_acc, CAST(coalesce(sum(x.pairs), 0) AS BIGINT) AS pair_n,
         avg(x.top_ok)::DOUBLE AS top_acc, count(x.top_ok) AS top_n
  FROM (SELECT DISTINCT model, lv.k FROM preds, (VALUES ('3'), ('4'), ('5'), ('6'), ('all')) lv(k)
        WHERE model IN (SELECT model FROM contrib)) s
  LEFT JOIN contrib x ON x.model = s.model AND (s.k = 'all' OR s.k = CAST(x.k AS VARCHAR)) GROUP BY s.model, s.k) f
"""
AREA_CTE = """
WITH areas AS (SELECT g, k, model, label, sum(weight) AS area, any_value(score) AS score FROM mixed_scores WHERE k IN (3, 4, 5, 6) GROUP BY g, k, model, label),
ranked AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, rank() OVER (PARTITION BY g ORDER BY area) AS ra,
                  rank() OVER (PARTITION BY g ORDER BY score) AS rs FROM areas),
per AS (SELECT g, k, model, max(n) AS n, sum((ra - rs) * (ra - rs)) AS d2, count(DISTINCT area) AS na, count(DISTINCT score) AS ns,
               arg_max(label, score) AS best_score, arg_max(label, area) AS best_area, max(area) AS top_area FROM ranked GROUP BY g, k, model),
pairs AS (SELECT a.g, count(*) AS pairs, count(*) FILTER (WHERE a.score > b.score) AS ok
          FROM areas a JOIN areas b ON a.g = b.g AND a.area - b.area >= 0.05::DOUBLE GROUP BY a.g),
tops AS (SELECT a.g, count(*) AS ties FROM areas a JOIN per p ON p.g = a.g AND a.area = p.top_area GROUP BY a.g),
contrib AS (SELECT p.g, p.k, p.model,
        CASE WHEN n >= 2 AND na = n AND ns = n THEN 1 - 6.0::DOUBLE * d2 / (n * (n * n - 1)) END AS rho,
        coalesce(q.ok, 0) AS ok, coalesce(q.pairs, 0) AS pairs,
        CASE WHEN t.ties = 1 THEN CAST(best_score = best_area AS INTEGER) END AS top_ok
      FROM per p LEFT JOIN pairs q ON q.g = p.g LEFT JOIN tops t ON t.g = p.g)
"""


def area_samples(t):
    joined = t.mix_samples.join(M.present_classes(t.mix_slots, ["g", "k"]), "g")
    return joined.select(F.col("vec_id").alias("g"), "model", "k", M.with_class_scores(F.col("present"), F.col("logits")).alias("present"))


def area_metrics(t):
    return M.area_score_metrics(area_samples(t))


@query("m16_area_score_metrics", AREA_CTE + AREA_SQL, uses=("preds", "mixed_scores"))
def area_score_metrics(t):
    out = area_metrics(t)
    return out.withColumns({c: F.round(c, 6) for c in ("spearman_mean", "pair_acc", "top_acc")})


@query("m17_class_probability", """
SELECT v.vec_id, m.slot, m.label + (CASE WHEN m.slot = 2 THEN 5 ELSE 0 END) AS class, round(s.p, 6) AS probability
FROM mix_slots v JOIN mix_slots m ON m.g = v.g LEFT JOIN soft s ON s.vec_id = v.vec_id AND s.c = m.label + (CASE WHEN m.slot = 2 THEN 5 ELSE 0 END)
""", uses=("mix_slots", "plong", "soft"))
def class_probability(t):
    classes = t.mix_slots.select("g", "slot", (F.col("label") + F.when(F.col("slot") == 2, 5).otherwise(0)).alias("class"))
    wanted = t.mix_slots.select("vec_id", "g").join(classes, "g").drop("g")
    out = M.class_probability(wanted, t.preds, ["vec_id"])
    return out.select("vec_id", "slot", "class", r6(F.col("probability"), "probability"))
