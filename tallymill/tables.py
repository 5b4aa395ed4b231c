"""The input tables and the derived views that queries run on."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """``Tables(spark, folder).orders`` reads one parquet table; views are properties."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.spark.read.parquet(self.path(name))
        raise AttributeError(name)

    @cached_property
    def runs(self) -> DataFrame:
        """Evaluation runs; recipe spellings are fixed values of the run-name format."""
        recipes = [
            "baseline__baseline",
            "bare_cutmix=0_cutmix_minmax=None_mixup=0_mixup_prob=0.0",
            "cutmix_mixup_switch_prob=1.0",
            "mixup_mixup_switch_prob=0.0",
            "openmixup-fmix",
            "mosaic__mosaic",
            "k4-4_a0.1-0.5_soft-ce_as-cosine_scheduling",
            "k6-6_a0.1-0.5_pl-loss_as-cosine_scheduling",
        ]
        models = ["vit-wee", "vit-little", "vit-medium", "vit-betwixt"]
        # Some groups never run their third seed: those rows repeat the second one.
        lost = (F.col("l_suppkey") % 4 == 3) & (F.col("l_partkey") % 8 == 5) & (F.col("l_orderkey") % 3 == 2)
        base = self.lineitem.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_id"),
            F.lit(models)[F.col("l_suppkey") % 4].alias("model"),
            F.lit("in1k").alias("dataset"),
            F.when(lost, F.lit(43)).otherwise(42 + F.col("l_orderkey") % 3).alias("seed"),
            F.when(F.col("l_returnflag") == "R", "300__").otherwise("").alias("horizon"),
            F.lit(recipes)[F.col("l_partkey") % 8].alias("recipe"),
            (70 + F.col("l_discount") * 100).alias("top1_acc"),
            (0.5 + F.col("l_tax")).alias("nll"),
            F.col("l_discount").alias("brier"),
            F.col("l_quantity").alias("eval_time_s"),
            F.when(F.col("l_linenumber") == 7, "TimeoutError: lost").otherwise("").alias("error"),
        )
        name = F.concat(
            "model", F.lit("__in1k__img256__"), "horizon", "recipe", F.lit("__seed="), F.col("seed").cast("string")
        )
        return base.withColumn("name", name)

    @cached_property
    def samples(self) -> DataFrame:
        return self.documents.select("doc_id", "lang", "source", "n_chars").join(
            self.labels.select("doc_id", "quality"), "doc_id", "left"
        ).select(
            F.col("doc_id").alias("sample_id"), F.col("lang").alias("class_name"), "source",
            F.col("n_chars").alias("size"), F.coalesce("quality", F.lit(-1)).alias("quality"),
        )

    @cached_property
    def classes(self) -> DataFrame:
        """``samples`` without the label join, for operators that need only the class."""
        return self.documents.select(
            F.col("doc_id").alias("sample_id"), F.col("lang").alias("class_name"), "source",
            F.col("n_chars").alias("size"),
        )

    @cached_property
    def files(self) -> DataFrame:
        return self.pages.select(
            "page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"), F.length("html").alias("size")
        )

    @cached_property
    def hist(self) -> DataFrame:
        state = (
            F.when(F.col("event_type") == "signup", "launched")
            .when(F.col("event_type") == "purchase", "finished")
            .when(F.col("event_type") == "error", "failed")
            .otherwise("running")
        )
        return self.events.select(
            F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), "ts",
            F.col("value").alias("metric"), F.col("props").alias("config"), state.alias("state"),
        )

    @cached_property
    def lat(self) -> DataFrame:
        """Batch timings; 25 (configuration, seed) groups hold all rows, so positions come from the cell plan."""
        from tallymill.plans.indexing import by_number, indexed

        timed = self.events.select(
            F.col("event_type").alias("configuration"), (42 + F.col("user_id") % 5).alias("seed"),
            (F.col("value") / 100).alias("seconds"), F.lit(128).alias("items"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id",
        )
        order = by_number(F.col("at"), F.col("event_id"))
        return indexed(timed, ["configuration", "seed"], order, "batch_no", 1).drop("at", "event_id")

    @cached_property
    def timings(self) -> DataFrame:
        """``lat`` without batch positions."""
        return self.events.select(
            F.col("event_type").alias("configuration"), (42 + F.col("user_id") % 5).alias("seed"),
            (F.col("value") / 100).alias("seconds"), F.lit(128).alias("items"),
        )

    @cached_property
    def mix_slots(self) -> DataFrame:
        """Every embedding is a slot of a group; groups have three to six rows in turn, and the last one what is left."""
        at = F.col("vec_id") % 18
        first = F.when(at < 3, 0).when(at < 7, 3).when(at < 12, 7).otherwise(12)
        turn = F.when(at < 3, 0).when(at < 7, 1).when(at < 12, 2).otherwise(3)
        g = F.floor(F.col("vec_id") / 18).cast("bigint") * 4 + turn
        slots = self.embeddings.select("vec_id", g.alias("g"), (at - first).alias("slot"), "label")
        slots = slots.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("g")))
        return slots.withColumn("weight", (F.col("slot") + 1) * 2.0 / (F.col("k") * (F.col("k") + 1)))

    @cached_property
    def mix_samples(self) -> DataFrame:
        """Scored rows with the group whose target they have."""
        return self.preds.select("vec_id", "model", "logits").join(self.mix_slots.select("vec_id", "g"), "vec_id")

    @cached_property
    def mix_targets(self) -> DataFrame:
        """Slots collected per group: at most six."""
        slots = F.sort_array(F.collect_list(F.struct("slot", "label", "weight")))
        return self.mix_slots.groupBy("g", "k").agg(
            F.transform(slots, lambda s: F.struct(s["label"].alias("label"), s["weight"].alias("weight"))).alias("target")
        )

    @cached_property
    def preds(self) -> DataFrame:
        return self.embeddings.select(
            "vec_id", F.concat(F.lit("m"), (F.col("vec_id") % 4).cast("string")).alias("model"), "label",
            F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits"),
        )


# The same views for the checking engine, independent of the code above.
ORACLE_VIEWS = {
    "runs": """
SELECT l_orderkey * 10 + l_linenumber AS run_id, model, dataset, seed, horizon, recipe,
       concat(model, '__in1k__img256__', horizon, recipe, '__seed=', CAST(seed AS VARCHAR)) AS name,
       70 + l_discount * 100 AS top1_acc, 0.5::DOUBLE + l_tax AS nll, l_discount AS brier, l_quantity AS eval_time_s,
       CASE WHEN l_linenumber = 7 THEN 'TimeoutError: lost' ELSE '' END AS error
FROM (SELECT *, 'in1k' AS dataset, CASE WHEN l_suppkey % 4 = 3 AND l_partkey % 8 = 5 AND l_orderkey % 3 = 2 THEN 43 ELSE 42 + l_orderkey % 3 END AS seed,
        CASE l_suppkey % 4 WHEN 0 THEN 'vit-wee' WHEN 1 THEN 'vit-little' WHEN 2 THEN 'vit-medium' ELSE 'vit-betwixt' END AS model,
        CASE WHEN l_returnflag = 'R' THEN '300__' ELSE '' END AS horizon,
        CASE l_partkey % 8 WHEN 0 THEN 'baseline__baseline'
          WHEN 1 THEN 'bare_cutmix=0_cutmix_minmax=None_mixup=0_mixup_prob=0.0'
          WHEN 2 THEN 'cutmix_mixup_switch_prob=1.0' WHEN 3 THEN 'mixup_mixup_switch_prob=0.0'
          WHEN 4 THEN 'openmixup-fmix' WHEN 5 THEN 'mosaic__mosaic'
          WHEN 6 THEN 'k4-4_a0.1-0.5_soft-ce_as-cosine_scheduling'
          ELSE 'k6-6_a0.1-0.5_pl-loss_as-cosine_scheduling' END AS recipe
      FROM lineitem) t""",
    "samples": """
SELECT d.doc_id AS sample_id, d.lang AS class_name, d.source AS source, d.n_chars AS size, COALESCE(l.quality, -1) AS quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "files": """
SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path, length(html) AS size FROM pages""",
    "hist": """
SELECT user_id AS run_id, event_id AS step, ts, value AS metric, props AS config,
       CASE event_type WHEN 'signup' THEN 'launched' WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' ELSE 'running' END AS state
FROM events""",
    "lat": """
SELECT event_type AS configuration, 42 + user_id % 5 AS seed, value / 100 AS seconds, 128 AS items,
       row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY ts, event_id) AS batch_no
FROM events""",
    "mix_slots": """
SELECT vec_id, g, k, slot, label, (slot + 1) * 2.0::DOUBLE / (k * (k + 1)) AS weight
FROM (SELECT *, count(*) OVER (PARTITION BY g) AS k FROM (
  SELECT vec_id, label, vec_id // 18 * 4 + CASE WHEN vec_id % 18 < 3 THEN 0 WHEN vec_id % 18 < 7 THEN 1 WHEN vec_id % 18 < 12 THEN 2 ELSE 3 END AS g,
    vec_id % 18 - CASE WHEN vec_id % 18 < 3 THEN 0 WHEN vec_id % 18 < 7 THEN 3 WHEN vec_id % 18 < 12 THEN 7 ELSE 12 END AS slot FROM embeddings) a) t""",
    "preds": """
SELECT vec_id, concat('m', CAST(vec_id % 4 AS VARCHAR)) AS model, label,
       list_transform(embedding, lambda x: x::DOUBLE * 10) AS logits
FROM embeddings""",
    # one row per (sample, class) with the softmax value
    "plong": """
SELECT p.vec_id, p.model, p.label, i.c AS c, p.logits[i.c + 1] AS l
FROM (SELECT vec_id, concat('m', CAST(vec_id % 4 AS VARCHAR)) AS model, label,
             list_transform(embedding, lambda x: x::DOUBLE * 10) AS logits FROM embeddings) p,
     (SELECT CAST(range AS INTEGER) AS c FROM range(64)) i""",
    "soft": """
SELECT *, exp(l - mx) / sum(exp(l - mx)) OVER (PARTITION BY vec_id) AS p,
       l - mx - ln(sum(exp(l - mx)) OVER (PARTITION BY vec_id)) AS logp,
       row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, c) AS rk
FROM (SELECT *, max(l) OVER (PARTITION BY vec_id) AS mx FROM plong) q""",
    "scored": """
SELECT vec_id, model, label, max(CASE WHEN rk = 1 THEN c END) AS pred, max(p) AS conf,
       max(CASE WHEN c = label THEN logp END) * -1 AS nll, max(CASE WHEN c = label THEN rk END) AS label_rank,
       sum((p - CASE WHEN c = label THEN 1 ELSE 0 END) * (p - CASE WHEN c = label THEN 1 ELSE 0 END)) AS brier,
       max(CASE WHEN c = label THEN p END) AS p_label
FROM soft GROUP BY vec_id, model, label""",
    "mixed_scores": """
SELECT v.vec_id AS g, m.k, m.slot, m.label, m.weight, s.model, s.l AS score, s.p, s.logp
FROM mix_slots v JOIN mix_slots m ON m.g = v.g JOIN soft s ON s.vec_id = v.vec_id AND s.c = m.label""",
}
_NEEDS = {"soft": ("plong",), "scored": ("plong", "soft"), "mixed_scores": ("mix_slots", "plong", "soft")}


def oracle_with(views, body: str) -> str:
    """``body`` behind a WITH clause that defines ``views`` and what they need."""
    order: list[str] = []
    for view in views:
        for name in (*_NEEDS.get(view, ()), view):
            if name not in order:
                order.append(name)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{name} AS ({ORACLE_VIEWS[name].strip()})" for name in order)
    text = body.strip()
    if text[:5].upper() == "WITH ":
        return f"WITH {parts},\n{text[5:]}"
    return f"WITH {parts}\n{text}"
