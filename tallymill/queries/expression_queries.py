"""Queries over run names, configurations, predicates and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.functions import configs, names, needles, predicates, schedules, text
from tallymill.functions import scores
from tallymill.missing import coerce
from tallymill.queries.registry import query
from tallymill.sources.logs import extract_from_logs


def r6(col, name):
    return F.round(col, 6).alias(name)


@query("p1_parse_run_name", """
WITH names AS (SELECT name, count(*) AS n FROM runs GROUP BY name),
secs AS (SELECT name, unnest(string_split(name, '__')) AS sec, generate_subscripts(string_split(name, '__'), 1) AS si FROM names),
toks AS (SELECT name, si, unnest(string_split(sec, '_')) AS tok, generate_subscripts(string_split(sec, '_'), 1) AS ti FROM secs WHERE si > 1),
ent AS (SELECT *, si * 1000 + ti AS pos, CASE WHEN regexp_matches(tok, '^[A-Za-z][A-Za-z0-9_]*=.+$') THEN split_part(tok, '=', 1)
          WHEN regexp_matches(tok, '^(img|ma|a|k|ld)[0-9-]') THEN regexp_extract(tok, '^(img|ma|a|k|ld)[0-9-]', 1) END AS key FROM toks WHERE tok <> ''),
val AS (SELECT *, CASE WHEN contains(tok, '=') THEN substr(tok, strpos(tok, '=') + 1) ELSE substr(tok, length(key) + 1) END AS v FROM ent)
SELECT n.name, n.n, split_part(n.name, '__', 1) AS experiment_tag,
  arg_max(v, pos) FILTER (WHERE key = 'img') AS img, arg_max(v, pos) FILTER (WHERE key = 'k') AS k, arg_max(v, pos) FILTER (WHERE key = 'a') AS a,
  arg_max(v, pos) FILTER (WHERE key = 'prob') AS prob, arg_max(v, pos) FILTER (WHERE key = 'seed') AS seed,
  coalesce(string_agg(tok, ',' ORDER BY pos) FILTER (WHERE key IS NULL), '') AS tags
FROM names n LEFT JOIN val ON val.name = n.name GROUP BY n.name, n.n
""", uses=("runs",))
def parse_run_name(t):
    # The names repeat: parse each distinct one once, after a map-side combined count.
    distinct = t.runs.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    parsed = names.parse_run_name(distinct)
    keys = [F.try_element_at("params", F.lit(k)).alias(k) for k in ("img", "k", "a", "prob", "seed")]
    return parsed.select("name", "n", "experiment_tag", *keys, F.array_join("tags", ",").alias("tags"))


@query("p2_canonical_type", """
SELECT type, count(*) AS n, CAST(sum(is_long) AS BIGINT) AS long_runs FROM (
 SELECT CASE WHEN lower(name) LIKE '%\\_\\_bare\\_%' ESCAPE '\\' OR lower(name) LIKE '%\\_\\_bare' ESCAPE '\\' THEN 'bare'
  WHEN contains(name, 'baseline') THEN 'baseline' WHEN contains(name, 'mixup_switch_prob=1.0') THEN 'cutmix'
  WHEN contains(name, 'mixup_switch_prob=0.0') THEN 'mixup' WHEN contains(name, 'openmixup-fmix') THEN 'fmix'
  WHEN contains(name, 'pl-loss') THEN 'groupmix-pl' WHEN contains(name, 'soft-ce') THEN 'groupmix-sce'
  WHEN contains(name, 'mosaic') THEN 'mosaic' ELSE 'unknown' END AS type,
  CASE WHEN contains(name, '__300__') THEN 1 ELSE 0 END AS is_long FROM runs) q GROUP BY type
""", uses=("runs",))
def canonical_type(t):
    # Names repeat over runs: count per name with map-side combine, then classify each name once.
    per_name = t.runs.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return per_name.groupBy(names.canonical_type(F.col("name")).alias("type")).agg(
        F.sum("n").alias("n"), F.sum(F.when(names.is_long_horizon(F.col("name")), F.col("n")).otherwise(0)).alias("long_runs"))


@query("p2_rule_table", """
WITH r AS (SELECT substr(c_name, length(c_name) - 2) AS needle, 'digits' || (c_custkey % 7) AS label, c_custkey % 100 AS priority FROM customer
  UNION ALL SELECT substr(p_name, 1 + p_partkey % 5, 2 + p_partkey % 4), p_brand, 50 + p_partkey % 1000 FROM part),
p AS (SELECT DISTINCT p_name FROM part),
m AS (SELECT p.p_name, arg_min(r.label, r.rk) AS label FROM p JOIN (SELECT needle, label, row_number() OVER (ORDER BY priority, needle, label) AS rk FROM r) r ON contains(p.p_name, r.needle) GROUP BY p.p_name)
SELECT part.p_partkey, coalesce(m.label, 'unknown') AS label FROM part LEFT JOIN m ON m.p_name = part.p_name
""")
def rule_table(t):
    """Names of parts by a table of rules cut out of names: as many rules as customers and parts."""
    digits = t.customer.select(
        F.expr("substr(c_name, length(c_name) - 2)").alias("needle"), F.concat(F.lit("digits"), (F.col("c_custkey") % 7).cast("string")).alias("label"),
        (F.col("c_custkey") % 100).cast("long").alias("priority"))
    pieces = t.part.select(
        F.expr("substr(p_name, cast(1 + p_partkey % 5 as int), cast(2 + p_partkey % 4 as int))").alias("needle"), F.col("p_brand").alias("label"), (50 + F.col("p_partkey") % 1000).cast("long").alias("priority"))
    return needles.first_rule(t.part, "p_name", digits.unionByName(pieces)).select("p_partkey", "label")


@query("p3_name_tokens", """
SELECT optimizer, seed, category, count(*) AS n FROM (
  SELECT CASE run_id % 3 WHEN 0 THEN 'muon' WHEN 1 THEN 'adamw' ELSE 'none' END AS optimizer, seed,
         CASE WHEN contains(recipe, 'soft-ce') THEN 'soft_ce' WHEN contains(recipe, 'pl-loss') THEN 'pl-loss' ELSE 'other' END AS category
  FROM runs) q GROUP BY ALL
""", uses=("runs",))
def name_tokens(t):
    ending = F.when(F.col("run_id") % 3 == 0, "-Muon").when(F.col("run_id") % 3 == 1, "-AdamW").otherwise("")
    name = F.concat("name", ending)
    category = names.matching_category(F.upper(name), [["soft_ce", "softce"], ["pl-loss", "pl_loss"]])
    return t.runs.groupBy(
        F.coalesce(names.optimizer_of(name), F.lit("none")).alias("optimizer"), names.seed_of(F.col("name")).alias("seed"),
        F.coalesce(category, F.lit("other")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


# Fixed values of the folder format.
FOLDER_PATTERN = r"^([^_]+)__coco__img[0-9]+__(baseline|pl-loss|soft-ce|mosaic)__ptseed([0-9]+)__trseed([0-9]+)__[A-Za-z0-9]+$"
FOLDER_TYPES = {"baseline": "baseline", "pl-loss": "groupmix-pl", "soft-ce": "groupmix-sce", "mosaic": "mosaic"}


@query("p4_parse_folder", """
SELECT s_suppkey, 'vit-' || s_nationkey AS model, CASE s_suppkey % 5 WHEN 0 THEN 'baseline' WHEN 1 THEN 'groupmix-pl' WHEN 2 THEN 'groupmix-sce'
  ELSE 'mosaic' END AS type, CAST(42 + s_suppkey % 3 AS INTEGER) AS ptseed, CAST(s_suppkey % 7 AS INTEGER) AS trseed
FROM supplier WHERE s_suppkey % 5 <> 4
""")
def parse_folder(t):
    kinds = F.lit(["baseline", "pl-loss", "soft-ce", "mosaic", "cutmix"])
    folder = F.concat(
        F.lit("vit-"), F.col("s_nationkey").cast("string"), F.lit("__coco__img512__"), kinds[F.col("s_suppkey") % 5],
        F.lit("__ptseed"), (42 + F.col("s_suppkey") % 3).cast("string"), F.lit("__trseed"), (F.col("s_suppkey") % 7).cast("string"),
        F.lit("__run"), F.col("s_suppkey").cast("string"))
    folders = t.supplier.select("s_suppkey", folder.alias("folder"))
    return names.parse_folder(folders, "folder", FOLDER_TYPES, FOLDER_PATTERN).drop("folder")


@query("p5_slug", """
SELECT 'page' AS kind, page_id AS id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'run') AS slug FROM pages
UNION ALL SELECT 'part', p_partkey, coalesce(nullif(trim(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'run') FROM part
""")
def slug(t):
    pages = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), names.slug(F.col("url")).alias("slug"))
    return pages.union(t.part.select(F.lit("part"), "p_partkey", names.slug(F.col("p_name"))))


@query("p6_render_run_name", """
SELECT p_partkey, concat('sweep__vit-', lower(p_type), '__in1k__img', 224 + 32 * (p_size % 2), '__lr=', CASE p_partkey % 2 WHEN 0 THEN '0.001' ELSE '0.0005' END, '__',
  CASE WHEN p_partkey % 6 = 0 THEN 'baseline' ELSE concat_ws('_', 'k' || (3 + p_partkey % 4) || '-' || (3 + p_partkey % 4),
     CASE WHEN p_size % 5 = 0 THEN 'krev' END,
     CASE p_size % 3 WHEN 0 THEN 'a0.1-0.5' WHEN 1 THEN 'a1' ELSE 'a0.25-2' END,
     CASE WHEN p_size % 7 = 0 THEN 'arev' END, CASE WHEN p_partkey % 2 = 0 THEN 'soft-ce' ELSE 'pl-loss' END,
     CASE WHEN p_size % 4 = 0 THEN 'ma0.1' END, CASE WHEN p_size % 2 = 0 THEN 'ks-linear' END, CASE WHEN p_size % 3 = 0 THEN 'as-cosine' END) END,
  '__seed=', 42 + p_partkey % 3) AS name FROM part
""")
def render_run_name(t):
    size, key = F.col("p_size"), F.col("p_partkey")
    grid = t.part.select(
        "p_partkey", F.concat(F.lit("vit-"), F.lower("p_type")).alias("model"), F.lit("in1k").alias("dataset"),
        (224 + size % 2 * 32).alias("img_size"), F.when(key % 2 == 0, 0.001).otherwise(0.0005).alias("lr"),
        F.when(key % 6 == 0, "baseline").alias("variant"), (3 + key % 4).alias("k_min"), (3 + key % 4).alias("k_max"),
        (size % 5 == 0).alias("k_reverse"), F.lit([0.1, 1.0, 0.25])[size % 3].alias("a_min"), F.lit([0.5, 1.0, 2.0])[size % 3].alias("a_max"),
        (size % 7 == 0).alias("a_reverse"), F.when(key % 2 == 0, "soft_ce").otherwise("pl_loss").alias("loss"),
        F.when(size % 4 == 0, 0.1).alias("mixed_alpha"), F.when(size % 2 == 0, "linear").otherwise("fixed").alias("k_schedule"),
        F.when(size % 3 == 0, "cosine").alias("a_schedule"), (42 + key % 3).alias("seed"))
    return names.render_run_name(grid, prefix="sweep").select("p_partkey", "name")


@query("p7_unwrap_config", """
SELECT event_id, CAST(props->>'$.k' AS VARCHAR) AS k, concat(event_type, ',', user_id % 3) AS items, concat('t=', event_type, ';u=', user_id) AS fields,
       concat('[', event_id % 5, ',', event_id % 7, ']') AS deep_list, CAST(user_id AS VARCHAR) AS deep_leaf FROM events
""")
def unwrap_config(t):
    body = F.concat(
        F.lit('{"k": {"value": '), F.get_json_object("props", "$.k"), F.lit(', "desc": "x"}, "items": {"value": ["'), F.col("event_type"),
        F.lit('", '), (F.col("user_id") % 3).cast("string"), F.lit(']}, "fields": {"t": "'), F.col("event_type"), F.lit('", "u": '),
        F.col("user_id").cast("string"), F.lit('}, "deep": {"a": {"list": ['), (F.col("event_id") % 5).cast("string"), F.lit(", "),
        (F.col("event_id") % 7).cast("string"), F.lit('], "leaf": '), F.col("user_id").cast("string"), F.lit("}}}"))
    out = t.events.select("event_id", body.alias("json")).select(
        "event_id", configs.unwrap_config(F.col("json")).alias("c"), configs.flatten_keys(F.col("json")).alias("f"))
    value = lambda k: configs.flatten_value(F.try_element_at("c", F.lit(k)))
    return out.select(
        "event_id", value("k").alias("k"), value("items").alias("items"), value("fields").alias("fields"),
        F.try_element_at("f", F.lit("deep.a.list")).alias("deep_list"), F.try_element_at("f", F.lit("deep.a.leaf")).alias("deep_leaf"))


@query("p8_run_filter", """
SELECT state, count(*) AS n, CAST(sum(step) AS BIGINT) AS steps FROM (
  SELECT *, list_value('u' || (run_id % 4), 's' || (step % 3)) AS tags FROM hist) h
WHERE list_contains(tags, 's1') AND (list_contains(tags, 'u1') OR list_contains(tags, 'u2')) AND run_id % 7 IN (1, 3) AND state IN ('finished', 'running')
  AND regexp_matches(concat('run-', run_id), '^run-[0-9]{2}') AND strftime(ts, '%Y-%m-%d') >= '2024-01-03' AND strftime(ts, '%Y-%m-%d') <= '2024-02-20'
GROUP BY state
""", uses=("hist",))
def run_filter(t):
    runs = t.hist.select(
        "step", "state", F.array(F.concat(F.lit("u"), (F.col("run_id") % 4).cast("string")), F.concat(F.lit("s"), (F.col("step") % 3).cast("string"))).alias("tags"),
        F.concat(F.lit("g"), (F.col("run_id") % 7).cast("string")).alias("group"), F.concat(F.lit("run-"), F.col("run_id").cast("string")).alias("name"),
        F.date_format("ts", "yyyy-MM-dd").alias("created_at"))
    keep = predicates.run_filter(
        tags=["s1"], any_tags=["u1", "u2"], group=["g1", "g3"], state=["finished", "running"], name_regex="^run-[0-9]{2}",
        created_after="2024-01-03", created_before="2024-02-20")
    return runs.where(keep).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("steps"))


@query("p9_label_set", """
SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey IN (3, 7, 55) OR l_suppkey BETWEEN 10 AND 14 OR l_suppkey BETWEEN 90 AND 95 GROUP BY l_suppkey
""")
def label_set(t):
    keep = predicates.label_set(F.col("l_suppkey"), preset=[3, 7], labels=[55], ranges=["10-14", "90-95"])
    return t.lineitem.where(keep).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("p10_snap", """
SELECT CASE WHEN CAST(round(l_discount * 100) AS INTEGER) IN (2, 4, 6, 8, 10) THEN round(l_discount, 2) END AS snapped, count(*) AS n FROM lineitem GROUP BY 1
""")
def snap(t):
    point = predicates.snap(F.col("l_discount"), [0.02, 0.04, 0.06, 0.08, 0.10])
    return t.lineitem.groupBy(point.alias("snapped")).agg(F.count(F.lit(1)).alias("n"))


@query("p11_sweep_rows", """
SELECT rowname, loss, k, count(*) AS n, round(avg(eval_top1), 6) AS top1 FROM (
  SELECT concat('vit-wee__in1k__k', k, '__a', CASE WHEN alpha = 1 THEN '1' ELSE CAST(alpha AS VARCHAR) END, '__', loss) AS rowname, * FROM (
    SELECT CAST(3 + l_partkey % 9 AS INTEGER) AS k, CASE l_suppkey % 3 WHEN 0 THEN 'pl_loss' ELSE 'soft_ce' END AS loss, l_quantity AS eval_top1,
           CASE l_linenumber WHEN 1 THEN 0.1::DOUBLE WHEN 2 THEN 0.25::DOUBLE WHEN 3 THEN 1.0::DOUBLE END AS alpha
    FROM lineitem WHERE l_returnflag <> 'A' AND l_linestatus = 'F' AND l_linenumber IN (1, 2, 3) AND l_orderkey % 5 <> 0 AND l_orderkey % 7 <> 1
      AND l_suppkey % 11 <> 0) a WHERE k BETWEEN 3 AND 10) b GROUP BY ALL
""")
def sweep_rows(t):
    f = F.col
    runs = t.lineitem.select(
        F.when(f("l_returnflag") != "A", True).alias("mixing"), F.when(f("l_linestatus") == "F", "finished").otherwise("crashed").alias("state"),
        F.lit("fixed").alias("schedule"), (3 + f("l_partkey") % 9).alias("k_min"), F.when(f("l_orderkey") % 5 != 0, 3 + f("l_partkey") % 9).alias("k_max"),
        F.lit([0.1, 0.25, 1.0, 0.3, 0.7, 5.0, 7.0])[f("l_linenumber") - 1].alias("alpha_min"), F.lit([0.1, 0.25, 1.0, 0.3, 0.7, 5.0, 7.0])[f("l_linenumber") - 1].alias("alpha_max"),
        F.when(f("l_orderkey") % 7 == 1, True).alias("reverse"), F.lit(None).cast("boolean").alias("k_reverse"), F.lit(False).alias("sampling"),
        f("l_quantity").alias("eval_top1"), F.when(f("l_suppkey") % 11 != 0, f("l_tax")).alias("eval_ece"), F.lit("vit_wee_patch16").alias("model"),
        F.lit("imagenet-1k-wds").alias("dataset"), F.when(f("l_suppkey") % 3 == 0, "pl_loss").otherwise("soft_ce").alias("loss"))
    rows = predicates.sweep_rows(runs, range(3, 11), [0.1, 0.25, 0.5, 1.0, 2.0, 3.0])
    return rows.groupBy("rowname", "loss", "k").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("eval_top1"), "top1"))


@query("p12_coerce_round", """
SELECT model, seed, round_even(avg(CASE WHEN eval_time_s < 45 THEN eval_time_s END), 4) AS time_mean, round_even(stddev_samp(CASE WHEN eval_time_s < 45 THEN eval_time_s END), 4) AS time_std,
       count(*) - count(CASE WHEN eval_time_s < 45 THEN 1 END) AS failed FROM runs GROUP BY model, seed
""", uses=("runs",))
def coerce_round(t):
    raw = t.runs.withColumn("time", F.when(F.col("eval_time_s") < 45, F.col("eval_time_s").cast("string")).when(F.col("eval_time_s") < 48, "NaN").otherwise("n/a"))
    out = coerce(raw, ["time"]).groupBy("model", "seed").agg(
        F.avg("time").alias("time_mean"), F.stddev_samp("time").alias("time_std"), F.count_if(F.col("time").isNull()).alias("failed"))
    return text.round_metrics(out)


@query("p13_format_cells", """
SELECT model, cell, delta, concat('| ', model, ' | ', cell, ' | ', delta, ' |') AS line FROM (
  SELECT model, printf('%.4f +/- %.4f', m, s) AS cell, concat(CASE WHEN m >= 75 THEN '+' ELSE '-' END, printf('%.3f', abs(m - 75))) AS delta
  FROM (SELECT model, avg(top1_acc) AS m, stddev_samp(top1_acc) AS s FROM runs GROUP BY model) q) z
UNION ALL SELECT 'none', '-', NULL, '| none | - |  |'
""", uses=("runs",))
def format_cells(t):
    agg = t.runs.groupBy("model").agg(F.avg("top1_acc").alias("m"), F.stddev_samp("top1_acc").alias("s"))
    missing = t.region.where("r_regionkey = 0").select(F.lit("none").alias("model"), F.lit(None).cast("double").alias("m"), F.lit(None).cast("double").alias("s"))
    cells = agg.unionByName(missing).select(
        "model", text.mean_std(F.col("m"), F.col("s"), 4).alias("cell"), text.signed(F.col("m") - 75).alias("delta"))
    return cells.withColumn("line", text.markdown_row(F.col("model"), F.col("cell"), F.col("delta")))


@query("p14_describe_label", """
SELECT concat(p_name, ': ', p_type) AS description, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
""")
def describe_label(t):
    dim = text.describe_label(t.part.select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("lemma"), F.col("p_type").alias("definition")), detailed=True)
    # Count per index first: the description join then sees one row per label.
    per_label = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    named = text.describe_column(per_label, dim, "l_partkey").where("description IS NOT NULL")
    return named.groupBy("description").agg(F.sum("n").alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"))


@query("p14_describe_topk", """
SELECT s.vec_id, string_agg(n.p_name, ',' ORDER BY s.rk) AS names FROM soft s JOIN part n ON n.p_partkey = s.c + 1 WHERE s.rk <= 3 GROUP BY s.vec_id
""", uses=("soft",))
def describe_topk(t):
    top = t.preds.select("vec_id", F.transform(scores.ranked_classes(F.col("logits"), 3), lambda s: s["class"]).alias("top"))
    dim = text.describe_label(t.part.select((F.col("p_partkey") - 1).alias("idx"), F.col("p_name").alias("lemma")))
    return text.describe_array(top, dim, "top", ["vec_id"]).select("vec_id", F.array_join("descriptions", ",").alias("names"))


@query("p15_step_counts", """
SELECT c_nationkey, (n * 100 + 63) // 64 AS num_steps, (n * 10 + 63) // 64 AS warmup_steps, (n + 63) // 64 AS steps_per_epoch
FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) q
""")
def step_counts(t):
    sizes = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("samples"))
    parts = schedules.steps(F.col("samples"), epochs=100, warmup_epochs=10, batch=64)
    return sizes.select("c_nationkey", *[v.alias(k) for k, v in parts.items()])


@query("p15_schedules", """
SELECT doc_id, round(CASE WHEN e * 7 + c < 5 THEN 0.2::DOUBLE ELSE 0.2::DOUBLE + c / 6.0::DOUBLE * 1.8 END, 6) AS alpha_linear,
  round(CASE WHEN e * 7 + c < 5 THEN 2.0::DOUBLE ELSE 2.0::DOUBLE - 0.5::DOUBLE * (1 - cos(pi() * least(1, greatest(0, (e * 7 + c - 5) / 78.0::DOUBLE)))) * 1.8 END, 6) AS alpha_cosine,
  CAST(CASE WHEN e >= 10 THEN 1 WHEN e < 2 THEN 3 ELSE least(6, greatest(3, floor(3 + least(1, (e - 2) / 9.0::DOUBLE) * 3 + 0.5))) END AS INTEGER) AS k_linear,
  CAST(CASE WHEN e < 2 THEN 6 ELSE least(6, greatest(3, floor(6 - 0.5::DOUBLE * (1 - cos(pi() * least(1, (e - 2) / 9.0::DOUBLE))) * 3 + 0.5))) END AS INTEGER) AS k_cosine,
  CAST(CASE WHEN e >= 11 THEN 1 ELSE 4 END AS INTEGER) AS k_fixed
FROM (SELECT doc_id, doc_id % 12 AS e, n_chars % 7 AS c FROM documents) d
""")
def schedule_values(t):
    e, c = F.col("doc_id") % 12, F.col("n_chars") % 7
    per = F.lit(7)
    return t.documents.select(
        "doc_id",
        r6(schedules.alpha(e, c, 0.2, 2.0, per, "linear", warmup_cycles=F.lit(5)), "alpha_linear"),
        r6(schedules.alpha(e, c, 0.2, 2.0, per, "cosine", reverse=True, per_epoch=False, warmup_cycles=F.lit(5), total_cycles=F.lit(84)), "alpha_cosine"),
        schedules.group_size(e, 3, 6, "linear", warmup_epochs=2, total_epochs=12, cooldown_epochs=2).cast("int").alias("k_linear"),
        schedules.group_size(e, 3, 6, "cosine", reverse=True, warmup_epochs=2, total_epochs=12).cast("int").alias("k_cosine"),
        schedules.group_size(e, 4, 4, "fixed", total_epochs=12, cooldown_epochs=1).cast("int").alias("k_fixed"))




@query("p16_funnel", """
SELECT r.reason, count(o.o_orderkey) AS rows FROM (VALUES ('not_finished'), ('low_priority'), ('cheap'), ('never'), ('eligible')) r(reason)
LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'not_finished' WHEN starts_with(o_orderpriority, '5') THEN 'low_priority'
  WHEN o_totalprice < 50000 THEN 'cheap' ELSE 'eligible' END AS reason FROM orders) o ON o.reason = r.reason GROUP BY r.reason
""")
def funnel(t):
    checks = [
        ("not_finished", F.col("o_orderstatus") != "F"), ("low_priority", F.col("o_orderpriority").startswith("5")),
        ("cheap", F.col("o_totalprice") < 50000), ("never", F.col("o_totalprice") < 0),
    ]
    return predicates.funnel_counts(predicates.funnel(t.orders, checks), [n for n, _ in checks])


@query("p17_extract_from_logs", """
WITH logs AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS name, html FROM pages),
newest AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id DESC) AS rn FROM logs),
found AS (SELECT *, CASE WHEN regexp_matches(html, '<h1[^>]*>([^<]+)<') THEN regexp_extract(html, '<h1[^>]*>([^<]+)<', 1)
   WHEN regexp_matches(html, '<title>([^<]*)</title>') THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS v FROM newest WHERE rn <= 3)
SELECT name, count(*) AS searched, arg_max(v, page_id) FILTER (WHERE v IS NOT NULL) AS value FROM found GROUP BY name
""")
def extract(t):
    logs = t.pages.select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("name"), F.col("page_id").alias("mtime"), F.col("url").alias("path"), F.col("html").alias("content"))
    return extract_from_logs(logs, ["<h1[^>]*>([^<]+)<", "<title>([^<]*)</title>"], limit=3)
