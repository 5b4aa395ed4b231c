"""Registered queries of the training-data operators, with check SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymill.llm import decontaminate, html, lines, mixing, neardup, pii, ppm, quality, repair, rules, spelling, toxicity, urls
from tallymill.llm.common import kept
from tallymill.llm.targets import MIX_SEED, MIX_WEIGHTS, damaged_turns, mix_domain
from tallymill.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


# The contract's rules (fixed values): host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query("op2_url_filters", oracle="""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), listed(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'),
    ('net', '/fr/', 'block')
), judged AS (
  SELECT p.host, p.path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN listed r
    ON (p.host = r.r_host OR ends_with(p.host, '.' || r.r_host)) AND starts_with(p.path, r.r_path)
  GROUP BY p.host, p.path
)
SELECT p.page_id, p.host, p.path, j.rule, coalesce(j.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN judged j ON p.host = j.host AND p.path = j.path
""")
def url_filters(t: Tables) -> DataFrame:
    listed = t.spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(t.pages.select("page_id", "url"), listed).drop("url")


@query("op7_quality_rules")
def quality_rules(t: Tables) -> DataFrame:
    measured = kept(rules.measure(t.documents, ["doc_id", "lang", "source"]), "measured")
    return rules.judge(measured, "lang", "source").select("doc_id", *rules.COUNTS, "base_failed", "kept")


@query("op10_html_extraction")
def html_extraction(t: Tables) -> DataFrame:
    return html.extract_main(t.pages).select("page_id", "url", "text", "n_chars")


@query("op6_benchmark_decontamination", oracle=r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0) x
), places AS (
  SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows) s WHERE len(ws) >= size
), found AS (
  SELECT p.doc_id, w.item_id, p.i, p.size FROM (SELECT doc_id, size, i, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS w FROM places) p
  JOIN windows w ON w.size = p.size AND w.w = p.w
), hit AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM (SELECT DISTINCT doc_id, i, size FROM found) y) z GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) v GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.listed, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
""")
def benchmark_decontamination(t: Tables) -> DataFrame:
    found = decontaminate.find_benchmark(t.documents.select("doc_id", "text"), t.benchmark)
    digest = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


@query("op3_simhash_near_dedup")
def simhash_near_dedup(t: Tables) -> DataFrame:
    return neardup.near_duplicates(t.documents.select("doc_id", "text"))


@query("op5_quality_classifier")
def quality_classifier(t: Tables) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = t.documents.select("doc_id", "text", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"))
    return quality.score_quality(docs, t.labels, ~F.col("held_out")).select("doc_id", "held_out", "score", "predicted")


@query("op4_line_dedup")
def line_dedup(t: Tables) -> DataFrame:
    return lines.remove_repeated(t.documents.select("doc_id", "text")).select("doc_id", "n_removed", "chars_removed", "text")


@query("op9_source_mixing")
def source_mixing(t: Tables) -> DataFrame:
    mixed = mixing.mix(t.documents, MIX_WEIGHTS, mix_domain(F.col("source")), seed=MIX_SEED)
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


@query("op8_pii")
def personal_data(t: Tables) -> DataFrame:
    return pii.find_pii(t.documents)


@query("op1_lm_scoring")
def lm_scoring(t: Tables) -> DataFrame:
    return ppm.score_texts(t.documents, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)


@query("op11_spelling_variants")
def spelling_variants(t: Tables) -> DataFrame:
    return spelling.variants(t.documents.select("doc_id", "text"))


@query("op12_conversation_repair")
def conversation_repair(t: Tables) -> DataFrame:
    turns = damaged_turns(t.conversations)
    return repair.digests(turns, repair.report(turns, copies="copies"), copies="copies")


@query("op13_toxicity")
def toxic_texts(t: Tables) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = t.documents.select("doc_id", "text", "lang", held_out.alias("held_out"))
    scored = toxicity.score_toxicity(docs, t.labels, ~F.col("held_out"))
    return scored.select("doc_id", "held_out", "score", "predicted", "threshold", "flagged")
