"""URL rules by a sorted sweep over reversed-host keys.

A rule ``(host, path, verdict)`` fits its host and all subdomains if the url's path starts with the rule's path. In the
canonical key of a url, one per host suffix, the labels come last first: ``www.example.com`` and ``/en/25`` at suffix
``example.com`` give ``com.example.//en/25``. All keys that a rule fits lie between its own key and that key plus the
byte FF, which no UTF-8 text holds. Intervals of prefixes nest or are disjoint, so a sweep in key order needs a stack:
an interval's start pushes the rule, its end pops it, and what lies on top at a url's key is the longest rule at that
suffix. The stack is one ``last()`` per level over the same sorted window, so nothing is collected.

Cells keep the sweep distributed: distinct urls are dealt over cells by their hash and each cell sweeps all rules. The
number of cells is chosen so that the rules repeated in all cells are no more rows than the urls.

Defined cases: NULL urls and those without ``://`` have an empty host and path and fit no rule; a url that no rule fits
gets the default verdict; of two rules with the same host and path ``block`` wins; rules without a host are left out, a
rule's NULL path counts as empty; repeated pages are judged alike, one output row per input row; columns of the input
named like an added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymill.llm.common import fold_ascii, without

CELL_URLS = 10_000
ADDED = ("host", "path", "rule", "verdict")


def url_host(url: Column) -> Column:
    return fold_ascii(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substr(text, at + 3)).otherwise("")


def canonical_key(labels: Column, level: int, path: Column) -> Column:
    """The key at the host suffix of ``level`` labels, as bytes."""
    suffix = F.reverse(F.slice(labels, F.size(labels) - level + 1, level))
    return F.concat(F.array_join(suffix, "."), F.lit("./"), path).cast("binary")


def _rule_table(rules: DataFrame) -> DataFrame:
    """One row per (host, path) with its key and label count."""
    plain = rules.select(
        fold_ascii(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"),
    ).where(F.col("r_host") != "")
    unique = plain.groupBy("r_host", "r_path").agg(
        F.max(F.when(F.col("r_verdict") == "block", "block")).alias("blocked"), F.min("r_verdict").alias("other"))
    labels = F.split("r_host", "\\.", -1)
    return unique.select(
        "r_host", "r_path", F.coalesce("blocked", "other").alias("r_verdict"), F.size(labels).alias("level"),
        F.concat(F.array_join(F.reverse(labels), "."), F.lit("./"), "r_path").cast("binary").alias("key"),
    )


def _events(table: DataFrame, *keep: str) -> DataFrame:
    """Start (order 0, step 1) and end (order 2, step -1) of each rule's interval; urls sit between, at order 1."""
    edges = F.array(
        F.struct(F.col("key").alias("key"), F.lit(0).alias("ord"), F.lit(1).alias("step")),
        F.struct(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(2).alias("ord"), F.lit(-1).alias("step")),
    )
    return table.select(*keep, F.explode(edges).alias("e")).select(*keep, "e.*")


def _deepest(table: DataFrame) -> int:
    """Most rules that are ever on the stack at once: a sweep over the rules alone, host by host."""
    order = Window.partitionBy("r_host").orderBy("key", "ord").rowsBetween(Window.unboundedPreceding, 0)
    depth = _events(table, "r_host").select(F.sum("step").over(order).alias("depth"))
    return depth.agg(F.max("depth")).first()[0] or 0


def sweep(urls: DataFrame, table: DataFrame, levels: list[int], depth: int, cells: int) -> DataFrame:
    """Distinct ``(host, path)`` against rules: each fitting rule that is longest at its host suffix."""
    labels = F.split("host", "\\.", -1)
    keys = F.array(*[F.when(F.size(labels) >= n, canonical_key(labels, n, F.col("path"))) for n in levels])
    cell = F.pmod(F.xxhash64("host", "path"), F.lit(cells)).cast("int")
    found = F.lit(None).cast("struct<r_host:string,r_path:string,r_verdict:string>")
    items = urls.select(cell.alias("cell"), "host", "path", F.explode(keys).alias("key")).where(F.col("key").isNotNull()).select(
        "cell", "key", F.lit(1).alias("ord"), F.lit(0).alias("step"), "host", "path", found.alias("r"))
    every = F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell")
    edges = _events(table.select(F.struct("r_host", "r_path", "r_verdict").alias("r"), "key"), "r").select(
        every, "key", "ord", "step", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "r")
    order = Window.partitionBy("cell").orderBy("key", "ord").rowsBetween(Window.unboundedPreceding, 0)
    swept = items.unionByName(edges).withColumn("depth", F.sum("step").over(order))
    pushed = F.col("ord") == 0
    stack = F.array(*[F.last(F.when(pushed & (F.col("depth") == d + 1), F.col("r")), ignorenulls=True).over(order) for d in range(depth)])
    top = swept.withColumn("stack", stack).where((F.col("ord") == 1) & (F.col("depth") > 0))
    return top.select("host", "path", F.get("stack", (F.col("depth") - 1).cast("int")).alias("r"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", cell_urls: int = CELL_URLS) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; the longest fitting rule (host plus path) decides."""
    table = _rule_table(rules)
    levels = sorted(r[0] for r in table.select("level").distinct().collect())
    base = without(pages, *[c for c in ADDED if c != url])
    base = base.withColumns({"__host": url_host(F.col(f"`{url}`")), "__path": url_path(F.col(f"`{url}`"))})
    if url in ADDED:
        base = base.drop(url)
    base = base.withColumnsRenamed({"__host": "host", "__path": "path"})
    if not levels:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    n_rules, n_urls = table.count(), pages.count()
    cells = max(1, -(-n_urls // max(cell_urls, n_rules)))
    fits = sweep(base.where("host != ''").select("host", "path").distinct(), table, levels, _deepest(table), cells)
    longest = fits.groupBy("host", "path").agg(
        F.max_by("r", F.struct(F.length("r.r_host") + F.length("r.r_path"), F.length("r.r_host"))).alias("r"))
    chosen = longest.select("host", "path", F.concat("r.r_host", "r.r_path").alias("rule"), F.col("r.r_verdict").alias("verdict"))
    out = base.join(chosen, ["host", "path"], "left")
    order = [c for c in base.columns if c not in ("host", "path")]
    return out.select(*[F.col(f"`{c}`") for c in order], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
