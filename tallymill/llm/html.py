"""Main text of web pages by host consensus.

Three steps. Every page is parsed in a task and its containers are scored: text counts for its container and all above,
link text against them. From the page down, the best container is the lowest that still has all of that score; an
article that has most of it stands for it. Each page votes for the generalised path of its best container (tags and
classes, digits taken out) and Spark adds the votes per host. Pages are parsed again and their text is taken from all
containers on any of the host's winning paths; a page that has less there than half of what its own best container holds
takes that one too.

Left out: navigation, footers, asides, forms, scripts, styles, headers outside articles, and elements whose own class or
id names a notice, advert, sidebar, menu, comment section or the like. A name counts as a whole, or with words of place
and form (``ad-box``, ``site-menu``); ``with-sidebar`` says something about another element. What holds most of the
page's text is no such element, whatever its name, and a comment section is one only beside other text. Blocks end at
block tags, white space inside a block (``br`` included) becomes one space, character references are decoded.

Defined cases: NULL and empty html give an empty text; NULL urls and urls without a host vote as one host; unclosed and
cut-off markup ends where its parent or the page ends; repeated pages vote once per row and give the same text; input
columns named ``text`` or ``n_chars`` are replaced. Per host at most ten paths win, as each needs a tenth of the votes.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallymill.llm.common import kept, without
from tallymill.llm.urls import url_host

MIN_SHARE = 0.1
LINK_COST = 2.0

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|select|button|object)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-z][^>]*+(?:>|\Z)", re.S | re.I)
NAMED = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
DIGITS = re.compile(r"\d+")
PARTS = re.compile(r"[^a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body article main section div td center".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tr th caption figure figcaption header hgroup address details summary hr "
    "nav footer aside form fieldset dialog menu head".split())
SKIPPED_TAGS = frozenset("nav footer aside form fieldset dialog menu head".split())
SKIPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement adverts banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social related comment comments disqus respond "
    "footer header masthead widget pagination toolbar".split())
COMMENT_NAMES = frozenset("comment comments disqus respond".split())
# Words of place and form that leave a name what it is.
PLAIN_NAMES = frozenset("area bar block bottom box container global group holder inner item items left link links list main outer page panel right row section site slot top unit wrap wrapper".split())
CLOSES_P = BLOCKS - {"html", "body", "head"}
SAME_LEVEL = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}


class Page:
    """One parsed page: containers as nodes, and blocks as (node, text, characters in links)."""

    def __init__(self, source: str):
        self.parents, self.tags, self.paths = [-1], ["#"], [""]
        self.doubtful: dict[int, bool] = {}  # node -> whether it is a comment section
        self.blocks: list[tuple[int, str, int]] = []
        self._stack: list[tuple[str, int, bool]] = [("#", 0, False)]  # tag, container, skipped
        self._words: list[str] = []
        self._linked, self._in_link = 0, 0
        self._read(source)
        self._settle()

    def _read(self, source: str) -> None:
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at:m.start()])
            at = m.end()
            tag = m["tag"]
            if tag:
                tag = tag.lower()
                if m["end"]:
                    self._close(tag)
                else:
                    self._open(tag, m["attrs"])
        if at < len(source):
            self._text(source[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        if not self._stack[-1][2]:
            self._words.append(raw)
            if self._in_link:
                self._linked += len(raw)

    def _flush(self) -> None:
        if self._words:
            text = " ".join(references.unescape("".join(self._words)).split())
            if text:
                self.blocks.append((self._stack[-1][1], text, self._linked))
            self._words = []
        self._linked = 0

    def _open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self._text(" ")
            return
        if tag in BLOCKS:
            self._flush()
            self._in_link = 0
            closed = SAME_LEVEL.get(tag, ())
            while self._stack[-1][0] in closed or (self._stack[-1][0] == "p" and tag in CLOSES_P):
                self._stack.pop()
        if tag in VOID:
            return
        _, node, skipped = self._stack[-1]
        off = None
        if not skipped:
            in_article = any(t == "article" for t, _, _ in self._stack)
            skipped = tag in SKIPPED_TAGS or (tag == "header" and not in_article)
            if not skipped and attrs:
                off = _side_name(" ".join(a or b or c for a, b, c in NAMED.findall(attrs)).lower(), in_article)
            if off is not None and tag not in BLOCKS:
                skipped = True  # a part of a line
        if tag in BLOCKS or skipped:
            if not skipped and (tag in CONTAINERS or off is not None):
                node = self._node(node, tag, attrs)
                if off is not None:
                    self.doubtful[node] = off
            self._stack.append((tag, node, skipped))
        elif tag == "a":
            self._in_link += 1

    def _node(self, parent: int, tag: str, attrs: str) -> int:
        found = CLASS.search(attrs) if attrs else None
        classes = sorted({DIGITS.sub("", c) for c in (found[1] or found[2] or found[3] or "").lower().split()}) if found else []
        self.parents.append(parent)
        self.tags.append(tag)
        self.paths.append(f"{self.paths[parent]}>{'.'.join([tag, *filter(None, classes)])}")
        return len(self.parents) - 1

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._in_link = max(0, self._in_link - 1)
        if tag in BLOCKS:
            self._flush()
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == tag:
                self._flush()
                del self._stack[k:]
                return

    def _sums(self, value) -> list[float]:
        """Per node the sum of ``value(text, linked)`` over its blocks and those below."""
        sums = [0.0] * len(self.parents)
        for node, text, linked in self.blocks:
            sums[node] += value(text, linked)
        for k in range(len(sums) - 1, 0, -1):  # parents come before their children
            sums[self.parents[k]] += sums[k]
        return sums

    def _settle(self) -> None:
        """Takes out the blocks of elements that are aside by name, unless they are the page."""
        if not self.doubtful:
            return
        held = self._sums(lambda text, linked: len(text))
        off = [False] * len(self.parents)
        for k in range(1, len(off)):
            comments = self.doubtful.get(k)
            aside = comments is not None and (held[k] < held[0] if comments else held[k] <= held[0] / 2)
            off[k] = off[self.parents[k]] or aside
        self.blocks = [b for b in self.blocks if not off[b[0]]]

    def best(self) -> str | None:
        """Path of the best container; None without containers or text."""
        score = self._sums(lambda text, linked: max(0.0, len(text) - LINK_COST * linked))
        most = [0] * len(score)
        for k in range(1, len(score)):
            parent = self.parents[k]
            if score[k] > (score[most[parent]] if most[parent] else 0):
                most[parent] = k
        node = 0
        while most[node] and score[most[node]] == score[node]:
            node = most[node]
        if not score[node] or not (node or most[node]):
            return None
        chosen = None
        above = node
        while above > 0:
            if self.tags[above] == "article":
                chosen = above
            above = self.parents[above]
        if chosen is None:
            inside, within = self._below({node}), self._below({k for k, tag in enumerate(self.tags) if tag == "article"})
            articles = [k for k in range(1, len(score)) if self.tags[k] == "article" and inside[k] and not within[self.parents[k]]]
            if sum(score[k] for k in articles) > score[node] / 2:
                chosen = max(articles, key=lambda k: (score[k], -k))
        return self.paths[node if chosen is None else chosen] or None

    def _below(self, nodes: set[int]) -> list[bool]:
        inside = [0 in nodes]
        for k in range(1, len(self.parents)):
            inside.append(inside[self.parents[k]] or k in nodes)
        return inside

    def text(self, paths: set[str] | None) -> str:
        """Blocks below all containers on any of ``paths``; all blocks if that is None."""
        inside = self._below({0} if paths is None else {k for k in range(1, len(self.parents)) if self.paths[k] in paths})
        return "\n\n".join(text for node, text, _ in self.blocks if inside[node])


def _side_name(names: str, in_article: bool) -> bool | None:
    """None if no class or id names something beside the text, else whether it is a comment section."""
    for name in names.split():
        parts = {p for p in PARTS.split(name) if p}
        found = parts & SKIPPED_NAMES
        if in_article:
            found -= {"header", "masthead"}
        if found and parts <= SKIPPED_NAMES | PLAIN_NAMES:
            return bool(found & COMMENT_NAMES)
    return None


def _vote(pages: pa.Array) -> pa.Array:
    return pa.array([Page(p.as_py() or "").best() for p in pages], pa.string())


def _extract(pages: pa.Array, winners: pa.Array) -> pa.Array:
    texts = []
    for source, paths in zip(pages, winners):
        page = Page(source.as_py() or "")
        won, own = set(paths.as_py() or ()), page.best()
        text, alone = page.text(won), page.text(own and {own})
        if 2 * len(text) < len(alone):
            text = page.text(own and won | {own})
        texts.append(text)
    return pa.array(texts, pa.string())


def host_paths(pages: DataFrame, html: str = "html", url: str = "url", min_share: float = MIN_SHARE) -> DataFrame:
    """``(host, paths)``: each host's winning paths, most votes first, ties by path."""
    vote = F.arrow_udf(_vote, "string")
    votes = pages.select(url_host(F.col(f"`{url}`")).alias("host"), vote(F.col(f"`{html}`")).alias("path"))
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n")).where("path IS NOT NULL")
    counted = kept(counted, "path-votes")
    # Sums joined back, as a host may have any number of paths; of those that win it has few.
    total = counted.groupBy("host").agg(F.sum("n").alias("total")).withColumnRenamed("host", "__of")
    shared = counted.join(total, counted["host"].eqNullSafe(F.col("__of"))).where(F.col("n") >= F.col("total") * min_share).drop("__of", "total")
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    return shared.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def extract_main(pages: DataFrame, html: str = "html", url: str = "url", **options) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points)."""
    winners = kept(host_paths(pages, html, url, **options), "host-paths").withColumnsRenamed({"host": "__host", "paths": "__paths"})
    base = pages.withColumns({"__at": url_host(F.col(f"`{url}`")), "__html": F.col(f"`{html}`")})
    joined = base.join(winners, base["__at"] == winners["__host"], "left")
    extract = F.arrow_udf(_extract, "string")
    out = without(joined.withColumn("__main", extract("__html", "__paths")), "text", "n_chars", "__at", "__html", "__host", "__paths")
    return out.withColumn("n_chars", F.length("__main").cast("bigint")).withColumnRenamed("__main", "text")
