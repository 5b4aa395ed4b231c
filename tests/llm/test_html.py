"""Extraction on pages whose main text lies apart, under misleading names, or on a lesser path, and on generated pages."""

import random

import pytest

from tallymill.llm import html

LONG, MORE = "Some words of the main text. " * 22, "Further words of the same text. " * 13
SIDE = "Buy now, only today. " * 9


def extracted(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in sorted(html.extract_main(df).collect(), key=lambda r: r["page_id"])]


def p(text):
    return f"<p>{text}</p>"


def test_pages_of_the_review(spark):
    pages = [
        ("http://two.com/", f"<body><div class=a>{p(LONG)}</div><div class=b>{p(MORE)}</div></body>"),
        ("http://side.com/", f"<body><div class='content with-sidebar'>{p(LONG)}</div></body>"),
        ("http://ads.com/", f"<body class='has-ads'><div>{p(LONG)}</div></body>"),
        ("http://notice.com/", f"<article>{p(LONG)}<p class='notice-text'>{MORE}</p><p class=notice>{SIDE}</p></article>"),
        *[("http://teaser.com/", f"<body><div class=top>{p(LONG)}</div></body>")] * 3,
        *[("http://teaser.com/", f"<body><div class=top>{p('one line')}</div><div class=rest>{p(LONG)}</div></body>")] * 2,
        ("http://notice.com/whole", f"<body><div class=notice>{p(LONG)}</div><div class=ad>{p(SIDE)}</div></body>"),
        ("http://talk.com/", f"<body><div id=main>{p(SIDE)}</div><div class='comments-list'>{p(LONG)}</div></body>"),
        ("http://talk.com/only", f"<body><div class=comments>{p(LONG)}</div></body>"),
    ]
    long, more, side = LONG.strip(), MORE.strip(), SIDE.strip()
    assert extracted(spark, pages) == [
        f"{long}\n\n{more}", long, long, f"{long}\n\n{more}", *[long] * 3, *[f"one line\n\n{long}"] * 2, long, side, long]


def test_rare_template_of_a_host(spark):
    usual = f"<body><div class=promo>{p('Read on')}</div><div class=story>{p(LONG)}</div></body>"
    rare = f"<body><div class=story>{p('Short.')}</div><section class=essay>{p(MORE)}{p(LONG)}</section></body>"
    got = extracted(spark, [("http://h.com/", usual)] * 30 + [("http://h.com/x", rare)])
    assert got[0] == LONG.strip() and got[-1] == f"Short.\n\n{MORE.strip()}\n\n{LONG.strip()}"


def made_page(r):
    """A page and its main text, known from how it is made: blocks in nested containers with side matter put between."""
    words = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "ünï", "R2"]) for _ in range(n))
    kept = []

    def side():
        body = f"<p>{words(r.randrange(1, 5))}</p>"
        return r.choice([
            f"<nav><ul><li><a href='/x'>{words(2)}</a><li><a>{words(2)}</a></ul></nav>", f"<div class='ad'>{body}</div>", f"<aside>{body}</aside>",
            f"<div class=\"site-menu\">{body}</div>", f"<section id=sidebar>{body}<div>{body}</div></section>", f"<form><p>{words(2)}<input></form>",
            f"<script>if (a < b) {{ x = '<p>{words(1)}</p>' }}</script>", f"<style>p {{ }}</style>", f"<!-- <p>{words(2)}</p> -->", f"<ul class='share-links'><li>{words(1)}</ul>",
            f"<footer>{body}</footer>", "", ""])

    def block():
        parts = [words(r.randrange(4, 30)) for _ in range(r.randrange(1, 4))]
        kept.append(" ".join(parts).replace("&", "&"))
        tag = r.choice(["p", "p", "h2", "blockquote", "pre"])
        inner = r.choice(["<br>", "\n ", "<b> </b>", "<span class='with-ads'>  </span>"]).join(parts)
        return f"<{tag}>{inner}" + ("" if tag == "p" and r.random() < 0.3 else f"</{tag}>")

    def container(depth):
        inside = "".join(r.choice([block, block, side, (lambda: container(depth + 1)) if depth < 3 else block])() for _ in range(r.randrange(2, 6)))
        tag, name = r.choice(["div", "section", "div"]), r.choice(["", " class='text-2'", " class='has-sidebar'", " id=c7"])
        return f"<{tag}{name}>{inside}</{tag}>"

    body = block() + "".join(container(0) for _ in range(r.randrange(1, 4)))
    whole = r.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div id=page><div class=content>{}</div></div>"]).format(body)
    return f"<!DOCTYPE html><html><head><title>{words(2)}</title></head><body><header><h1>{words(2)}</h1></header>{side()}{whole}{side()}</body></html>", "\n\n".join(kept)


@pytest.mark.parametrize("seed", range(4))
def test_generated_pages(spark, seed):
    r = random.Random(seed)
    made = [made_page(r) for _ in range(120)]
    hosts = [f"http://h{r.randrange(6)}.org/{i}" for i in range(120)]
    assert extracted(spark, list(zip(hosts, (h for h, _ in made)))) == [t for _, t in made]


def test_odd_and_long_pages(spark):
    long = "<div>" * 3000 + p("x " * 200_000) + "</div>" * 10
    got = extracted(spark, [(None, None), (None, ""), ("http://l.com", long), ("http://l.com", "<div class=ad></div>"), ("u", "<a href=x>link</a>")])
    assert got[:2] == ["", ""] and len(got[2]) == 399_999 and got[3:] == ["", "link"]
