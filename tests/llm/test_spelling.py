"""Spelling variants against brute force over all pairs of words, and on odd documents."""

import collections
import random
import re
import zlib

import pytest

from tallymill.llm import spelling

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(u, v):
    u, v = sorted((u, v), key=len)
    if u == v or len(v) - len(u) > 1:
        return False
    i = 0
    while i < len(u) and u[i] == v[i]:
        i += 1
    return u[i + 1:] == v[i + 1:] if len(u) == len(v) else u[i:] == v[i + 1:]


def brute(vocabulary):
    partners = {w: [v for v in vocabulary if near(w, v)] for w in vocabulary}
    form = {}
    for w, found in partners.items():
        best = min(found, key=lambda v: (-vocabulary[v], v), default=None)
        if best is not None and vocabulary[best] >= 5 * vocabulary[w]:
            form[w] = best
    out = {}
    for w in vocabulary:
        root = w
        while root in form:
            root = form[root]
        out[w] = (w, form.get(w), root, vocabulary[w], len(partners[w]), vocabulary.get(form.get(w)))
    return out


def words_of(rows):
    n = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(FOLD)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % 199 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


@pytest.mark.parametrize("letters, part", [("ab", 5), ("ab", 60), ("abç", 5), ("abç", 10_000)])
def test_all_near_pairs(spark, letters, part):
    r = random.Random(letters + str(part))
    vocabulary = {"".join(r.choice(letters) for _ in range(r.randint(6, 12))): 5 * 6 ** r.randrange(5) for _ in range(300)}
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    got = {x["word"]: (x["n"], x["n_near"], x["form"]) for x in spelling.near_words(df, part).collect()}
    best = {w: min((v for v in vocabulary if near(w, v)), key=lambda v: (-vocabulary[v], v), default=None) for w in vocabulary}
    assert got == {w: (vocabulary[w], e[4], best[w]) for w, e in brute(vocabulary).items()}


@pytest.mark.parametrize("part", [4, 10_000])
def test_variants_of_documents(spark, part):
    r = random.Random(part)
    core = ["".join(r.choice("abcÀé") for _ in range(r.randint(6, 9))) for _ in range(12)]
    rows = []
    for i in range(300):
        text = []
        for _ in range(r.randrange(120)):
            w = r.choice(core[:3] if r.random() < 0.8 else core)
            if r.random() < 0.2:
                k = r.randrange(len(w))
                w = w[:k] + r.choice(["", "x", "yy", "Z"]) + w[k + 1:]
            text.append(w)
        rows.append((i, r.choice([" ", ", ", "1"]).join(text)))
    rows += [(None, "Abcdefg " * 9), (None, "Abcdefg " * 9), (900, None), (901, ""), (902, "x" * 90_000 + " " + "y" * 70 + " é×÷é×÷é" * 6), (903, ("q" * 3000 + " ") * 6 + ("q" * 3001 + " ") * 40)]
    docs = spark.createDataFrame([(*x, "clash", 3) for x in rows], "doc_id long, text string, word string, n long")
    expected = brute(words_of(rows))
    got = {x["word"]: tuple(x) for x in spelling.variants(docs, part_words=part).collect()}
    assert got == expected and any(e[1] for e in expected.values()) and ("q" * 3000) in got


def test_chains_of_forms(spark):
    words = {"aaaaaa" + "b" * k: 5 * 5 ** k for k in range(11)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    forms = spelling.near_words(df).where("form_n >= 5 * n").select("word", "form")
    got = {r["word"]: r["root"] for r in spelling.roots(forms, 11).collect()}
    assert got == {w: "aaaaaa" + "b" * 10 for w in words if len(w) < 16}


def test_no_words(spark, empty, odd):
    assert spelling.variants(empty).collect() == [] and spelling.variants(odd.where("doc_id < 5")).collect() == []
    assert [r["word"] for r in spelling.variants(odd).collect()] == []


def test_plain_words_are_minimised():
    words = sorted(a + b for a in ("walk", "talk", "chalk") for b in ("", "ed", "ing", "s"))
    acceptor = spelling.Acceptor(words)
    assert acceptor.size[acceptor.root] == len(words) and len(acceptor.final) < 12
    assert {(words[x], words[y]) for x, y in acceptor.near()} == {(a, b) for a in words for b in words if near(a, b) and (a < b if len(a) == len(b) else len(a) < len(b))}
