"""The training-data operators against brute force on small tables, and on odd rows."""

import collections
import hashlib
import math
import os
import random
import re
import sys
import time

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from tallymill.llm import decontaminate, html, lines, mixing, neardup, pii, ppm, quality, rules, urls  # noqa: E402

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/a", "allow"),
         ("net", "/es/a/b", "block"), ("net", "/es/a/b", "allow"), ("org", "", "block")]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rng_words(seed, n, vocabulary=60):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def collected(df):
    return [tuple(r) for r in df.collect()]


# --- urls

def expected_rule(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), v == "block", h + p, v) for h, p, v in listed if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


@pytest.mark.parametrize("cell", [1, 10_000])
def test_urls(spark, cell):
    r = random.Random(3)
    hosts = ["Example.com", "www.example.com", "a.www.example.com", "xexample.com", "net", "a.net", "com", "org", "b.org:80", "a..com", ""]
    made = [f"http://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en/x?y', '/es/a/b/c', '/es/a', '/es/z', '#f', '?q=/en/'])}" for _ in range(200)]
    every = [*made, None, "", "no-scheme/en/", "://", made[0], made[0]]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(every)], "page_id long, url string, rule string")
    listed = spark.createDataFrame(RULES + [(None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, listed, cell_urls=cell).collect()}
    assert got == {i: expected_rule(u, RULES) for i, u in enumerate(every)}


def test_urls_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert collected(urls.judge_urls(pages, none)) == [(1, "http://a.com/", "a.com", "/", None, "allow")]
    assert collected(urls.judge_urls(pages.where("page_id > 1"), spark.createDataFrame(RULES, "host string, path string, verdict string"))) == []


# --- quality rules

def counts_of(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    held = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(held) - len(set(held)), len(hit))


def test_rule_counts(docs):
    texts = [None, "", "  ", "a b\n\na b\n \nc", "x# <é> |", " ".join(rng_words(1, 400, 3)), " ".join("abcdefgh" * 2) + " z", " ".join("abcdefgh"),
             "\n".join([" ".join(rng_words(2, 30))] * 3)]
    got = rules.measure(docs([(i, t, "en", "a") for i, t in enumerate(texts)]), ["doc_id"]).select("doc_id", *rules.COUNTS)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {i: counts_of(t) for i, t in enumerate(texts)}


def test_sketches_merge_and_bound_quantiles(spark):
    values = [random.Random(5).randrange(100_000) for _ in range(3000)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "v long, part int").select(
        *[F.col("v").alias(r) for r in rules.RATES], "part", F.lit(False).alias("base_failed"))
    whole = rules.quantiles(rules.sketch(df, []), [])
    parts = rules.quantiles(rules.merge(rules.sketch(df, ["part"]), []), [])
    assert sorted(collected(whole)) == sorted(collected(parts))
    row = whole.first()
    for q, got in ((0.5, row["q50"]), (0.75, row["q75"])):
        exact = sorted(values)[math.ceil(q * len(values)) - 1]
        assert got <= exact <= got * 17 / 16


def test_rules_keep_clean_and_drop_junk(docs, odd, empty):
    clean = [(i, " ".join(rng_words(i, 40, 500)).capitalize(), "en", f"s{i % 2}") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "###" for w in rng_words(i, 40, 500)), "en", "s0") for i in range(20)]
    kept = rules.keep_quality(docs(clean + junk))
    assert kept.columns == docs([]).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, *_ in clean}
    assert rules.keep_quality(odd).count() == 0 and rules.keep_quality(empty).count() == 0


def test_each_rate_rejects_what_only_it_finds(docs):
    plain = lambda i, n=60: [f"q{i}x{k}" for k in range(n)]
    rows = [(i, " ".join(plain(i)), "en", "s0") for i in range(300)]
    twice = plain(900, 8)
    odd = {
        "symbol_rate": " ".join(w + "##" for w in plain(901)), "upper_rate": " ".join(plain(902)).upper(), "bang_rate": " ".join(w + "!" for w in plain(903)),
        "dup_line_rate": "\n".join(x for k in range(15) for x in (f"own{k} line", *["same words"] * (k % 3 == 0))),
        "repeat_rate": " ".join([*plain(904, 64), *twice, *plain(905, 4), *twice])}
    df = docs(rows + [(1000 + k, t, "en", "s0") for k, t in enumerate(odd.values())])
    base = rules.measure(df, ["doc_id"]).where("base_failed").count()
    assert base == 0 and {r["doc_id"] for r in rules.keep_quality(df).collect()} == set(range(300))


# --- line dedup

def test_line_dedup_round_trip_and_removal(spark, docs):
    r = random.Random(9)
    sentence = lambda: " ".join(rng_words(r.random(), r.randrange(4, 12), 5000)).capitalize() + ". "
    passage = "".join(sentence() for _ in range(9)).strip()
    block = [sentence() for _ in range(14)]
    rows = []
    for i in range(12):
        own = [sentence() + sentence() for _ in range(6)]
        body = own[:3] + ([passage] if i < 6 else []) + own[3:5] + (block if i >= 6 else []) + own[5:]
        rows.append((i, "\n".join(body), "en", "a"))
    df = docs(rows)
    whole = df.select("text", F.array_join(F.transform(lines.chunks(F.col("text")), lambda c: c["s"]), "").alias("again"))
    assert all(a == b for a, b in collected(whole))
    got = {r["doc_id"]: r for r in lines.remove_repeated(df).collect()}
    assert passage in got[0]["text"] and all(passage not in got[i]["text"] and got[i]["chars_removed"] >= len(passage) for i in range(1, 6))
    assert got[6]["n_removed"] == 0
    for i in range(7, 12):  # all of the block but what touches its ends
        assert sum(b in got[i]["text"] for b in block) <= 7
    for i, text, *_ in rows:
        own = [x for x in text.split("\n") if x != passage and x not in block]
        assert all(x in got[i]["text"] for x in own[1:2])


def test_line_dedup_removes_passages_whole(docs):
    # Passages of over 50 words: many sentences, lines, two long sentences, or one long line without a sentence end.
    r, rows, passages = random.Random(23), [], []
    text = lambda n: " ".join(f"u{r.randrange(10**7)}" for _ in range(n))
    for k in range(40):
        n = 5 + k % 6
        passages.append([" ".join(text(11) + "." for _ in range(n)), "\n".join(text(11) for _ in range(n)), f"{text(26)}. {text(26)}.", text(51)][k % 4])
    for i in range(80):
        rows.append((i, f"{text(8)}. {text(9)}.\n{text(20)}\n{passages[i % 40]}\n{text(7)}. {text(12)}\n{text(5)}", "en", "a"))
    got = {r["doc_id"]: r["text"] for r in lines.remove_repeated(docs(rows)).collect()}
    for i, t, *_ in rows:
        assert got[i] == (t if i < 40 else t.replace(passages[i % 40] + "\n", ""))


def test_line_dedup_chunks_of_short_units(spark, docs):
    # Three neighbouring lines are too short to count; only a chunk holds enough of them.
    r, text = random.Random(31), lambda: f"w{r.randrange(10**10):010d}"
    block = [text() for _ in range(120)]
    rows = [(i, "\n".join([f"own {text()} {text()} {text()} {text()} {text()} {text()} {text()}", *block, f"end {text()}"]), "en", "a") for i in range(2)]
    df = docs(rows)
    starts = [r[0] for r in df.select(lines.chunk_starts(F.transform(lines.units_of(F.col("text")), lambda s: F.xxhash64(F.btrim(s, F.lit("\n")))))).collect()]
    # From the third unit of the block on, both texts are cut at the same places.
    assert [s for s in starts[0] if 3 <= s < 119] == [s for s in starts[1] if 3 <= s < 119] and 25 < len(starts[0]) < 60
    got = {r["doc_id"]: r for r in lines.remove_repeated(df).collect()}
    assert got[0]["text"] == rows[0][1] and got[1]["n_removed"] >= 5
    assert [x for x in rows[1][1].split("\n") if x not in block] == [x for x in got[1]["text"].split("\n") if x not in block]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="a \n.!?\t\r\u00e9", max_size=40), min_size=30, max_size=60))
def test_units_end_at_lines_and_sentences(spark, texts):
    ends = re.compile(r"(?<=\n)(?!\n)|(?<=[.!?] )")
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", lines.units_of(F.col("text")))
    assert all(units == [s for s in ends.split(t) if s] for t, units in collected(df))


def test_a_text_is_cut_once_for_the_comparison(spark, docs, capsys):
    # Looking behind every character took most of the time of cutting, and units were trimmed three times over.
    df = docs([(1, "One line.\nAnother one. And more.", "en", "a")])
    lines.pieces(df, "doc_id", "text", 0).explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert "(?<" not in plan and plan.count("trim(BOTH") + plan.count("btrim") <= 1


def test_line_dedup_compares_bytes(monkeypatch, docs):
    # Under the first seed all units of one length hash alike: nothing may be cut by that.
    r = random.Random(37)
    text = lambda: "\n".join(f"{r.randrange(10**60):060d}" for _ in range(6))
    shared = text()
    rows = [(i, text() + ("\n" + shared if i in (2, 5) else ""), "en", "a") for i in range(8)]
    hashes = lines.unit_hashes
    monkeypatch.setattr(lines, "unit_hashes", lambda s, seed: (F.length(s).cast("long"),) * 2 if seed == 0 else hashes(s, seed))
    got = {r["doc_id"]: r["text"] for r in lines.remove_repeated(docs(rows)).collect()}
    assert got == {i: t if i != 5 else t.replace(shared, "") for i, t, *_ in rows}


def test_line_dedup_odd(odd, empty):
    before, after = odd.orderBy("doc_id").select("doc_id", "text"), lines.remove_repeated(odd).orderBy("doc_id").select("doc_id", "text")
    assert [r[0] for r in before.collect()] == [r[0] for r in after.collect()]
    assert lines.keep_remaining(odd).columns == odd.columns and lines.keep_remaining(empty).count() == 0


# --- near duplicates

def hash_of(text):
    words = [w for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def brute_components(points):
    label = {p: p for p in points}
    for a in points:
        for b in points:
            if (a ^ b).bit_count() <= 4:
                low, high = sorted((label[a], label[b]))
                if low != high:
                    label = {k: low if v == high else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("bucket", [4096, 2])
def test_links_lose_no_component(spark, bucket):
    r = random.Random(11)
    points = {0, (1 << 63) - 1}
    for _ in range(12):
        p = r.getrandbits(63)
        for _ in range(6):
            points.add(p)
            for bit in r.sample(range(63), r.randrange(1, 5)):
                p ^= 1 << bit
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    found = {r["node"]: r["label"] for r in neardup.components(neardup.links(df, bucket)).collect()}
    want = brute_components(sorted(points))
    assert {p: found.get(p, p) for p in points} == want


def test_near_duplicates(docs, odd, empty):
    base = rng_words(4, 300, 900)
    near = [*base[:150], "changed", *base[151:]]
    rows = [(7, " ".join(base), "en", "a"), (3, " ".join(near), "en", "a"), (9, " ".join(base).upper(), "en", "a"), (8, " ".join(rng_words(5, 300, 900)), "en", "a"), (8, "one two", "en", "a")]
    got = neardup.near_duplicates(docs(rows)).collect()
    assert {(r["doc_id"], r["fingerprint"]) for r in got} == {(i, f"{hash_of(t):016x}") for i, t, *_ in rows}
    texts = {f"{hash_of(t):016x}": i for i, t, *_ in rows}
    label = brute_components(sorted({int(k, 16) for k in texts}))
    members = collections.defaultdict(list)
    for i, t, *_ in rows:
        members[label[hash_of(t)]].append(i)
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, min(members[label[hash_of(t)]])) for i, t, *_ in rows)
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs([*rows, rows[0], rows[1]])).collect()).count(3) == 1
    assert neardup.near_duplicates(odd).count() == odd.count()
    assert {r["doc_id"] for r in neardup.keep_one(odd).collect()} == {1, 4, 5} and neardup.keep_one(empty).count() == 0


def test_keep_one_links_at_jaccard_080(docs):
    r, texts = random.Random(17), []
    for _ in range(30):
        base = [f"v{r.randrange(10**6)}" for _ in range(200)]
        copies = [list(base) for _ in range(3)]
        for words, cuts in zip(copies, (1, 3, 5)):
            for at in r.sample(range(5, 195), cuts):
                words[at] = f"x{r.randrange(10**6)}"
        texts += [" ".join(w) for w in (base, *copies)]
    # A chain, and a crowd around its least text of which some members are only similar to each other.
    step = [f"c{k}" for k in range(200)]
    texts += [" ".join(step[:200 - 12 * k] + [f"d{i}" for i in range(12 * k)]) for k in range(8)]
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    got = {r["doc_id"] for r in neardup.keep_one(docs([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert got == set(label) and len(got) < 60


def crowd(r, n, changes, fresh):
    """Copies of one text of 150 words with some words changed, each into one of ``fresh`` others."""
    base = [f"t{k}" for k in range(150)]
    texts = []
    for _ in range(n):
        words = list(base)
        for at in r.sample(range(150), r.choice(changes)):
            words[at] = f"x{r.randrange(fresh)}"
        texts.append(" ".join(words[:150 - r.randrange(12)]))
    return texts


def jaccard_labels(texts):
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("changes, fresh", [((1, 2, 3, 4, 5, 6), 3), ((2, 3, 4), 10**6), ((3, 4, 5), 2)])
def test_keep_one_in_a_crowd_loses_no_link(monkeypatch, docs, changes, fresh):
    monkeypatch.setattr(neardup, "PAIRED", 2)
    texts = crowd(random.Random(43), 150, changes, fresh)
    label = jaccard_labels(texts)
    got = {r["doc_id"] for r in neardup.keep_one(docs([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert got == set(label) and len(got) > 1


def test_a_crowd_is_not_compared_pair_by_pair(monkeypatch, docs, tmp_path):
    # Copies of one text that link to it or to none: 400 have some 50,000 pairs in different components.
    counted, similar = str(tmp_path), neardup._similar

    def counting(left, right):
        with open(f"{counted}/{os.getpid()}", "a") as f:
            f.write(f"{len(left)}\n")
        return similar(left, right)

    monkeypatch.setattr(neardup, "_similar", counting)
    texts = crowd(random.Random(47), 400, (0, 1, 4, 5), 10**9)
    neardup.keep_one(docs([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    compared = sum(int(x) for name in os.listdir(counted) for x in open(f"{counted}/{name}"))
    assert 0 < compared < 20 * len(texts)


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(k).getName()) for k in range(files.size()) if str(files.apply(k).getName()).startswith("shuffle_")}


def test_tables_on_the_way_go(spark, monkeypatch, docs):
    # What a result still reads stays, and it can be read again; the rest goes as soon as nothing reads it.
    monkeypatch.setattr(neardup, "PAIRED", 2)
    texts = crowd(random.Random(53), 60, (2, 3, 4), 10**6)
    rows, shared, found = docs([(i, t, "en", "a") for i, t in enumerate(texts)]), spark.conf.get("spark.checkpoint.dir"), {}
    for name, step in (("one", neardup.keep_one), ("copies", lambda d: neardup.drop_copies(d, d)), ("lines", lines.keep_remaining)):
        there = set(os.listdir(shared))
        result = step(rows)
        first = sorted(r["doc_id"] for r in result.collect())
        assert first == sorted(r["doc_id"] for r in result.collect())
        found[name] = first, sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - there)
    label = sorted(set(jaccard_labels(texts)))
    assert found["one"] == (label, ["chosen"]) and found["copies"] == (label, ["copies"])
    assert found["lines"][1] == ["placed", "places"]


def test_shuffle_files_go_with_the_write(spark):
    from tallymill.llm.common import CLEANUP, kept

    setting, there = spark.conf.get(CLEANUP, None), shuffle_files(spark)
    sums = spark.range(50_000).groupBy((F.col("id") % 999).alias("k")).agg(F.sum("id").alias("s"))
    out = kept(sums, "sums")
    ends = time.time() + 20
    while (left := shuffle_files(spark) - there) and time.time() < ends:
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP, None) == setting
    # The same frame written and read once more gives the same rows.
    assert sorted(collected(out)) == sorted(collected(sums)) == sorted(collected(kept(sums, "sums")))


def test_simhash_links_are_candidates(spark):
    # Two texts four bits apart and one far off: the fingerprints alone link the first two, and equal ones their least text.
    points = spark.createDataFrame([(5, 0b1111), (3, 0), (9, -1), (4, 0)], "fp long, sim long")
    assert sorted(tuple(r) for r in neardup.close_pairs(points).collect()) == [(3, 4), (3, 5)]


def test_near_copies_go_though_lines_were_cut(spark, docs, tmp_path):
    # Line dedup leaves of a near copy only the sentences that differ; the stage knows it by its whole text.
    r, rows = random.Random(41), []
    for i in range(12):
        sentences = [" ".join(f"w{r.randrange(10**6)}" for _ in range(12)) + "." for _ in range(12)]
        copy = list(sentences)
        copy[5] = copy[5].replace(" w", " other", 1)
        rows += [(i, " ".join(sentences), "en", "a"), (100 + i, " ".join(copy), "en", "a")]
    rows += [(100, " ".join(f"own{k}" for k in range(60)), "en", "a"), (None, rows[0][1], "en", "a"), rows[2]]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    whole = spark.read.parquet(str(tmp_path / "documents.parquet"))
    cut = corpus_pipeline.kept(corpus_pipeline.line_dedup(spark, whole, str(tmp_path)), "cut")
    assert sum(x["doc_id"] is not None and x["doc_id"] >= 101 for x in cut.select("doc_id").collect()) == 11
    got = corpus_pipeline.near_dedup(spark, cut, str(tmp_path))
    assert got.columns == whole.columns
    # Of id 100 one text is no copy, so that the id stays.
    assert {x["doc_id"] for x in got.collect()} == {*range(12), 100}


# --- decontamination

@pytest.mark.parametrize("block_pairs", [400_000, 7])
def test_decontamination(spark, docs, block_pairs):
    long = rng_words(6, 25, 40)
    items = [("b", " ".join(long)), ("a", "Short, item here!"), ("c", "one"), ("d", None), ("b", " ".join(long[5:20])), (None, " ".join(rng_words(8, 12, 40))), ("e", "..")]
    rows = [(1, " ".join(rng_words(1, 20) + long[3:17] + long[3:17]), "", ""), (2, "SHORT item, here; one", "", ""), (3, None, "", ""), (4, " ".join(rng_words(2, 50)), "", ""), (5, " ".join(long), "", "")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = {}
    for i, text, *_ in rows:
        words, hit, ids = word.findall((text or "").lower()), set(), set()
        for item, t in items:
            w = word.findall((t or "").lower())
            for k in range(max(1, len(w) - 9) if w else 0):
                window = w[k:k + 10]
                for at in range(len(words) - len(window) + 1):
                    if words[at:at + len(window)] == window:
                        hit |= set(range(at, at + len(window)))
                        ids.add(item or "")
        want[i] = (len(words), len(hit), len(ids), sorted(ids), bool(hit))
    got = decontaminate.find_benchmark(docs(rows), bench, block_pairs=block_pairs)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in got.collect()} == want
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs(rows), bench).collect()} == {3, 4}
    assert decontaminate.find_benchmark(docs(rows), bench.where("false")).where("contaminated").count() == 0


# --- mixing

def test_mix_budgets_and_prefixes(spark, docs, odd, empty):
    rows = [(i, " ".join(rng_words(i, 1 + i % 7)), ("en", "de", None)[i % 3], f"s{i % 5}") for i in range(400)]
    weights = {"domain": {"x": 0.7, "y": 0.3}, "lang": {"en": 0.9, "de": 0.1}}
    domain = F.when(F.col("source").isin("s0", "s1"), "x").otherwise("y")
    got = mixing.mix(docs(rows), weights, domain, max_epochs=2, seed=5, other=0.2).collect()

    def leaf(row):
        return ("x" if row[3] in ("s0", "s1") else "y", row[2], row[3])

    def fill(budget, caps, w):
        out, open_ = {}, set(caps)
        while open_:
            line = (budget - sum(out.values())) / sum(w[k] for k in open_)
            full = {k for k in open_ if caps[k] <= line * w[k]}
            if not full:
                return {**out, **{k: line * w[k] for k in open_}}
            out.update({k: caps[k] for k in full})
            open_ -= full
        return out

    tokens = collections.Counter()
    for r in rows:
        tokens[leaf(r)] += len(r[1].split())
    weight = [lambda d: weights["domain"][d], lambda x: weights["lang"].get(x, 0.2), lambda s: 0.2]
    budgets = {(): float(sum(tokens.values()))}
    for depth in range(3):
        below = {}
        for parent, budget in budgets.items():
            children = {k[:depth + 1] for k in tokens if k[:depth] == parent}
            caps = {c: 2.0 * sum(v for k, v in tokens.items() if k[:depth + 1] == c) for c in children}
            below.update(fill(budget, caps, {c: weight[depth](c[-1]) for c in children}))
        budgets = below
    by_leaf = collections.defaultdict(collections.Counter)
    for r in got:
        by_leaf[(r["domain"], r["lang"], r["source"])][r["epoch"]] += r["n_tokens"]
    for k, target in budgets.items():
        given = sum(by_leaf[k].values())
        assert given <= target + 1e-3 and given > target - 8, (k, given, target)
        assert all(v == tokens[k] for e, v in by_leaf[k].items() if e < max(by_leaf[k]))
    again = mixing.mix(docs(rows).repartition(7), weights, domain, max_epochs=2, seed=5, other=0.2).collect()
    assert sorted((r["doc_id"], r["epoch"]) for r in got) == sorted((r["doc_id"], r["epoch"]) for r in again)
    assert mixing.mix(empty, weights, domain).count() == 0
    # All tokens of the odd rows lie in one leaf, which gets the whole budget: each of its rows once.
    assert sorted(r["doc_id"] for r in mixing.mix(odd, weights, domain).collect()) == [1, 1, 4, 5]


# --- quality classifier

def test_quality(spark, docs, odd, empty):
    good = [(i, ". ".join(" ".join(rng_words(i * 31 + k, 12, 400)) for k in range(6)).capitalize(), "en", "a") for i in range(150)]
    bad = [(500 + i, " ".join(w.upper() + "!!" for w in rng_words(i, 50, 400)), "en", "a") for i in range(80)]
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad] + [(99_999, 1), (None, 0), (3, None)], "doc_id long, quality int")
    out = quality.score_quality(docs(good + bad), labels, F.col("doc_id") % 3 != 0).collect()
    assert np.mean([r["predicted"] == (r["doc_id"] < 500) for r in out if r["doc_id"] % 3 == 0]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(odd, labels, F.lit(True)).collect())
    assert {r["score"] for r in quality.score_quality(odd, labels.where("false"), F.lit(True)).collect()} == {0.5}
    assert quality.score_quality(empty, labels, F.lit(True)).count() == 0


# --- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    def fine(kind, s):
        n = re.sub("[^0-9]", "", s)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "card": lambda: 13 <= len(n) <= 19 and luhn(n), "phone": lambda: 9 <= len(n) <= 15}[kind]()
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if fine(k, m.group()))


def test_pii_base(docs, odd):
    r = random.Random(2)
    bits = ["a@b.c", "@", "x.y@z", "1.2.3.4", "256.1.1.1", "000255.1.1.1.9", "4539 1488 0343 6467", "4539148803436467", "79927398713", "+1 (555) 010-9999", "+1", "é", " ", ".", "-", "😀", "a", "7", "+", "\n"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", ""]) for _ in range(25)) for _ in range(150)] + ["1 " * 40_000, "9" * 50_000, "a" * 50_000]
    got = {x["doc_id"]: x for x in pii.find_pii(docs([(i, t, "", "") for i, t in enumerate(texts)]), min_seeds=10 ** 9).collect()}
    for i, t in enumerate(texts):
        assert got[i]["spans"] == plain_spans(t), t
        assert got[i]["base_sha256"] == hashlib.sha256(plain_spans(t).encode()).hexdigest()
    assert pii.find_pii(odd).where("spans <> ''").count() == 0


def test_pii_contexts_find_unseen(docs):
    rows = [(i, f"Please call phone: +1 (555) 010-{1000 + i} about {i} items today", "", "") for i in range(30)] + [(100, "my phone: 555 0134 98765 or so", "", ""), (101, "about 5550134 items", "", "")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs(rows)).collect()}
    assert got[100] == "phone:10:24" and got[101] == "" and got[0].count("phone:") == 1


# --- language model

def test_ppm_is_a_distribution_and_learns(spark, docs, odd, empty):
    rows = [(i, " ".join(rng_words(i, 60, 30)), "", "") for i in range(60)]
    got = {r["doc_id"]: r for r in ppm.score_texts(docs(rows), F.col("doc_id") % 5 == 0).collect()}
    counts = collections.Counter(w for i, t, *_ in rows if i % 5 for w in [*t.split(), ""])
    n, v = sum(counts.values()), len(counts)
    for i, t, *_ in rows:
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*t.split(), ""])
        assert got[i]["base_score"] == pytest.approx(want) and got[i]["train_tokens"] == n and got[i]["held_out"] == (i % 5 == 0)
        assert got[i]["score"] > -math.log10(255) * len(t) / 2
    assert ppm.score_texts(odd, F.lit(False)).count() == odd.count() and ppm.score_texts(empty, F.lit(False)).count() == 0
    untrained = ppm.score_texts(docs([(1, "ab", "", "")]), F.lit(True)).first()
    assert untrained["base_score"] is None and untrained["score"] == pytest.approx(-3 * math.log10(255))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(max_size=30), min_size=1, max_size=8), st.binary(max_size=8))
def test_trie_probabilities_sum_to_one(texts, context):
    texts = [t.replace(b"\xff", b"").replace(b"\xfe", b"") for t in texts]
    data, _ = ppm.framed(texts)
    got = ppm.runs(data, ppm.ORDER, len(data))
    got = got[(got & 0xFF) != ppm.START]
    size, run, n = [], [], []
    for k in range(1, ppm.ORDER + 2):
        keys, counts = np.unique(got & ((1 << 8 * k) - 1), return_counts=True)
        keep = counts >= 2 if len(texts) > 3 else counts >= 1
        size.append(np.full(keep.sum(), k)), run.append(keys[keep]), n.append(counts[keep])
    trie = ppm.Trie(np.concatenate(size), np.concatenate(run), np.concatenate(n))
    frame, _ = ppm.framed([context.replace(b"\xff", b"").replace(b"\xfe", b"")])
    last = int(ppm.runs(frame, len(frame) - 1, len(frame))[0]) & ~0xFF
    total = (10 ** trie.log_probability(np.array([last | s for s in range(256) if s != ppm.START]))).sum()
    assert total == pytest.approx(1.0, abs=1e-6)


@pytest.mark.parametrize("part_bytes", [1 << 24, 300])
def test_ppm_keeps_rare_runs_in_a_large_corpus(docs, part_bytes):
    # The rare runs have one count in over 2**19 positions; what the whole trie says of every byte is the truth.
    rows = [(2, "zyx qvj", "", ""), (3, "the zyx qvj", "", ""), *[(10 + i, " ".join(rng_words(i, 40, 9)), "", "") for i in range(6)], (1, "aaaa bbbb " * 60_000, "", "")]
    training = [t.encode() for i, t, *_ in rows if i != 3]
    sizes = [(k, *ppm.count_runs(training, k)) for k in range(1, ppm.ORDER + 2)]
    trie = ppm.Trie(np.concatenate([np.full(len(r), k) for k, r, _ in sizes]), np.concatenate([r for _, r, _ in sizes]), np.concatenate([n for *_, n in sizes]))
    got = {r["doc_id"]: r["score"] for r in ppm.score_texts(docs(rows), F.col("doc_id") == 3, part_bytes=part_bytes).collect()}
    want = ppm.text_scores([t.encode() for _, t, *_ in rows], trie.log_probability)
    assert got == {i: pytest.approx(w) for (i, *_), w in zip(rows, want)}
    assert got[2] > -8  # seven bytes and the end, most of them sure after the first; about -20 without the rare runs


# --- html

def test_html(spark):
    page = lambda body: f"<html><head><title>t</title></head><body><header>Site</header><nav><a href=x>Menu</a></nav>{body}<footer>f</footer></body></html>"
    pages = [
        (1, "http://a.com/1", page("<div class='post-12'><h1>Title &amp; more</h1><p>First  block of\n text &lt;ok&gt;<p>Second<br>line<script>var x='</p>'</script></div><div class='comments'><p>" + "noise " * 200 + "</p></div>")),
        (2, "http://a.com/2", page("<div class='post-7'><p>Tiny</p></div><aside><p>" + "side " * 100 + "</p></aside>")),
        (3, "http://b.com/", "<article><p>Cut off &mdash; mid"), (4, None, None), (5, "x", ""), (6, "http://a.com/1", "plain a < b words"), (3, "http://b.com/", "<article><p>Cut off &mdash; mid"),
    ]
    df = spark.createDataFrame([(*p, "old") for p in pages], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract_main(df).collect())
    texts = [(1, "Title & more\n\nFirst block of text <ok>\n\nSecond line"), (2, "Tiny"), (3, "Cut off — mid"), (3, "Cut off — mid"), (4, ""), (5, ""), (6, "plain a < b words")]
    assert got == [(i, t, len(t)) for i, t in texts]
    assert html.extract_main(df.where("false")).count() == 0
