"""Limits of the quality rules against the same limits computed in plain Python."""

import collections
import math
import random

from pyspark.sql import functions as F

from tallymill.llm import rules


def bucket_floor(value):
    """The least value that shares the bucket: exact below 32, else 16 steps per power of two."""
    if value < 32:
        return value
    step = 1 << (value.bit_length() - 5)
    return value // step * step


def blend(fine, coarse):
    total = sum(coarse.values())
    out = collections.Counter({b: float(n) for b, n in fine.items()})
    for b, n in coarse.items():
        out[b] += rules.PRIOR * n / total
    return out


def quantile(sketch, q):
    seen, total = 0.0, sum(sketch.values())
    for b in sorted(sketch):
        seen += sketch[b]
        if seen >= q * total - 1e-9:
            return b


def first_gap(sketch):
    total = sum(sketch.values())
    upto, places = 0.0, []
    for b in sorted(sketch):
        upto += sketch[b]
        if sketch[b] >= rules.EMPTY * total:
            places.append((b, upto))
    for (b, upto), (after, _) in zip(places, places[1:]):
        if after > 2 * b and total - upto <= rules.MAX_OUT * total:
            return b
    return None


def expected_limits(rows):
    names = (*rules.RATES, *rules.SURE)
    out = collections.defaultdict(dict)
    for rate in names:
        sketches = collections.defaultdict(collections.Counter)
        for lang, source, rates in rows:
            sketches[lang, source][bucket_floor(rates[rate])] += 1
        by_lang, overall = collections.defaultdict(collections.Counter), collections.Counter()
        for (lang, _), s in sketches.items():
            by_lang[lang] += s
            overall += s
        for (lang, source), s in sketches.items():
            whole = blend(s, blend(by_lang[lang], overall))
            out[lang, source][rate] = first_gap(whole) if rate in rules.SURE else 2 * quantile(whole, 0.995) - quantile(whole, 0.95)
    return out


def test_limits_by_plain_python(spark):
    r = random.Random(8)
    rows = []
    for k in range(3000):
        lang, source = r.choice(["en", "en", "de", None]), f"s{r.randrange(4)}"
        rates = {n: 0 for n in (*rules.RATES, *rules.SURE)}
        rates["upper_rate"] = int(r.gauss(18 + 4 * (lang == "de"), 3)) + 20 * (source == "s1")
        rates["dup_line_rate"] = r.choice([0] * 20 + [90, 200])
        rates["sure_upper_rate"] = max(0, rates["upper_rate"] - 9)
        if r.random() < (0.5 if source == "s3" else 0.07):
            rates["symbol_rate"] = rates["sure_symbol_rate"] = r.randrange(90, 380)
        rows.append((lang, source, rates))
    names = (*rules.RATES, *rules.SURE)
    df = spark.createDataFrame([(lang, source, False, *[x[n] for n in names]) for lang, source, x in rows],
                               "lang string, source string, base_failed boolean, " + ", ".join(f"{n} long" for n in names))
    got = {(x["lang"], x["source"]): {n: x[f"max_{n}"] for n in names} for x in rules.thresholds(rules.sketch(df, ["lang", "source"], names), "lang", "source").collect()}
    assert got == expected_limits(rows)
    # Groups have limits of their own, and what half of a source has is not cut off there.
    assert len({v["upper_rate"] for v in got.values()}) >= 3
    assert {v["sure_symbol_rate"] for (_, s), v in got.items() if s != "s3"} == {0} and all(v["sure_symbol_rate"] != 0 for (_, s), v in got.items() if s == "s3")


def test_sure_rates_ignore_a_few_events(docs):
    lines = [f"line {k} of this text" for k in range(12)]
    texts = ["\n".join([*lines, lines[0], lines[1]]), "\n".join(lines + lines), "a#b " * 3 + "word " * 40, "a#b " * 40]
    got = rules.measure(docs([(i, t, "en", "a") for i, t in enumerate(texts)]), ["doc_id"]).orderBy("doc_id").collect()
    assert [r["sure_dup_line_rate"] for r in got[:2]] == [0, math.floor(1000 * (12 - 2 * math.sqrt(12)) / 24)]
    assert got[0]["dup_line_rate"] > 0 and got[2]["symbol_rate"] > 0 and got[2]["sure_symbol_rate"] == 0 and got[3]["sure_symbol_rate"] > 100


def test_no_documents(spark):
    names = (*rules.RATES, *rules.SURE)
    df = spark.createDataFrame([], "lang string, source string, base_failed boolean, " + ", ".join(f"{n} long" for n in names))
    assert rules.thresholds(rules.sketch(df, ["lang", "source"], names), "lang", "source").collect() == []
    assert rules.judge(df, "lang", "source").where(F.col("kept")).count() == 0
