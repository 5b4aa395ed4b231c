"""The convolutional classifier against plain loops, on held-out rows and on odd ones."""

import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymill.llm import toxicity
from tallymill.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def plain_pool(net, text):
    words = [w for w in re.split(r"[\W\d_]+", (text or "").lower()) if w]
    own = toxicity.Words(pa.array(words, pa.string())).embed(net.table) if words else np.zeros((0, toxicity.WIDTH))
    out = []
    for w, n in toxicity.FILTERS.items():
        for f in range(n):
            sums = [net.bias[w][f] + sum(own[i + k] @ net.filters[w][k][:, f] for k in range(w) if i + k < len(words)) for i in range(len(words))]
            out.append(max(sums, default=0.0))
    return np.array(out)


@pytest.mark.parametrize("tokens", [1, 3, 7, 1 << 17])
def test_pooling_by_plain_loops(monkeypatch, tokens):
    monkeypatch.setattr(toxicity, "TOKENS", tokens)
    monkeypatch.setattr(toxicity, "EMBEDDED", max(2, tokens))
    r, random_words = np.random.default_rng(2), random.Random(3)
    net = toxicity.Network.fresh()
    net.table = r.normal(size=net.table.shape).astype(np.float32)
    net.bias = {w: r.normal(size=b.shape).astype(np.float32) for w, b in net.bias.items()}
    texts = [None, "", " 12 ", "Word", "Été ß-x", "", *[" ".join(random_words.choices(["aa", "Bb", "çç", "lorem", "x"], k=random_words.randrange(1, 9))) for _ in range(12)], None]
    words, place, size = toxicity.split_words(pa.array(texts, pa.string()))
    got, where = net.pooled(toxicity.Words(words), place, size, spots=True)
    assert np.allclose(got, [plain_pool(net, t) for t in texts], atol=1e-4)
    assert all(((at >= 0) == (size[:, None] > 0)).all() for at in where.values())


def made_docs(n, seed):
    """Toxic texts hold words of a family, ``grr`` and three further letters; held-out ones hold members that training has not."""
    r = random.Random(seed)
    plain = ["".join(r.choices("aeioulmnst", k=r.randrange(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = r.choices(plain, k=r.randrange(1, 120))
        toxic = i % 6 == 0
        if toxic:
            words[r.randrange(len(words))] = "grrzz" + "".join(r.choices("aeiou" if i % 5 else "xywvk", k=3))
        rows.append((i, " ".join(words) + r.choice(["", "!", "\n7"]), r.choice(["en", "de", None]), int(toxic)))
    return rows


def test_unseen_members_of_a_family(spark):
    rows = made_docs(1500, 4)
    docs = spark.createDataFrame([(i, t, lang, 0.7, i % 5 == 0) for i, t, lang, _ in rows], "doc_id long, text string, lang string, score double, held_out boolean")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels, ~F.col("held_out")).collect()}
    held = [(got[i]["predicted"], y) for i, _, _, y in rows if i % 5 == 0]
    hit = sum(p and y for p, y in held)
    assert hit >= 0.9 * sum(y for _, y in held) and hit >= 0.9 * sum(p for p, _ in held)
    assert all(r["predicted"] == int(r["score"] >= 0.5) and r["flagged"] == (r["score"] >= r["threshold"]) and 0 <= r["score"] <= 1 for r in got.values())
    # Language, id and source reach no score.
    other = docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id"))
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(other, labels, ~F.col("held_out")).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


@pytest.mark.parametrize("rows, lessons", [(10_000, 1), (400, 3)])
def test_every_labelled_text_is_learnt(spark, monkeypatch, rows, lessons):
    """A text teaches its word whichever lesson it falls to, and however many labelled texts there are."""
    r = random.Random(8)
    plain = ["".join(r.choices("aeioulmnst", k=r.randrange(2, 8))) for _ in range(300)]
    made = [(i, " ".join([*r.choices(plain, k=9), *([f"grr{'xyw'[i % 3]}zz"] if i % 3 == 0 else [])]), "en", int(i % 3 == 0)) for i in range(1200)]
    made += [made[0]] * 3  # equal rows count each
    docs = spark.createDataFrame([x[:3] for x in made], "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame(sorted({(x[0], x[3]) for x in made}), "doc_id long, toxic int")
    begun, tables = [], []
    deal, begin = toxicity.lessons_of, toxicity._begun
    monkeypatch.setattr(toxicity, "lessons_of", lambda examples, docs, n: tables.append((n, deal(examples, docs, n))) or tables[-1][1])
    monkeypatch.setattr(toxicity, "_begun", lambda n, *a: begun.append(n) or begin(n, *a))
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(docs, labels, F.lit(True), lesson_rows=rows).collect()}
    assert all(got[i]["predicted"] == y for i, _, _, y in made)
    (n, dealt), = tables
    held = dealt.collect()
    assert n == lessons == len(held)
    assert sorted(t for x in held for t, k in zip(x["texts"], x["copies"]) for _ in range(k)) == sorted(x[1] for x in made)
    # All rows but every tenth of a lesson were counted for the words' first values, a word once a text.
    sizes = [sum(x["copies"]) for x in held]
    learnt = len(made) - sum((k + 9) // 10 for k in sizes)
    own = toxicity.Words(pa.array(["grrxzz", "grryzz", "grrwzz"])).buckets
    assert 0 < begun[0][1][own].max() <= learnt and begun[0][1].max() >= 0.85 * sum(x[3] for x in made)
    # Neither the tasks nor the run change a score.
    again = toxicity.score_toxicity(docs.repartition(2), labels.repartition(3), F.lit(True), lesson_rows=rows).collect()
    assert {x["doc_id"]: x["score"] for x in again} == {i: x["score"] for i, x in got.items()}


def test_lessons_without_both_labels_left_out(spark):
    """Where the left-out rows of several lessons lack a label, all rows are learnt and judged."""
    docs = spark.createDataFrame([(i, "bad word" if i == 7 else f"good word {i % 5}", "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i == 7)) for i in range(60)], "doc_id long, toxic int")
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("key"), F.length("text").alias("size"), "lang", "text")
    examples = keyed.join(labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")), "id")
    net, testing = toxicity.train_lessons(toxicity.lessons_of(examples, examples, 2), 1)
    tested = [x for r in toxicity.lessons_of(examples, examples, 2).collect() for i, x in enumerate(r["labels"]) if i % 10 == 0]
    assert testing == (len(set(tested)) == 2)
    got = toxicity.score_toxicity(docs, labels, F.lit(True), lesson_rows=20).where("score is null or score < 0 or score > 1")
    assert got.isEmpty()


def test_texts_without_a_label_stay_behind(spark):
    docs = spark.range(200_000).select("id", F.xxhash64("id").alias("key"))
    few = docs.where("id % 50 = 3")
    passed = docs.where(toxicity._may_be_in(few))
    assert few.join(passed, "id", "left_anti").isEmpty() and passed.count() < 4000 * 1.05
    assert docs.where(toxicity._may_be_in(few.limit(0))).isEmpty()


def test_means_of_lessons_by_plain_loops(spark):
    """One epoch over several lessons: every number is the mean over the lessons that moved it."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdef", k=5)) for _ in range(200)]
    rows = [(i, hash_key, 5, "en", " ".join(r.choices(words, k=12)), i % 2) for i, hash_key in enumerate(r.sample(range(10**9), 90))]
    examples = spark.createDataFrame(rows, "id long, key long, size int, lang string, text string, label int")
    lessons = toxicity.lessons_of(examples, examples, 3)
    net, testing = toxicity.train_lessons(lessons, 1)
    batch = lessons.orderBy("lesson").toArrow().combine_chunks().to_batches()[0]
    parts = [toxicity.Lesson.of(batch, i, testing) for i in range(batch.num_rows)]
    counts = [np.zeros(toxicity.BUCKETS), np.zeros(toxicity.BUCKETS)]
    for x in parts:
        distinct, place, size = toxicity.split_words(x.texts)
        for k, n in enumerate(toxicity._texts_of_buckets(toxicity.Words(distinct), place, size, x.labels, np.bincount(x.docs[~x.tested], minlength=len(size)))):
            counts[k] += n
    begun = toxicity._begun(counts, np.random.default_rng(5), 5)
    moved = np.zeros((len(parts), toxicity.BUCKETS, toxicity.WIDTH))
    bias = []
    for i, x in enumerate(parts):
        own, steps = toxicity._begun(counts, np.random.default_rng(5), 5), toxicity._Adagrad()
        distinct, place, size = toxicity.split_words(x.texts)
        order = np.random.default_rng([5, 0, x.number]).permutation(x.docs[~x.tested])
        toxicity._learn(own, steps, toxicity.Words(distinct), place, size, x.labels, np.ones(len(size)), order)
        moved[i] = own.table.astype(float) - begun.table
        bias.append(own.out_bias)
    times = (np.abs(moved).sum(axis=2) > 0).sum(axis=0)
    assert len(parts) == 3 and {1, 3} <= set(times.tolist())
    want = begun.table + moved.sum(axis=0) / np.maximum(times, 1)[:, None]
    assert np.allclose(net.table, want, atol=1e-5) and np.isclose(net.out_bias, np.mean(bias), atol=1e-5)


def test_thresholds_and_calibration():
    score, y, w = np.array([0.1, 0.2, 0.2, 0.6, 0.8]), np.array([0, 0, 1, 1, 1]), np.ones(5)
    cuts = {c: 2 * y[score >= c].sum() / ((score >= c).sum() + y.sum()) for c in (0.05, 0.15, 0.4, 0.7)}
    assert cuts[toxicity_cut(cuts, toxicity.best_cut(score, y, w))] == max(cuts.values())
    assert toxicity.best_cut(score, np.zeros(5), w) == toxicity.CUT
    r = np.random.default_rng(0)
    margin = r.normal(size=20_000)
    drawn = r.random(20_000) < 1 / (1 + np.exp(-(2 * margin - 1)))
    assert np.allclose(toxicity.calibrate(margin, drawn.astype(float), np.ones(20_000)), (2, -1), atol=0.1)


def toxicity_cut(cuts, found):
    return min(cuts, key=lambda c: abs(c - found))


def test_odd_rows_and_missing_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(odd, none, F.lit(True)).collect()} == {0.5}
    one_class = spark.createDataFrame([(4, 1), (4, 1), (99, 0), (1, None)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(odd, one_class, F.lit(True)).collect()} == {0.75}
    both = spark.createDataFrame([(4, 1), (5, 0), (1, 0), (2, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd, both, F.lit(True))
    assert got.count() == odd.count() and "text" not in got.columns and got.where("score is null or score < 0 or score > 1").isEmpty()
    assert toxicity.score_toxicity(empty, both, F.lit(True)).count() == 0


def test_long_words_and_texts():
    net = toxicity.train(pa.array(["good words", "bad words"] * 30), np.array([0.0, 1.0] * 30), np.ones(60))
    margins = net.margin(pa.array(["bad " + "x" * 500_000, "good " * 300_000, "bad", None]))
    assert margins[0] > margins[1] and np.isfinite(margins).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_rows(spark):
    got = QUERIES["op13_toxicity"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = got.join(labels, "doc_id").where("held_out").select("doc_id", "predicted", "toxic").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    hit = sum(r["predicted"] and r["toxic"] for r in held)
    assert hit >= 0.8 * sum(r["toxic"] for r in held) and hit >= 0.9 * sum(r["predicted"] for r in held)
