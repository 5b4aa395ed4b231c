"""Toxicity: a convolutional text classifier over hashed word embeddings, with thresholds calibrated by language.

A word's embedding is the mean of hashed vectors of itself and of its pieces of a few bytes (with marks at both ends),
so unseen words of a known family are placed near it. Filters of several widths run over all words of the text, each
takes its maximum over the text, and a logistic layer reads the maxima. The network is trained in numpy with Adagrad:
only the words at the maxima move, with the vectors of their pieces. The first number of a vector starts at the smoothed
log-odds of its bucket in texts of either class, so the first maxima already stand where the classes differ; buckets that
no training text has stay zero, so unknown words are silent however long the text is.

Training reads every labelled text that may be used. The texts are dealt by a hash of id and text to lessons of at least
``LESSON_CHARS`` characters or ``LESSON_ROWS`` rows. One lesson is learnt on the driver. Several are learnt side by side, in tasks: the log-odds
are counted over all of them, and after each epoch the networks (and Adagrad's sums) become one, the mean over the lessons that moved
a number. The means are taken of whole numbers, so that their order plays no part. Every tenth text of a lesson is left out of training: there
the scores get a logistic recalibration, and every language its threshold, the one that gives
the most F1. A language's threshold is drawn towards the common one by how few of its positives were seen.

Scoring is one pass over Arrow batches: words are split and encoded as a dictionary, each distinct word is taken through
the embedding and all filters once, and texts add up shifted filter rows in slices, so a text of any length takes a
bounded buffer besides itself. Neither labels nor language, source or id reach the score.

Defined cases: NULL and empty texts have no word and get a score; labels without a document, NULL labels and NULL
texts' labels count in the class shares only if the document exists; several labels of one document all count; without
labels of both classes every score is the share of label 1 (one half without any) and thresholds are one half; repeated
rows get equal scores; input columns named like an added one are replaced.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymill.llm.common import kept, without

BUCKETS = 1 << 15
WIDTH = 12  # numbers per hashed vector
FILTERS = {1: 8, 2: 6, 3: 6}  # words per window -> filters
PIECES = (4, 5)  # bytes per piece, marks included
LESSON_ROWS = 6_000
LESSON_CHARS = 12 << 20
EPOCHS = 3
BATCH_DOCS = 48
RATE = 0.05
LEFT_OUT = 0.1
CUT = 0.5
TOKENS = 1 << 17  # words that are looked at together
EMBEDDED = 1 << 15
SLICE = 8 << 20  # bytes of texts that are split into words together
VALUE_UNIT, SUM_UNIT = 2.0 ** 32, 2.0 ** 24  # what lessons moved is added up in whole numbers of these parts
EXACT_MARGINS = 100_000  # beyond so many judged texts their margins are counted in steps of ``MARGIN_STEP``
MARGIN_STEP = 2.0 ** -12
FEW_BITS, MOST_BITS = 22, 27  # powers of two: the table of bits by which labelled texts are told from others
PRIOR_POSITIVES = 20.0
SMOOTH = 4.0


class Words:
    """Distinct words with the hashed places of their pieces, one after the other."""

    def __init__(self, words: pa.Array):
        marked = pc.binary_join_element_wise("<", words.cast(pa.string()), ">", "") if len(words) else pa.array([], pa.string())
        data = np.frombuffer("".join(marked.to_pylist()).encode(), dtype=np.uint8).astype(np.uint64)
        size = pc.binary_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        left = np.repeat(start + size, size) - np.arange(len(data))  # bytes from here to the word's end
        # The hash of a whole word is a sum over its bytes, each by its place.
        place = (np.arange(len(data)) - np.repeat(start, size)).astype(np.uint64)
        mixed = self._mix(data * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xC2B2AE3D27D4EB4F))
        whole = np.add.reduceat(mixed, start) if len(size) else np.empty(0, np.uint64)
        owners, hashes = [np.arange(len(size))], [self._mix(whole)]
        for n in PIECES:
            at = np.flatnonzero(left >= n)
            got = np.zeros(len(at), dtype=np.uint64)
            for k in range(n):
                got = got * np.uint64(0x100000001B3) + data[at + k] + np.uint64(1)
            owners.append(owner[at])
            hashes.append(self._mix(got + np.uint64(n)))
        owner, hashed = np.concatenate(owners), np.concatenate(hashes)
        order = np.argsort(owner, kind="stable")
        self.buckets = (hashed[order] % np.uint64(BUCKETS)).astype(np.int64)
        self.count = np.bincount(owner, minlength=len(size))
        self.start = np.cumsum(self.count) - self.count

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    def embed(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.count), table.shape[1]), dtype=np.float32)
        for a in range(0, len(self.count), EMBEDDED):
            b = min(a + EMBEDDED, len(self.count))
            held = self.buckets[self.start[a]:self.start[b - 1] + self.count[b - 1]]
            out[a:b] = np.add.reduceat(table[held], self.start[a:b] - self.start[a], axis=0) / self.count[a:b, None]
        return out

    @classmethod
    def in_slices(cls, words: pa.Array) -> Words:
        """The same for many words, whose bytes are hashed a slice at a time."""
        parts = [cls(words[a:a + EMBEDDED]) for a in range(0, max(1, len(words)), EMBEDDED)]
        return cls._of(np.concatenate([x.buckets.astype(np.int32) for x in parts]), np.concatenate([x.count for x in parts]))

    @classmethod
    def _of(cls, buckets: np.ndarray, count: np.ndarray) -> Words:
        out = cls.__new__(cls)
        out.buckets, out.count, out.start = buckets, count, np.cumsum(count) - count
        return out

    def some(self, chosen: np.ndarray) -> Words:
        """The chosen words alone."""
        return self._of(self.pieces(chosen)[0], self.count[chosen])

    def pieces(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the chosen words, and to which of them (by position) each belongs."""
        n = self.count[chosen]
        owner = np.repeat(np.arange(len(chosen)), n)
        return self.buckets[np.repeat(self.start[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())], owner


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words (runs of letters), the word at every place, and the number of places of each text."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+")
    flat = lists.flatten()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    held = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(size)), size)[held]
    coded = flat.filter(pa.array(held)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.bincount(doc, minlength=len(size))


@dataclass
class Network:
    """Hashed vectors, filters and the logistic layer; ``shift`` and ``slope`` recalibrate, ``constant`` replaces all."""

    table: np.ndarray | None = None
    filters: dict[int, np.ndarray] = field(default_factory=dict)
    bias: dict[int, np.ndarray] = field(default_factory=dict)
    out: np.ndarray | None = None
    out_bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    @classmethod
    def fresh(cls, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        filters = {w: r.normal(0, 1 / np.sqrt(WIDTH * w), (w, WIDTH, n)).astype(np.float32) for w, n in FILTERS.items()}
        for each in filters.values():
            each[:, 0, :] = 0.5 + 0.2 * np.abs(each[:, 0, :])  # all begin by reading the log-odds
        total = sum(FILTERS.values())
        return cls(np.zeros((BUCKETS, WIDTH), np.float32), filters, {w: np.zeros(n, np.float32) for w, n in FILTERS.items()},
                   np.full(total, 2.0 / total, np.float32), -2.0)

    def pooled(self, words: Words, place: np.ndarray, size: np.ndarray, spots: bool = False, vectors: np.ndarray | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Per text the maximum of every filter (zero without words), and with ``spots`` where it stands, or -1.

        A window that reaches over a text's end reads zeros there. ``vectors`` are the words' own, if they are known already.
        """
        vectors = words.embed(self.table) if vectors is None else vectors
        best = {w: np.where(size[:, None] > 0, np.float32(-np.inf), np.float32(0)).repeat(n, axis=1) for w, n in FILTERS.items()}
        where = {w: np.full((len(size), n), -1, np.int64) for w, n in FILTERS.items()}
        rows = {w: [vectors @ self.filters[w][k] for k in range(w)] for w in FILTERS}
        ends = np.cumsum(size)
        for begin in range(0, len(place), TOKENS):
            stop = min(begin + TOKENS, len(place))
            first = int(np.searchsorted(ends, begin, side="right"))
            last = int(np.searchsorted(ends, stop - 1, side="right"))
            cuts = np.maximum(ends[first:last + 1] - size[first:last + 1], begin)
            docs = first + np.flatnonzero(np.minimum(ends[first:last + 1], stop) > cuts)
            cuts = cuts[docs - first] - begin
            # Words from a place to its text's end.
            left = np.repeat(ends[docs], np.diff(np.append(cuts, stop - begin))) - np.arange(begin, stop)
            for w in FILTERS:
                got = rows[w][0][place[begin:stop]] + self.bias[w]
                for k in range(1, w):
                    inside = np.flatnonzero(left > k)
                    got[inside] += rows[w][k][place[begin + inside + k]]
                top = np.maximum.reduceat(got, cuts, axis=0)
                better = top > best[w][docs]
                if spots:
                    span = np.diff(np.append(cuts, stop - begin))
                    f, spot = np.nonzero((got == np.repeat(top, span, axis=0)).T)
                    d = np.repeat(np.arange(len(docs)), span)[spot]
                    # The first place of each filter and text.
                    first_place = np.append(True, (np.diff(f) != 0) | (np.diff(d) != 0))[:len(f)] & better[d, f]
                    where[w][docs[d[first_place]], f[first_place]] = begin + spot[first_place]
                best[w][docs] = np.maximum(best[w][docs], top)
        return np.concatenate([best[w] for w in FILTERS], axis=1), where

    def margin(self, texts: pa.Array) -> np.ndarray:
        words, place, size = split_words(texts)
        return self.pooled(Words(words), place, size)[0] @ self.out + self.out_bias

    def margins(self, texts: pa.Array) -> np.ndarray:
        """``margin`` of many texts, a slice at a time."""
        widths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        begin, out = 0, [np.empty(0, np.float32)]
        while begin < len(texts):
            before = widths[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(widths, before + SLICE, side="right")))
            out.append(self.margin(texts[begin:stop]))
            begin = stop
        return np.concatenate(out)

    def score(self, margin: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(margin), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


class _Adagrad:
    def __init__(self):
        self.sums: dict[str, np.ndarray] = {}

    def move(self, name: str, value: np.ndarray, gradient: np.ndarray, at=slice(None)) -> None:
        total = self.sums.setdefault(name, np.full_like(value, 1e-2))
        total[at] += gradient * gradient
        value[at] -= RATE * gradient / np.sqrt(total[at])


def _texts_of_buckets(words: Words, place: np.ndarray, size: np.ndarray, labels: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
    """For labels 0 and 1 how often words of each bucket are in texts, a word once a text; texts count ``times``."""
    doc = np.repeat(np.arange(len(size)), size)
    held = np.unique(doc * max(1, len(words.count)) + place)
    doc, word = held // max(1, len(words.count)), held % max(1, len(words.count))
    owner, n = np.repeat(np.arange(len(words.count)), words.count), []
    for k in (0, 1):
        own = labels[doc] == k
        texts = np.bincount(word[own], weights=times[doc[own]], minlength=len(words.count))
        n.append(np.bincount(words.buckets, weights=texts[owner], minlength=BUCKETS))
    return n


def _log_odds(n: list[np.ndarray]) -> np.ndarray:
    """Per bucket the smoothed log-odds of its words between texts of label 1 and 0; zero if unseen."""
    seen = n[0] + n[1] > 0
    share = [(x + SMOOTH) / (x.sum() + SMOOTH * max(1, seen.sum())) for x in n]
    return np.where(seen, np.log(share[1] / share[0]), 0.0).astype(np.float32)


def _begun(n: list[np.ndarray], r: np.random.Generator, seed: int) -> Network:
    """A network before its first step, from the counts of ``_texts_of_buckets``."""
    net = Network.fresh(seed)
    net.table[:, 0] = _log_odds(n)
    seen = net.table[:, 0] != 0
    net.table[seen, 1:] = r.normal(0, 0.05, (int(seen.sum()), WIDTH - 1))
    return net


def _learn(net: Network, steps: _Adagrad, words: Words, place: np.ndarray, size: np.ndarray, labels: np.ndarray, weights: np.ndarray, order: np.ndarray) -> None:
    """Moves the network by the texts in ``order``, ``BATCH_DOCS`` at a step."""
    ends = np.cumsum(size)
    for b in range(0, len(order), BATCH_DOCS):
        docs = order[b:b + BATCH_DOCS]
        spot = np.concatenate([np.arange(ends[d] - size[d], ends[d]) for d in docs])
        ids, at = np.unique(place[spot], return_inverse=True)
        held, width = words.some(ids), size[docs]
        vectors, ends_here, offset = held.embed(net.table), np.cumsum(width), 0
        features, where = net.pooled(held, at, width, spots=True, vectors=vectors)
        p = 1 / (1 + np.exp(-np.clip(features @ net.out + net.out_bias, -60, 60)))
        error = ((p - labels[docs]) * weights[docs] / weights[docs].sum() * 8).astype(np.float32)
        back = error[:, None] * net.out
        steps.move("out", net.out, features.T @ error + 1e-4 * net.out)
        bias = np.array([net.out_bias], np.float32)
        steps.move("out_bias", bias, np.array([error.sum()], np.float32))
        net.out_bias = float(bias[0])
        pull = np.zeros_like(vectors)
        for w, n in FILTERS.items():
            d, f = np.nonzero(where[w] >= 0)
            spots, g = where[w][d, f], back[d, offset + f]
            change, bias = np.zeros_like(net.filters[w]), np.zeros(n, np.float32)
            np.add.at(bias, f, g)
            for k in range(w):
                inside = spots + k < ends_here[d]
                word = at[np.minimum(spots + k, len(at) - 1)]
                np.add.at(change[k].T, f[inside], g[inside, None] * vectors[word[inside]])
                np.add.at(pull, word[inside], g[inside, None] * net.filters[w][k].T[f[inside]])
            steps.move(f"filter{w}", net.filters[w], change + 1e-4 * net.filters[w])
            steps.move(f"bias{w}", net.bias[w], bias)
            offset += n
        moved = np.flatnonzero(np.abs(pull).any(axis=1))
        buckets, owner = held.pieces(moved)
        if len(buckets):
            unique, slot = np.unique(buckets, return_inverse=True)
            gradient = np.zeros((len(unique), WIDTH), np.float32)
            np.add.at(gradient, slot, (pull[moved] / held.count[moved, None])[owner])
            steps.move("table", net.table, gradient, unique)


def train(texts: pa.Array, labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Fits a network to texts with labels 0 and 1."""
    steps, r = _Adagrad(), np.random.default_rng(seed)
    distinct, place, size = split_words(texts)
    words = Words.in_slices(distinct)
    net = _begun(_texts_of_buckets(words, place, size, labels, np.ones(len(texts))), r, seed)
    for _ in range(epochs):
        _learn(net, steps, words, place, size, labels, weights, r.permutation(len(texts)))
    return net


@dataclass
class Lesson:
    """Texts that are learnt one after the other; ``docs`` has the place of each row's text, equal rows one by one."""

    number: int
    texts: pa.Array
    labels: np.ndarray
    langs: pa.Array
    docs: np.ndarray
    tested: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int, testing: bool) -> Lesson:
        part = {name: batch.column(name)[i] for name in ("texts", "labels", "langs", "copies")}
        docs = np.repeat(np.arange(len(part["texts"])), part["copies"].values.to_numpy(zero_copy_only=False))
        tested = (np.arange(len(docs)) % round(1 / LEFT_OUT) == 0) & testing
        labels = part["labels"].values.to_numpy(zero_copy_only=False).astype(np.float64)
        return cls(batch.column("lesson")[i].as_py(), part["texts"].values, labels, part["langs"].values, docs, tested)


COUNTS = "place int, n0 bigint, n1 bigint"
MOVES = ", ".join(["place int", "n bigint", *[f"v{i} bigint" for i in range(WIDTH)], *[f"s{i} bigint" for i in range(WIDTH)]])
MARGINS = "lang {}, label int, margin double, n bigint"


def _may_be_in(examples: DataFrame) -> Column:
    """Whether a row's ``key`` may be one of ``examples``: two bits of a bounded table stand for each; few other rows pass."""
    size = 1 << min(MOST_BITS, max(FEW_BITS, (32 * examples.count()).bit_length()))
    spots = [F.pmod("key", F.lit(size)), F.pmod(F.shiftrightunsigned("key", 32), F.lit(size))]
    spotted = examples.select(F.explode(F.array(*spots)).alias("spot")).groupBy(F.expr("spot DIV 64").alias("word"))
    words = spotted.agg(F.bit_or(F.expr("shiftleft(1L, CAST(spot % 64 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    table = examples.sparkSession.createDataFrame([(bits.tolist(),)], "bits array<bigint>").scalar()
    return F.getbit(F.get(table, (spots[0] / 64).cast("int")), spots[0] % 64) + F.getbit(F.get(table, (spots[1] / 64).cast("int")), spots[1] % 64) == 2


def lessons_of(examples: DataFrame, docs: DataFrame, lessons: int) -> DataFrame:
    """One row a lesson, its texts in the order of key, id and label; ``examples`` and ``docs`` as in ``fit``."""
    labelled = examples.groupBy("id", "key", "label", "lang").agg(F.count(F.lit(1)).alias("copies"))
    # Labels and texts go to their lesson by the key that both have: labelled texts move once, and hardly any others.
    rows = docs.where(F.col("id").isNotNull() & _may_be_in(examples)).select("id", "key", "text").unionByName(labelled, allowMissingColumns=True)
    dealt = rows.withColumn("lesson", F.pmod("key", F.lit(lessons)).cast("int")).repartition(lessons, "lesson")
    met = Window.partitionBy("lesson", "key", "id").orderBy(F.col("label").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = dealt.withColumn("text", F.first("text", ignorenulls=True).over(met)).where("label IS NOT NULL")
    row = F.struct("key", F.col("id").cast("string").alias("id"), "label", "lang", "copies", F.coalesce("text", F.lit("")).alias("text"))
    held = one.groupBy("lesson").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return held.select("lesson", *[F.col(f"rows.{c}").alias(f"{c}s") for c in ("text", "label", "lang")], F.col("rows.copies").alias("copies"))


def _each_lesson(lessons: DataFrame, testing: bool, body: Callable[[Lesson], list], schema: str) -> DataFrame:
    """What ``body`` makes of every lesson, as columns of ``schema``."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays(body(Lesson.of(batch, i, testing)), names)

    return lessons.mapInArrow(run, schema)


def _counted(lesson: Lesson) -> list:
    """Texts by bucket and label, and under place -1 the left-out rows by label."""
    distinct, place, size = split_words(lesson.texts)
    n = _texts_of_buckets(Words.in_slices(distinct), place, size, lesson.labels, np.bincount(lesson.docs[~lesson.tested], minlength=len(size)))
    seen = np.flatnonzero(n[0] + n[1])
    tested = lesson.labels[lesson.docs[lesson.tested]]
    return [pa.array(np.append(seen, -1), pa.int32()), *[pa.array(np.append(x[seen], (tested == k).sum()).astype(np.int64)) for k, x in enumerate(n)]]


def _parts(net: Network, steps: _Adagrad) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """All numbers of a network by name, and Adagrad's sums of them."""
    values = {"table": net.table, "out": net.out, "out_bias": np.array([net.out_bias], np.float32)}
    values |= {f"filter{w}": x for w, x in net.filters.items()} | {f"bias{w}": x for w, x in net.bias.items()}
    return values, {name: steps.sums.get(name, np.full_like(x, 1e-2)) for name, x in values.items()}


def _flat(parts: dict[str, np.ndarray]) -> np.ndarray:
    """The table's rows, then the other numbers in rows as wide."""
    rest = np.concatenate([x.ravel() for name, x in parts.items() if name != "table"])
    return np.concatenate([parts["table"], np.pad(rest, (0, -len(rest) % WIDTH)).reshape(-1, WIDTH)]).astype(np.float64)


def _unflat(rows: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, rest, at = {"table": rows[:BUCKETS].astype(np.float32)}, rows[BUCKETS:].ravel(), 0
    for name, x in like.items():
        if name != "table":
            out[name], at = rest[at:at + x.size].reshape(x.shape).astype(np.float32), at + x.size
    return out


def _learner(net: Network, steps: _Adagrad, seed: tuple[int, ...]):
    """What one epoch over a lesson moves."""
    def learn(lesson: Lesson) -> list:
        own, own_steps = copy.deepcopy((net, steps))
        distinct, place, size = split_words(lesson.texts)
        order = np.random.default_rng([*seed, lesson.number]).permutation(lesson.docs[~lesson.tested])
        _learn(own, own_steps, Words.in_slices(distinct), place, size, lesson.labels, np.ones(len(size)), order)
        before, after = [[_flat(x) for x in _parts(*state)] for state in ((net, steps), (own, own_steps))]
        # A number that no step of the lesson reached has no part in its mean; Adagrad's sums tell, as they grow with every step.
        moved = np.flatnonzero((after[1] != before[1]).any(axis=1) | (after[0] != before[0]).any(axis=1))
        whole = [np.rint((b - a)[moved] * unit).astype(np.int64) for a, b, unit in zip(before, after, (VALUE_UNIT, SUM_UNIT))]
        return [pa.array(moved, pa.int32()), pa.array(np.ones(len(moved), np.int64)), *[pa.array(x[:, i]) for x in whole for i in range(WIDTH)]]

    return learn


def train_lessons(lessons: DataFrame, epochs: int = EPOCHS, seed: int = 5) -> tuple[Network, bool]:
    """Fits one network to all lessons, and says whether rows were left out of it (they are if both labels are among them)."""
    for testing in (True, False):
        counted = _each_lesson(lessons, testing, _counted, COUNTS).groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
        place, n = counted["place"].to_numpy(), [counted[c].to_numpy() for c in ("n0", "n1")]
        if all(x[place < 0].sum() for x in n):
            break
    held = place >= 0
    net, steps = _begun([np.bincount(place[held], weights=x[held], minlength=BUCKETS) for x in n], np.random.default_rng(seed), seed), _Adagrad()
    for epoch in range(epochs):
        sums = [F.sum(c).alias(c) for c in ["n", *[f"{k}{i}" for k in "vs" for i in range(WIDTH)]]]
        moves = _each_lesson(lessons, testing, _learner(net, steps, (seed, epoch)), MOVES).groupBy("place").agg(*sums).toArrow()
        place, times = moves["place"].to_numpy(), moves["n"].to_numpy()[:, None]
        states = []
        for kind, parts, unit in zip("vs", _parts(net, steps), (VALUE_UNIT, SUM_UNIT)):
            rows = _flat(parts)
            rows[place] += np.column_stack([moves[f"{kind}{i}"].to_numpy() for i in range(WIDTH)]) / unit / times
            states.append(_unflat(rows, parts))
        values, steps.sums = states
        net = Network(values["table"], {w: values[f"filter{w}"] for w in FILTERS}, {w: values[f"bias{w}"] for w in FILTERS}, values["out"], float(values["out_bias"][0]))
    return net, testing


def _judge(net: Network, step: float | None):
    """Margins of the rows that were left out, of all rows if none were."""
    def judge(lesson: Lesson) -> list:
        rows = lesson.docs[lesson.tested] if lesson.tested.any() else lesson.docs
        docs, n = np.unique(rows, return_counts=True)
        margin = net.margins(lesson.texts.take(pa.array(docs))).astype(np.float64)
        margin = np.rint(margin / step) * step if step else margin
        return [lesson.langs.take(pa.array(docs)), pa.array(lesson.labels[docs].astype(np.int32)), pa.array(margin), pa.array(n)]

    return judge


def calibrate(margin: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic regression on the margin, by Newton's steps with a slight pull to (1, 0)."""
    x, at = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -60, 60)))
        slope = x.T @ (weights * (p - labels)) + 0.5 * (at - [1.0, 0.0])
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        at = at - np.clip(step, -2, 2)
    return float(at[0]), float(at[1])


def best_cut(score: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The threshold of the greatest weighted F1, half-way to the next lower score; ``CUT`` without positives."""
    if not labels.any():
        return CUT
    order = np.argsort(-score, kind="stable")
    hit, taken = np.cumsum((labels * weights)[order]), np.cumsum(weights[order])
    last = np.append(np.diff(score[order]) != 0, True)  # equal scores are taken together
    f1 = np.where(last, 2 * hit / (taken + (labels * weights).sum()), -1)
    k = int(np.argmax(f1))
    above = score[order[k]]
    return float((above + (score[order[k + 1]] if k + 1 < len(order) else 0.0)) / 2)


@dataclass
class Model:
    network: Network
    cut: float = CUT
    cuts: dict[str | None, float] = field(default_factory=dict)


def fit(examples: DataFrame, docs: DataFrame, lesson_rows: int = LESSON_ROWS, lesson_chars: int = LESSON_CHARS, epochs: int = EPOCHS) -> Model:
    """Learns from all rows of ``examples``.

    ``examples`` is a written table (id, key, size, label, lang) without texts,
    ``docs`` has (id, key, text); a key is a hash of id and text.
    """
    count = {r["label"]: r for r in examples.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()}
    total = sum(r["n"] for r in count.values())
    if len(count) < 2:
        return Model(Network(constant=((count[1]["n"] if 1 in count else 0) + 1) / (total + 2)))
    # Rounded down: a lesson of few texts has few steps between two means.
    parts = max(1, total // lesson_rows, sum(r["size"] for r in count.values()) // lesson_chars)
    lessons = kept(lessons_of(examples, docs, parts), "lessons")
    if parts == 1:
        lesson = Lesson.of(lessons.toArrow().combine_chunks().to_batches()[0], 0, True)
        labels = lesson.labels[lesson.docs]
        if len(set(labels[lesson.tested])) < 2:
            lesson.tested[:] = False
        learnt = np.flatnonzero(~lesson.tested)
        net = train(lesson.texts.take(pa.array(lesson.docs[learnt])), labels[learnt], np.ones(len(learnt)), epochs)
        judged = np.flatnonzero(lesson.tested) if lesson.tested.any() else learnt
        rows = pa.array(lesson.docs[judged])
        margin, labels, langs, weights = net.margin(lesson.texts.take(rows)), labels[judged], lesson.langs.take(rows), np.ones(len(judged))
    else:
        net, testing = train_lessons(lessons, epochs)
        step = MARGIN_STEP if total * (LEFT_OUT if testing else 1) > EXACT_MARGINS else None
        schema = MARGINS.format(lessons.schema["langs"].dataType.elementType.simpleString())
        found = _each_lesson(lessons, testing, _judge(net, step), schema).groupBy("lang", "label", "margin").agg(F.sum("n").alias("n"))
        found = found.orderBy("margin", "label", "lang").toArrow()
        margin, labels, weights = (found[c].to_numpy().astype(np.float64) for c in ("margin", "label", "n"))
        langs = found["lang"]
    net.slope, net.shift = calibrate(margin, labels, weights)
    score, model = net.score(margin), Model(net)
    model.cut = best_cut(score, labels, weights)
    langs = langs.to_pylist()
    for lang in set(langs):
        own = np.array([x == lang for x in langs])
        positives = float((labels * weights)[own].sum())
        if positives:
            pull = positives / (positives + PRIOR_POSITIVES)
            model.cuts[lang] = pull * best_cut(score[own], labels[own], weights[own]) + (1 - pull) * model.cut
    return model


def _scorer(network: Network):
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            if network.constant is not None or not len(texts):
                yield pa.array(np.full(len(texts), network.constant if network.constant is not None else 0.0), pa.float64())
                continue
            yield pa.array(network.score(network.margins(texts)), pa.float64())

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "double")


def score_toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", lang: str | None = "lang",
    **options,
) -> DataFrame:
    """``docs`` without ``text``, with ``score``, ``predicted`` (score of at least ``CUT``), and by language ``threshold`` and ``flagged``.

    ``learn`` says which rows' labels may be used.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("__label")).where("__label IN (0, 1)")
    language = F.col(f"`{lang}`") if lang else F.lit(None).cast("string")
    own, value = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    keyed = docs.where(learn).select(
        own.alias("id"), F.xxhash64(own, F.coalesce(value, F.lit(""))).alias("key"), F.coalesce(F.length(value), F.lit(0)).alias("size"), language.alias("lang"), value.alias("text"))
    # Labels meet ids and hashes; no text is moved for them.
    examples = keyed.drop("text").join(known.select(F.col("__id").alias("id"), F.col("__label").alias("label")), "id")
    model = fit(kept(examples, "examples"), keyed.select("id", "key", "text"), **options)
    cuts = F.lit(model.cut)
    for name, cut in model.cuts.items():
        cuts = F.when(language.eqNullSafe(F.lit(name)), F.lit(cut)).otherwise(cuts)
    scored = without(docs, "score", "predicted", "threshold", "flagged").withColumn("score", _scorer(model.network)(F.col(f"`{text}`"))).drop(text)
    scored = scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
    return scored.withColumn("threshold", cuts).withColumn("flagged", F.col("score") >= F.col("threshold"))
