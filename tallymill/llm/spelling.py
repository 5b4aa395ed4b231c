"""Spelling variants: pairs of vocabulary words one edit apart, by finite-state composition.

The vocabulary is a minimised acceptor ``A``; ``E`` is the transducer of exactly one inserted, deleted or replaced code
point. The composition ``A . E . A`` accepts just the near pairs. Before the edit both sides of a composed state are the
same state of ``A``; after it they are two states whose common endings remain to be accepted. So at every state of ``A``
the pairs are: the ways into it, times one edit over its arcs, times the common endings, which are computed once per
pair of states and shared by all ways in. ``E`` is unambiguous: an edit stands at the first place at which the words
differ (an inserted code point is not the one that follows it), so each pair is accepted once.

``A`` is never in one place. Its initial states partition the words: words that share their first code points stand
below one state, and a part is enumerated on its own. A part of more than ``part_words`` words is cut three code points
deeper; pairs that differ within these three agree in everything before and after, so they meet in small parts keyed by
both ends, with the few middles between as words. Thus each word is in one deep part and in two middles per level above
it, every pair is accepted in exactly one part, and no part grows with the vocabulary: a middle has at most four code
points. Parts hand on sums and best partners per word, never pairs.

Counting takes whole texts in Arrow batches: split, encoded as a dictionary and counted there, with partial sums in each
task. The checksum that chooses damaged runs is composed from a document's and a run's own checksum, so each distinct
run is hashed once a batch.

Defined cases: NULL and empty texts have no run; a NULL id is an empty one; repeated documents count each time; ties go
to the smallest word in code-point order; an empty vocabulary gives no row; other columns are not carried.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallymill.llm.common import kept
from tallymill.plans.sizing import pin

# The contract's fixed values.
LETTERS = "A-Za-zÀ-ÿ"
DAMAGED, MIN_LENGTH, MIN_COUNT, MORE = 199, 6, 5, 5

PART_WORDS = 4_000
STRIDE = 3
SLICE_BYTES = 16 << 20
HELD_WORDS = 1_000_000
SHORT_RUN = 64  # bytes up to which checksums are composed

_TABLE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)


def _shifted(crcs: np.ndarray, length: int) -> np.ndarray:
    """What each checksum contributes once ``length`` more bytes follow."""
    out = crcs.copy()
    for _ in range(length):
        out = _TABLE[out & 0xFF] ^ (out >> np.uint32(8))
    return out


def _runs(ids: list, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct words of the texts, after damage, and how often each stands there."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), f"[^{LETTERS}]+")
    flat = lists.flatten().dictionary_encode()
    runs, place = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    encoded = [r.encode() for r in runs]
    size, own = np.array([len(e) for e in encoded], dtype=np.int64), np.array([zlib.crc32(e) for e in encoded], dtype=np.uint32)
    heads = [f"{'' if i is None else i}:".encode() for i in ids]
    head = np.array([zlib.crc32(h) for h in heads], dtype=np.uint32)
    short, long = np.flatnonzero(size[place] <= SHORT_RUN), np.flatnonzero(size[place] > SHORT_RUN)
    rows = [head]
    for _ in range(min(SHORT_RUN, int(size.max(initial=0)))):
        rows.append(_shifted(rows[-1], 1))
    whole = np.zeros(len(place), dtype=np.uint32)
    if len(short):
        whole[short] = np.stack(rows)[size[place[short]], doc[short]] ^ own[place[short]]
    for at in long:
        whole[at] = zlib.crc32(encoded[place[at]], int(head[doc[at]]))
    hit = (whole % DAMAGED == 0) & (size[place] > 0)
    counts = np.bincount(place[~hit], minlength=len(runs))
    extra: dict[str, int] = {}
    for at in np.flatnonzero(hit):
        run = runs[place[at]]
        cut = int(whole[at]) % len(run)
        word = run[:cut] + run[cut + 1:]
        extra[word] = extra.get(word, 0) + 1
    words = [*runs, *extra]
    n = np.concatenate([counts, np.fromiter(extra.values(), dtype=np.int64, count=len(extra))])
    return words, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        nonlocal held, size
        table = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
        held, size = [], 0
        return table.to_batches()

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        widths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(ids):
            before = widths[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(widths, before + SLICE_BYTES, side="right")))
            words, n = _runs(ids[begin:stop], texts[begin:stop])
            word = pa.array(words, pa.string())
            table = pa.table({"word": word, "n": pa.array(n, pa.int64())}).filter(pc.and_(pc.greater_equal(pc.utf8_length(word), MIN_LENGTH), pc.greater(pa.array(n, pa.int64()), 0)))
            held.append(table)
            size += table.num_rows
            if size > HELD_WORDS:
                yield from flush()
            begin = stop
    if held:
        yield from flush()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n``: words of at least ``MIN_LENGTH`` code points with at least ``MIN_COUNT`` occurrences, after damage."""
    source = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    counted = source.mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


class Acceptor:
    """Minimised acceptor of sorted distinct words; paths are numbered in the words' order.

    A state is ``(final, {symbol: (state, skipped)})``: ``skipped`` counts the
    accepted endings that come before the arc's.
    """

    def __init__(self, words: list[str]):
        self.known: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.size: list[int] = []
        self.common: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.root = self._build(words)

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, tuple(arcs))
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.final)
            skipped, numbered = int(final), {}
            for c, child in arcs:
                numbered[c] = (child, skipped)
                skipped += self.size[child]
            self.final.append(final)
            self.arcs.append(numbered)
            self.size.append(skipped)
        return state

    def _build(self, words: list[str]) -> int:
        """Sorted words: the open path is closed, from its end, as far as the next word leaves it."""
        path: list[tuple[bool, list]] = [(False, [])]
        before = ""
        for word in [*words, None]:
            shared = 0
            if word is not None:
                for a, b in zip(before, word):
                    if a != b:
                        break
                    shared += 1
            while len(path) > shared + 1:
                final, arcs = path.pop()
                path[-1][1].append((before[len(path) - 1], self._state(final, arcs)))
            if word is None:
                break
            for _ in word[shared:]:
                path.append((False, []))
            path[-1] = (True, path[-1][1])
            before = word
        return self._state(*path[0])

    def endings(self, a: int, b: int) -> list[tuple[int, int]]:
        """Numbers, below ``a`` and below ``b``, of the endings that both accept."""
        if a == b:
            return [(i, i) for i in range(self.size[a])]
        known, open_pairs = self.common, [(a, b)]
        while (a, b) not in known:  # words may be longer than Python's stack is deep
            x, y = open_pairs[-1]
            left, right = self.arcs[x], self.arcs[y]
            shared = left.keys() & right.keys()
            below = [(left[c][0], right[c][0]) for c in shared]
            unknown = [p for p in below if p[0] != p[1] and p not in known]
            if unknown:
                open_pairs.extend(unknown)
                continue
            found = [(0, 0)] if self.final[x] and self.final[y] else []
            for c in shared:
                (p, i), (q, j) = left[c], right[c]
                common = known[p, q] if p != q else ((k, k) for k in range(self.size[p]))
                found.extend((i + k, j + m) for k, m in common)
            known[x, y] = found
            open_pairs.pop()
        return known[a, b]

    def _inserted(self, p: int, c: str, end: bool) -> list[tuple[int, int]]:
        """Endings of ``p`` that the arc's target accepts too, but for those that begin with the inserted ``c``."""
        q, skipped = self.arcs[p][c]
        found = [(0, skipped)] if end and self.final[p] and self.final[q] else []
        left, right = self.arcs[p], self.arcs[q]
        for d in (left.keys() & right.keys()):
            if d != c:
                (x, i), (y, j) = left[d], right[d]
                found.extend((i + k, skipped + j + m) for k, m in self.endings(x, y))
        return found

    def near(self, end: bool = True) -> Iterator[tuple[int, int]]:
        """Numbers of all pairs of words one edit apart; without ``end``, none is inserted behind a word."""
        ways: list[list[int]] = [[] for _ in self.final]
        ways[self.root].append(0)
        for p in range(len(self.final) - 1, -1, -1):  # children have lower numbers than their parents
            if not ways[p]:
                continue
            arcs = list(self.arcs[p].items())
            edits = []
            for k, (c, (a, i)) in enumerate(arcs):
                for o in ways[p]:
                    ways[a].append(o + i)
                for _, (b, j) in arcs[k + 1:]:
                    edits.extend((i + x, j + y) for x, y in self.endings(a, b))
                edits.extend(self._inserted(p, c, end))
            for o in ways[p]:
                for x, y in edits:
                    yield o + x, o + y
            ways[p] = []


def _part(rows: list[tuple], shortest: int, out: list) -> None:
    """Adds sums and best partners of one part's words; ``shortest`` is a middle's least word length, or -1 for a deep part."""
    deep = shortest < 0
    if len(rows) == 1:
        if deep:
            out.append((rows[0][1], rows[0][2], 0, None, None))
        return
    middles, words, counts = zip(*rows)
    short, open_end = [len(w) == shortest for w in words], True
    if not deep:
        if not any(short):
            return
        # Behind a full middle the words go on, so a code point inserted there first differs in a later part.
        open_end = len(middles[short.index(True)]) < STRIDE
    near, best = [0] * len(words), [-1] * len(words)
    for a, b in Acceptor(list(middles)).near(open_end):
        if not deep and not (short[a] or short[b]):
            continue  # both are the longer ones: these meet among words of their own length
        for x, y in ((a, b), (b, a)):
            near[x] += 1
            k = best[x]
            if k < 0 or counts[y] > counts[k] or (counts[y] == counts[k] and words[y] < words[k]):
                best[x] = y
    for k, word in enumerate(words):
        if near[k] or deep:
            b = best[k]
            out.append((word, counts[k], near[k], counts[b] if b >= 0 else None, words[b] if b >= 0 else None))


def _enumerated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, middle); one part at a time."""
    part, shortest, rows = None, -1, []

    def batch(out):
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), types)], names=["word", "n", "n_near", "form_n", "form"])

    for got in batches:
        out = []
        for key, least, middle, word, n in zip(*[c.to_pylist() for c in got.columns]):
            if key != part:
                if rows:
                    _part(rows, shortest, out)
                part, shortest, rows = key, least, []
            rows.append((middle, word, n))
        if out:
            yield batch(out)
    if rows:
        out = []
        _part(rows, shortest, out)
        if out:
            yield batch(out)


def _parts(words: DataFrame, part_words: int) -> DataFrame:
    """``part``, ``shortest``, ``middle``, ``word`` and ``n``: each word's deep part and its middles on the levels above."""
    tail = lambda at: F.substring("word", at + 1, 1 << 30)
    size = F.length("word")
    active, parts, depth = words, [], 0
    while True:
        start = F.substring("word", 1, depth)
        large, rows = pin(active.groupBy(start.alias("start")).count().where(F.col("count") > part_words).select("start"))
        if rows is not None and not rows:
            deep = active
        else:
            deep = active.join(large, start == large["start"], "left_anti")
        parts.append(deep.select(
            F.concat(F.lit(f"{depth}:"), start).alias("part"), F.lit(-1).cast("long").alias("shortest"), tail(depth).alias("middle"), "word", "n"))
        if rows is not None and not rows:
            break
        active = active.join(large, start == large["start"], "left_semi")
        for longer in (0, 1):
            width = STRIDE + longer
            key = F.concat_ws("\x00", F.lit(f"{depth}"), (size - longer).cast("string"), start, tail(depth + width))
            parts.append(active.where(size >= depth + longer).select(
                key.alias("part"), (size - longer).cast("long").alias("shortest"), F.substring("word", depth + 1, width).alias("middle"), "word", "n"))
        depth += STRIDE
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def near_words(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """``word``, ``n``, ``n_near`` and its most frequent near word (``form``, ``form_n``; the smallest of equals)."""
    parts = _parts(words, part_words).repartition("part").sortWithinPartitions("part", "middle")
    found = parts.mapInArrow(_enumerated, "word string, n long, n_near long, form_n long, form string")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form"))).alias("best")
    summed = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    return summed.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """``word`` and ``root`` of words with a ``form``: forms followed to the last, doubling the steps taken each round."""
    reached = forms.select("word", F.col("form").alias("root"))
    for k in range(max(0, math.ceil(math.log2(max(steps, 1))))):
        onward = reached.select(F.col("word").alias("__at"), F.col("root").alias("__to"))
        reached = kept(reached.join(onward, F.col("root") == F.col("__at"), "left").select("word", F.coalesce("__to", "root").alias("root")), f"roots{k}")
    return reached


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", more: int = MORE, part_words: int = PART_WORDS) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of the whole vocabulary.

    A word's ``form`` is its most frequent near word if that is ``more`` times as
    frequent, ``root`` the last of the forms' forms.
    """
    words = kept(vocabulary(docs, doc_id, text), "vocabulary")
    near = near_words(words, part_words)
    enough = F.col("form_n") >= more * F.col("n")
    judged = kept(near.select(
        "word", "n", "n_near", F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")), "forms")
    most = judged.agg(F.max("form_n")).first()[0]
    # A form is at least ``more`` times as frequent as its word, so this many steps reach the last one.
    steps = 1 + int(math.log(max(most or 1, 1), more)) if more > 1 else 1
    followed = roots(judged.where("form IS NOT NULL"), steps)
    return judged.join(followed, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
