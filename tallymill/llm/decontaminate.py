"""Benchmark decontamination by Wu-Manber search over words.

Words are maximal runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. A test string is a window of ten
consecutive words of an item; an item of fewer words is one window. For the windows of one length ``m`` the tables are:

* shift: for a block of two words, how far its last place in any window is from the window's end. A block that is in no
  window allows ``m - 1`` words to be skipped, so most document words are never looked at.
* suffix: windows by their last block (shift 0), and within it by their first block; the words in between are then
  compared directly.

Documents never move: each task scans its own rows against the tables. Test strings are taken in blocks of a bounded
number of (window, item) pairs, each broadcast on its own; with more than one block the documents and what was hit so
far are written between the passes.

Defined cases: NULL and empty texts and items have no words; items with the same id count as one, a NULL id as the empty
string; repeated documents are judged alike, one output row per input row; input columns named like an added one are
replaced; an empty benchmark hits nothing.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallymill.llm.common import kept, without

WINDOW = 10
BLOCK_PAIRS = 400_000
ADDED = ("n_words", "n_hit", "n_items", "items", "contaminated")

# Bytes that separate words become spaces, A-Z become a-z (fixed values of the contract).
_WORD_BYTES = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
TABLE = bytes(b if b in _WORD_BYTES else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def windows_of(text: bytes | None, size: int = WINDOW) -> list[bytes]:
    words = words_of(text)
    if not words:
        return []
    return list(dict.fromkeys(b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))))


class Tables:
    """Shift and suffix tables for the windows of one length."""

    def __init__(self, length: int, windows: dict[bytes, list[str]]):
        self.length = length
        self.windows = windows
        self.shifts: dict[bytes, dict[bytes, int]] = defaultdict(dict)
        self.suffixes: dict[tuple[bytes, bytes], dict[tuple[bytes, bytes], set[bytes]]] = {}
        if length < 2:
            return
        for window in windows:
            words = window.split()
            for j in range(1, length):
                known = self.shifts[words[j]]
                known[words[j - 1]] = min(known.get(words[j - 1], length), length - 1 - j)
            bucket = self.suffixes.setdefault((words[-2], words[-1]), {})
            bucket.setdefault((words[0], words[1]), set()).add(window)
        self.shifts = dict(self.shifts)

    def find(self, words: list[bytes]) -> list[tuple[int, bytes]]:
        """``(start, window)`` of every occurrence."""
        m, n, windows = self.length, len(words), self.windows
        if m == 1:
            return [(i, w) for i, w in enumerate(words) if w in windows]
        found, skip, last = [], m - 1, self.shifts.get
        at = m - 1
        while at < n:
            known = last(words[at])
            if known is None:
                at += skip
                continue
            shift = known.get(words[at - 1], skip)
            if shift:
                at += shift
                continue
            start = at - skip
            bucket = self.suffixes[words[at - 1], words[at]].get((words[start], words[start + 1]))
            if bucket:
                window = b" ".join(words[start:at + 1])
                if window in bucket:
                    found.append((start, window))
            at += 1
        return found


def build(pairs: list[tuple[bytes, str]]) -> list[Tables]:
    by_length: dict[int, dict[bytes, list[str]]] = defaultdict(lambda: defaultdict(list))
    for window, item in pairs:
        by_length[window.count(b" ") + 1][window].append(item)
    return [Tables(m, dict(windows)) for m, windows in sorted(by_length.items())]


def search(words: list[bytes], tables: list[Tables], spans: list[int], items: set[str]) -> list[int]:
    """Adds occurrences to ``items``; returns the hit words as sorted, disjoint ``start, end`` pairs."""
    hits = list(zip(spans[::2], spans[1::2]))
    for t in tables:
        for start, window in t.find(words):
            hits.append((start, start + t.length))
            items.update(t.windows[window])
    merged: list[int] = []
    for start, end in sorted(hits):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    return merged


_BUILT: dict[str, list[Tables]] = {}
STATE = "struct<n_words:bigint,spans:array<int>,items:array<string>>"


def _scanner(broadcast):
    key = uuid.uuid4().hex  # workers outlive a query

    def scan(texts: pa.Array, states: pa.Array) -> pa.Array:
        if key not in _BUILT:
            _BUILT.clear()  # one block's tables at a time
            _BUILT[key] = build(broadcast.value)
        tables, out = _BUILT[key], []
        for text, state in zip(texts, states):
            words, before = words_of(text.as_py()), state.as_py() or {}
            items = set(before.get("items") or ())
            spans = search(words, tables, before.get("spans") or [], items)
            out.append({"n_words": len(words), "spans": spans, "items": sorted(items)})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]))

    return F.arrow_udf(scan, STATE)


def _cut(texts: pa.Array) -> pa.Array:
    return pa.array([windows_of(t.as_py()) for t in texts], pa.list_(pa.binary()))


def window_pairs(bench: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct ``(window, item)``."""
    cut = F.arrow_udf(_cut, "array<binary>")
    item = F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item")
    return bench.select(item, F.explode(cut(F.col(f"`{text}`").cast("binary"))).alias("window")).select("window", "item").distinct()


def find_benchmark(
    docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items`` (sorted ids) and ``contaminated``."""
    pairs = kept(window_pairs(bench, item_id, item_text), "windows")
    n_blocks = max(1, -(-pairs.count() // block_pairs))
    block = F.pmod(F.xxhash64("window", "item"), F.lit(n_blocks))
    state = F.lit(None).cast(STATE)
    out = docs.withColumn("__state", state)
    for k in range(n_blocks):
        rows = [(bytes(r[0]), r[1]) for r in pairs.where(block == k).collect()]  # at most about block_pairs, by an even hash
        scan = _scanner(docs.sparkSession.sparkContext.broadcast(rows))
        out = out.withColumn("__state", scan(F.col(f"`{text}`").cast("binary"), F.col("__state")))
        if k + 1 < n_blocks:
            out = kept(out, "scanned")
    spans, items = F.col("__state.spans"), F.col("__state.items")
    n_hit = _length(spans)
    result = without(out.withColumns({
        "__words": F.col("__state.n_words"), "__hit": n_hit, "__count": F.size(items).cast("bigint"), "__items": items}), *ADDED, "__state")
    return result.withColumn("contaminated", F.col("__hit") > 0).withColumnsRenamed(
        {"__words": "n_words", "__hit": "n_hit", "__count": "n_items", "__items": "items"})


def _length(spans):
    """Total length of ``start, end`` pairs: ends count up, starts count down."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda a, x: a + x)


def keep_clean(docs: DataFrame, bench: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a hit, with their columns as they came."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("__text"))
    return find_benchmark(row, bench, "__text", **options).where(~F.col("contaminated")).select("row.*")
