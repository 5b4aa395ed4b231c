"""Language-model scores by prediction by partial matching over bytes.

Training counts every run of six bytes (five of context and the byte they lead to) in all training texts, lower-cased
A-Z, with an end mark; the shorter contexts' counts follow from them. Every run is kept, whatever its count. The trie is
never in one place: documents are packed in blocks of some megabytes, each block sends its distinct runs, with their
counts in training texts, to parts chosen by a hash of the last three bytes of the context. A part holds all longer
contexts that end in its three bytes, so it adds the counts up, builds its piece of the trie, and sends each block the
logarithms of its runs. Runs travel sorted, those three bytes first, as compressed planes of bytes; logarithms come back
alone in that order, which the block's texts give again. Only counts of runs of at most three bytes are gathered and
broadcast.

A node with ``n`` counts and ``d`` kept symbols gives a symbol ``c / (n + d)``; the escape has the rest, ``d`` plus the
counts of the symbols left out. After an escape the symbols of the longer context are excluded from the shorter one's
counts. Below the empty context all remaining bytes are equally likely. The model is pretrained and stays fixed while it
scores, so a byte's probability depends on its run alone and a text's score is a sum over its bytes.

The unigram base needs a count per word and is exchanged alike: each block sends its distinct words to the hash parts of
the vocabulary, a part adds them up and sends each block its words' counts back, where they meet the block's texts. The
number of parts follows the input's size. A frequent word or run is one entry per block, so none is a hot key.

Defined cases: NULL and empty texts have the end mark alone; a NULL id is a training text; with no training text every
byte is equally likely and ``base_score`` is NULL; repeated rows count each time; the bytes FF and FE, which UTF-8 never
holds, serve as the end and start marks; input columns are not carried.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tallymill.llm.common import kept

ORDER = 5
LOW = 3  # bytes of context that choose a part; also the longest runs that are gathered
START, END = 0xFE, 0xFF
SYMBOLS = 255  # all bytes and the end mark, but not the start mark
BLOCK_BYTES = 8 << 20
PART_BYTES = 16 << 20
END_TOKEN = b"\t"
STEP = 500  # documents looked at together
SLICE = 1 << 20


def framed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with their marks in one array, and where each one's first byte to predict stands."""
    pad, parts, starts, at = bytes([START]) * ORDER, [], [], 0
    for text in texts:
        body = pad + (text or b"").lower() + bytes([END])
        parts.append(body)
        starts.append(at + ORDER)
        at += len(body)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.array(starts, dtype=np.int64)


def runs(data: np.ndarray, begin: int, stop: int) -> np.ndarray:
    """The run that ends at each place from ``begin`` to ``stop``, as an integer."""
    out = np.zeros(stop - begin, dtype=np.int64)
    for k in range(ORDER, -1, -1):
        out = (out << 8) | data[begin - k:stop - k]
    return out


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    every, n = np.concatenate([np.empty(0, np.int64), *keys]), np.concatenate([np.empty(0, np.int64), *counts])
    order, where = np.unique(every, return_inverse=True)
    return order, np.bincount(where, weights=n, minlength=len(order)).astype(np.int64)


def count_runs(texts: list[bytes | None], size: int = ORDER + 1) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of ``size`` bytes, in order, and their counts."""
    found = []
    for k in range(0, len(texts), STEP):
        data, _ = framed(texts[k:k + STEP])
        for begin in range(ORDER, len(data), SLICE):
            got = runs(data, begin, min(begin + SLICE, len(data)))
            found.append(np.unique(got[(got & 0xFF) != START] & ((1 << 8 * size) - 1), return_counts=True))
    return summed([k for k, _ in found], [n for _, n in found])


class Lookup:
    """Places of integers in a sorted array, by open addressing over whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), np.full(1 << bits, -1, dtype=np.int32)
        self.mask = (1 << bits) - 1
        at, left = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            at, left = (at[lost] + 1) & self.mask, left[lost]

    def _slot(self, values: np.ndarray) -> np.ndarray:
        return ((values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1."""
        out = np.full(len(values), -1, dtype=np.int32)
        if not len(self.keys):
            return out
        at, left = self._slot(values), None
        while True:
            here = self.slots[at]
            wanted = values if left is None else values[left]
            same = (here >= 0) & (self.keys[here] == wanted)
            if left is None:
                out[same] = here[same]
                left = np.flatnonzero((here >= 0) & ~same)
                at = (at[left] + 1) & self.mask
            else:
                out[left[same]] = here[same]
                on = (here >= 0) & ~same
                left, at = left[on], (at[on] + 1) & self.mask
            if not len(left):
                return out


class Trie:
    """Kept runs and context nodes by length, with the logarithms that scoring adds up."""

    def __init__(self, size: np.ndarray, run: np.ndarray, n: np.ndarray):
        self.levels = []
        by_size = {}
        for k in range(1, ORDER + 2):
            at = size == k
            order = np.argsort(run[at])
            by_size[k] = (run[at][order], n[at][order].astype(np.float64))
        finds = {k: Lookup(keys) for k, (keys, _) in by_size.items()}
        below = None
        for k in range(ORDER + 1):  # contexts of k bytes
            keys, counts = by_size[k + 1]
            nodes, node_of = np.unique(keys >> 8, return_inverse=True)
            kept_n = np.bincount(node_of, weights=counts, minlength=len(nodes))
            d = np.bincount(node_of, minlength=len(nodes)).astype(np.float64)
            n_all = kept_n.copy()
            if k:
                place = finds[k].find(nodes)
                n_all = np.maximum(kept_n, np.where(place >= 0, by_size[k][1][place], 0.0))
            level = {"runs": finds[k + 1], "counts": counts, "nodes": Lookup(nodes), "n": n_all, "tail": n_all - kept_n, "d": d}
            level["log_count"] = np.log10(counts)
            level["log_all"], level["log_escape"] = self._logs(n_all + d, level["tail"] + d)
            if below is not None and len(nodes):
                # What the shorter context has left once this node's symbols are excluded.
                suffix = below["nodes"].find(nodes & ((1 << 8 * (k - 1)) - 1))
                shorter = finds[k].find(keys & ((1 << 8 * k) - 1))
                excluded = np.bincount(node_of, weights=below["counts"][shorter], minlength=len(nodes))
                rest = below["n"][suffix] - excluded + below["d"][suffix] - d
                level["log_rest"], level["log_rest_escape"] = self._logs(rest, below["tail"][suffix] + below["d"][suffix] - d)
            self.levels.append(level)
            below = level
        seen = len(by_size[1][0])
        self.log_rest = -np.log10(max(1, SYMBOLS - seen))

    @staticmethod
    def _logs(whole: np.ndarray, escape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log of the divisor, and of the escape's share; an escape that nothing competes with is certain."""
        alone = whole <= 0
        return np.log10(np.where(alone, 1.0, whole)), np.where(alone, 0.0, np.log10(np.where(alone, 1.0, np.maximum(escape, 1e-9)) / np.where(alone, 1.0, whole)))

    def log_probability(self, got: np.ndarray) -> np.ndarray:
        """Log10 probability of the last byte of each run, given the others."""
        out = np.zeros(len(got))
        left, came = np.arange(len(got)), np.full(len(got), -1, dtype=np.int32)
        for k in range(ORDER, -1, -1):
            level, run = self.levels[k], got[left] & ((1 << 8 * (k + 1)) - 1)
            place = level["runs"].find(run)
            found, node = place >= 0, level["nodes"].find(run >> 8)
            after = came >= 0
            here = node >= 0
            whole = np.where(here, level["log_all"][node] if len(level["log_all"]) else 0.0, 0.0)
            escape = np.where(here, level["log_escape"][node] if len(level["log_escape"]) else 0.0, 0.0)
            if after.any():
                above = self.levels[k + 1]
                whole[after], escape[after] = above["log_rest"][came[after]], above["log_rest_escape"][came[after]]
            out[left[found]] += level["log_count"][place[found]] - whole[found]
            lost = ~found
            out[left[lost]] += escape[lost]
            left, came = left[lost], np.where(here, node, -1)[lost].astype(np.int32)
            if not len(left):
                return out
        out[left] += self.log_rest
        return out


def text_scores(texts: list[bytes | None], log_probability: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Log10 probability of each text, given that of runs."""
    if not texts:
        return np.empty(0)
    data, starts = framed(texts)
    sums = np.zeros(len(data) + 1)
    for begin in range(ORDER, len(data), SLICE):
        got = runs(data, begin, min(begin + SLICE, len(data)))
        inside = np.flatnonzero((got & 0xFF) != START)
        sums[begin + inside] = log_probability(got[inside])
    return np.add.reduceat(sums, starts)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of documents: a random name, their columns as lists, and their texts packed."""
    packer = zstandard.ZstdCompressor(level=3)
    ids, held, sizes, texts, size = [], [], [], [], 0

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), pa.array([held], pa.list_(pa.bool_())),
             pa.array([sizes], pa.list_(pa.int64())), pa.array([packer.compress(b"".join(texts))], pa.binary())], ["block", "ids", "held", "sizes", "texts"])

    for batch in batches:
        for k in range(0, batch.num_rows, STEP):
            part = batch.slice(k, STEP)
            ids.append(part.column(0))
            held += part.column(1).to_pylist()
            for text in part.column(2).to_pylist():
                texts.append(text or b"")
                sizes.append(len(texts[-1]))
                size += sizes[-1] + 64
            if size >= BLOCK_BYTES:
                yield row()
                ids, held, sizes, texts, size = [], [], [], [], 0
    if ids:
        yield row()


def unpacked(sizes: list[int], texts: bytes) -> list[bytes]:
    data, out, at = zstandard.ZstdDecompressor().decompress(texts, max_output_size=sum(sizes)) if sum(sizes) else b"", [], 0
    for size in sizes:
        out.append(data[at:at + size])
        at += size
    return out


def tokens(text: bytes | None) -> list[bytes]:
    """Words, then the end token (a tab, which no word holds)."""
    return [*(text or b"").lower().split(), END_TOKEN]


def _block_words(parts: int):
    """``(block, part, words, n)``: a block's words by hash part, joined by spaces, and how often training texts have them."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, held, sizes, texts = (c[k].as_py() for c in batch.columns)
                counts: dict[bytes, int] = {}
                for text, out in zip(unpacked(sizes, texts), held):
                    step, get = int(not out), counts.get
                    for word in tokens(text):
                        counts[word] = get(word, 0) + step
                words = defaultdict(list)
                for word in counts:
                    words[zlib.crc32(word) % parts].append(word)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(words), pa.int64()), pa.array(list(words), pa.int32()), pa.array([b" ".join(w) for w in words.values()], pa.binary()),
                     pa.array([[counts[x] for x in w] for w in words.values()], pa.list_(pa.int64()))], ["block", "part", "words", "n"])

    return split


def _sum_words(rows: pa.Table) -> pa.Table:
    """All blocks' words of one part with their sums; one more row, block -1, has the sum and number of those above zero."""
    split = [w.split(b" ") for w in rows.column("words").to_pylist()]
    sums: dict[bytes, int] = {}
    for words, n in zip(split, rows.column("n").to_pylist()):
        for word, k in zip(words, n):
            sums[word] = sums.get(word, 0) + k
    counts = [[sums[x] for x in words] for words in split]
    known = [v for v in sums.values() if v]
    return pa.table({
        "block": pa.array([*rows.column("block").to_pylist(), -1], pa.int64()), "words": pa.array([*rows.column("words").to_pylist(), b""], pa.binary()),
        "c": pa.array([*counts, [sum(known), len(known)]], pa.list_(pa.int64()))})


def _count_low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ``LOW`` bytes in the training texts of a task's blocks."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            held, sizes, texts = (c[k].as_py() for c in batch.columns)
            run, n = count_runs([t for t, out in zip(unpacked(sizes, texts), held) if not out], LOW)
            keys, counts = summed([keys, run], [counts, n])
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["run", "n"])


def part_of(run: np.ndarray, parts: int) -> np.ndarray:
    """The part that holds a run: a hash of the last ``LOW`` bytes of its context."""
    return ((((run >> 8) & ((1 << 8 * LOW) - 1)) * 0x9E3779B1) >> 16) % parts


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values))


def rotated(run: np.ndarray) -> np.ndarray:
    """The run with the bytes that choose its part in front, so that neighbours in a part's order differ little."""
    older = ORDER - LOW
    return (((run >> 8) & ((1 << 8 * LOW) - 1)) << 8 * (older + 1)) | ((run >> 8 * (LOW + 1)) << 8) | (run & 0xFF)


def unrotated(key: np.ndarray) -> np.ndarray:
    older = ORDER - LOW
    return (((key >> 8) & ((1 << 8 * older) - 1)) << 8 * (LOW + 1)) | ((key >> 8 * (older + 1)) << 8) | (key & 0xFF)


def pack(values: np.ndarray) -> bytes:
    """Numbers of at least zero as compressed planes of bytes, without the planes that are all zero."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    used = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return zstandard.ZstdCompressor(level=3).compress(planes[:used].tobytes())


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(-1, n) if n else np.empty((0, 0), np.uint8)
    out = np.zeros((8, n), np.uint8)
    out[:len(planes)] = planes
    return np.ascontiguousarray(out.T).view("<i8").reshape(-1)


def block_runs(texts: list[bytes | None], held: list[bool], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct runs in order of part and rotated run, their counts in training texts, the parts and their sizes."""
    run, n = count_runs([t for t, out in zip(texts, held) if not out])
    others, _ = count_runs([t for t, out in zip(texts, held) if out])
    run, n = summed([run, others], [n, np.zeros(len(others), np.int64)])
    part = part_of(run, parts)
    order = np.lexsort((rotated(run), part))
    names, lengths = np.unique(part, return_counts=True)
    return run[order], n[order], names, lengths


def _block_runs(parts: int):
    """``(block, part, size, runs, n)``: a block's distinct runs by part, and how often training texts have them."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, held, sizes, packed = (c[k].as_py() for c in batch.columns)
                run, n, names, lengths = block_runs(unpacked(sizes, packed), held, parts)
                cuts = np.cumsum(lengths)[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(names), pa.int64()), pa.array(names, pa.int32()), pa.array(lengths, pa.int32()),
                     *[pa.array([pack(x) for x in np.split(values, cuts)] if len(names) else [], pa.binary()) for values in (rotated(run), n)]],
                    ["block", "part", "size", "runs", "n"])

    return split


def part_logs(low: tuple[np.ndarray, np.ndarray], asked: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log10 probability of each asked run, given all counts ``n`` of the runs of one part and those of ``low`` runs."""
    keys, where = np.unique(asked, return_inverse=True)
    counts = np.bincount(where, weights=n, minlength=len(keys))
    sizes = [(k, *summed([low[0] & ((1 << 8 * k) - 1)], [low[1]])) for k in range(1, LOW + 1)]
    sizes += [(k, *summed([keys[counts > 0] & ((1 << 8 * k) - 1)], [counts[counts > 0]])) for k in range(LOW + 1, ORDER + 2)]
    trie = Trie(np.concatenate([np.full(len(r), k) for k, r, _ in sizes]), np.concatenate([r for _, r, _ in sizes]), np.concatenate([c for *_, c in sizes]))
    return trie.log_probability(keys)[where]


def _part_scorer(low):
    """Sums the runs of one part over all blocks and gives each block ``(block, part, logs)``."""
    def score(rows: pa.Table) -> pa.Table:
        lengths = rows.column("size").to_numpy()
        asked, n = (np.concatenate([unpack(x.as_py(), k) for x, k in zip(rows.column(c), lengths)]) for c in ("runs", "n"))
        logs = part_logs(low.value, unrotated(asked), n)
        return pa.table({"block": rows.column("block"), "part": rows.column("part"), "logs": _lists(logs, lengths)})

    return score


SCORED = pa.schema([
    ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scorer(n_train: int, v_train: int, parts: int):
    divisor = np.log10(n_train + 0.1 * (v_train + 1)) if n_train else None

    def score(rows: pa.Table, given: pa.Table) -> pa.Table:
        logs: dict[bytes, float] = {}
        words = given.filter(pc.is_valid(given.column("words")))
        for joined, c in zip(words.column("words"), words.column("c")):
            logs.update(zip(joined.as_py().split(b" "), np.log10(c.values.to_numpy() + 0.1).tolist()))
        run_logs = pc.list_flatten(given.filter(pc.is_valid(given.column("logs"))).sort_by("part").column("logs")).to_numpy()
        out = []
        for k in range(rows.num_rows):
            _, ids, held, sizes, packed = (c[k] for c in rows.columns)
            texts, totals, known, base, scores = unpacked(sizes.as_py(), packed.as_py()), [], [], [], []
            found = Lookup(block_runs(texts, held.as_py(), parts)[0])
            for text in texts:
                got = np.array([logs[w] for w in tokens(text)])
                totals.append(len(got))
                known.append(int((got > -0.5).sum()))  # log10(0.1) is -1, log10(1.1) above 0
                base.append(float(got.sum() - len(got) * divisor) if n_train else None)
            for at in range(0, len(texts), STEP):
                scores.append(text_scores(texts[at:at + STEP], lambda got: run_logs[found.find(got)]))
            out.append(pa.table({
                "id": ids.values, "held_out": held.values, "n_tokens": pa.array(totals, pa.int64()), "n_known": pa.array(known, pa.int64()),
                "base_score": pa.array(base, pa.float64()), "score": pa.array(np.concatenate(scores), pa.float64())}))
        return pa.concat_tables(out) if out else SCORED.empty_table()

    return score


def score_texts(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, learning from rows not held out."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = kept(rows.mapInArrow(_blocks, f"block bigint, ids array<{kind}>, held array<boolean>, sizes array<bigint>, texts binary"), "blocks")
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    used = blocks.select("block", "held", "sizes", "texts")
    by_word = used.mapInArrow(_block_words(parts), "block bigint, part int, words binary, n array<bigint>")
    counted = kept(by_word.groupBy("part").applyInArrow(_sum_words, "block bigint, words binary, c array<bigint>"), "words")
    n_train, v_train = counted.where("block = -1").agg(F.sum(F.get("c", F.lit(0))), F.sum(F.get("c", F.lit(1)))).first()
    short = used.drop("block").mapInArrow(_count_low, "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n")).toArrow()
    low = docs.sparkSession.sparkContext.broadcast(tuple(short.column(c).to_numpy() for c in ("run", "n")))
    by_run = used.mapInArrow(_block_runs(parts), "block bigint, part int, size int, runs binary, n binary")
    run_logs = by_run.groupBy("part").applyInArrow(_part_scorer(low), "block bigint, part int, logs array<double>")
    given = counted.where("block <> -1").unionByName(run_logs, allowMissingColumns=True)
    schema = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    scored = blocks.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_scorer(n_train or 0, v_train or 0, parts), schema)
    return scored.select(F.col("id").alias(doc_id), "held_out", "n_tokens", "n_known", F.lit(n_train or 0).cast("bigint").alias("train_tokens"), "base_score", "score")
