"""Conversation structure repair: the cheapest edits that make roles alternate, found on a suffix-shared automaton.

Every turn has a symbol: the class of its role (by initial: system, user, assistant, other) and its first fault (blank,
duplicate, truncated or none). A conversation's symbols in order are its signature. What can follow a place in a
signature depends on the rest of the signature alone, so the distinct signatures are sorted by their *reversed* text:
neighbours then share their common ending, each ending is one node of an automaton minimised from the end, and a task
keeps just the path of the ending it is at. Per node and grammar state the cost-to-go and the best next edit are
computed once, for all conversations that end that way; equal cost patterns of different nodes are looked up. Reading
a signature from its node to the end gives its audit, one letter per edit.

The grammar is ``(s?(ua)+)?`` over role initials. Keep costs nothing, Rerole (to user or assistant) and Insert (an empty
user or assistant turn) 2, Delete 3; blank and duplicate turns have to be deleted; a truncated turn that stays costs 1.
Of the edits possible in a grammar state no two have the same letter, so the least audit of equal cost takes the least
letter at every step (D < I < K < R) and no strings are compared.

Scale: texts move once, for the edited turns; faults, gaps and signatures use rows of a hash and a symbol. First uses of
a role and text are an aggregate joined back, not a window. Turns are read in sorted order and never held: a
conversation of any length takes one symbol per turn in memory, as long as the audit that it returns. Signatures are cut
into ranges of distinct values, so no group of conversations with one signature or one ending is gathered.

Defined cases: a NULL role or text is one blank; turns go by number, NULLs first, equal numbers by a hash of role and
text, and equal rows side by side; a NULL conversation id is a conversation; a conversation without turns has zero
counts and no edits; other columns are not carried, whatever their names. ``copies`` (optional) says how often a row
stands; rows with zero copies only name their conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallymill.llm.common import SPACES, kept
from tallymill.plans.sizing import join_null_safe

ENDINGS = ".!?"
ROLES = "suao"
FAULTS = ("none", "truncated", "blank", "duplicate")
DELETED = "X"  # the symbol of a turn that has to go, whatever its role
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
START, SYSTEM, USER, ASSISTANT = range(4)
# The grammar state after an inserted or re-roled turn, which a state takes in only one role.
FORCED = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60
RANGE_ROWS = 100_000

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def symbol(role: str, fault: int) -> str:
    """One letter for a role class and a fault."""
    return chr(ord("A") + ROLES.index(role) * len(FAULTS) + fault)


def _plain(symbols: str) -> str:
    """Symbols as the automaton reads them: turns that must go are all alike."""
    return symbols.translate({ord(symbol(r, f)): DELETED for r in ROLES for f in (2, 3)})


def _prepared(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text``, ``h`` and ``copies``; NULL roles and texts are one blank."""
    blank = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit(" "))
    rows = turns.select(
        F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), blank(role).alias("role"), blank(text).alias("text"),
        (F.col(f"`{copies}`").cast("long") if copies else F.lit(1).cast("long")).alias("copies"))
    # The role's length keeps (role, text) pairs apart.
    return rows.withColumn("h", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))


def _symbols(first: Column) -> Column:
    """The letters of a row's copies; ``first`` says whether its role and text have not been seen before."""
    def letter(fault: int) -> Column:
        out = F.lit(symbol(ROLES[-1], fault))
        for r in ROLES[:-1]:
            out = F.when(F.col("initial") == r, F.lit(symbol(r, fault))).otherwise(out)
        return out

    again = F.when(F.col("blank"), letter(2)).otherwise(letter(3))
    once = F.when(F.col("blank"), letter(2)).when(~first, letter(3)).when(F.col("cut"), letter(1)).otherwise(letter(0))
    return F.when(F.col("copies") < 1, F.lit("")).otherwise(F.concat(once, F.repeat(again, (F.col("copies") - 1).cast("int"))))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from rows sorted by (conv, turn): counts and the signature."""
    def row(conv, pieces, turns, low, high):
        symbols = "".join(pieces)
        fault = [symbols.count(symbol(ROLES[0], f)) + sum(symbols.count(symbol(r, f)) for r in ROLES[1:]) for f in range(len(FAULTS))]
        initials = symbols.translate({ord(symbol(r, f)): r for r in ROLES for f in range(len(FAULTS))})
        legal = sum(initials.count(pair) for pair in ("su", "ua", "au"))
        return conv, (high - low + 1 - turns) if turns else 0, fault[2], fault[3], fault[1], max(0, len(symbols) - 1) - legal, _plain(symbols)

    conv, pieces, turns, low, high, any_row = None, [], 0, None, None, False
    for batch in batches:
        out = []
        for c, t, piece in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            if not any_row or c != conv:
                if any_row:
                    out.append(row(conv, pieces, turns, low, high))
                conv, pieces, turns, low, high, any_row = c, [], 0, None, None, True
            if piece:
                pieces.append(piece)
                if t is not None and t != high:
                    turns, low, high = turns + 1, t if low is None else low, t
        yield _batch(out, batch.schema.field(0).type)
    if any_row:
        yield _batch([row(conv, pieces, turns, low, high)], batch.schema.field(0).type)


def _batch(rows: list, key: pa.DataType) -> pa.RecordBatch:
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature")
    types = (key, *[pa.int64()] * 5, pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


class Automaton:
    """The path of one ending: per node the costs-to-go and the best edit of the grammar's states.

    ``read`` moves to the node of a reversed signature; nodes shared with the
    one before are kept as they are.
    """

    def __init__(self):
        self._known: dict[tuple, tuple[int, tuple, str]] = {}
        self.path = [(0, (0, 2 * INSERT, INSERT, 0), ".II.")]
        self.symbols = ""
        self.nodes = 1

    def _step(self, letter: str, after: tuple[int, ...]) -> tuple[int, tuple, str]:
        """Costs (less their least) and edits of the node that reads ``letter`` and goes on to costs ``after``."""
        found = self._known.get((letter, after))
        if found is not None:
            return found
        options = [{"D": DELETE + after[q]} for q in range(4)]
        if letter != DELETED:
            place = ord(letter) - ord("A")
            role, late = ROLES[place // len(FAULTS)], TRUNCATED * (place % len(FAULTS))
            for q in range(4):
                options[q]["R"] = REROLE + late + after[FORCED[q]]
                if role == "s" and q == START:
                    options[q]["K"] = late + after[SYSTEM]
                elif role == ("a" if q == USER else "u"):
                    options[q]["K"] = late + after[FORCED[q]]
        plain = [min(o.values()) for o in options]
        best = list(plain)
        best[USER], best[ASSISTANT] = min(plain[USER], INSERT + plain[ASSISTANT]), min(plain[ASSISTANT], INSERT + plain[USER])
        for q in (START, SYSTEM):
            best[q] = min(plain[q], INSERT + best[USER])
        for q in range(4):
            options[q]["I"] = INSERT + best[FORCED[q]]
        edits = "".join(min(letter for letter, cost in options[q].items() if cost == best[q]) for q in range(4))
        low = min(best)
        self._known[letter, after] = got = (low, tuple(c - low for c in best), edits)
        return got

    def read(self, reverse: str) -> None:
        shared = 0
        for a, b in zip(self.symbols, reverse):
            if a != b:
                break
            shared += 1
        del self.path[shared + 1:]
        for letter in reverse[shared:]:
            base, costs, _ = self.path[-1]
            low, costs, edits = self._step(letter, costs)
            self.path.append((base + low, costs, edits))
            self.nodes += 1
        self.symbols = reverse

    def audit(self) -> tuple[int, str]:
        """Cost and edits of the signature whose node the path ends in."""
        base, costs, _ = self.path[-1]
        total, q, out, at = base + costs[START], START, [], len(self.path) - 1
        while True:
            edit = self.path[at][2][q]
            if edit == ".":
                return total, "".join(out)
            out.append(edit)
            if edit == "K" and q == START:
                q = SYSTEM if ROLES[(ord(self.symbols[at - 1]) - ord("A")) // len(FAULTS)] == "s" else USER
            elif edit != "D":
                q = FORCED[q]
            at -= edit != "I"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        signatures, costs, audits = [], [], []
        for reverse in batch.column(0).to_pylist():
            automaton.read(reverse)
            cost, audit = automaton.audit()
            signatures.append(reverse[::-1])
            costs.append(cost)
            audits.append(audit)
        yield pa.RecordBatch.from_arrays([pa.array(signatures, pa.string()), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=["s", "cost", "audit"])


def best_audits(signatures: DataFrame) -> DataFrame:
    """``s``, ``cost`` and ``audit`` of each distinct ``signature``."""
    distinct = kept(signatures.select(F.reverse("signature").alias("r")).distinct(), "signatures")
    ranges = 1 + distinct.count() // RANGE_ROWS
    return distinct.repartitionByRange(ranges, "r").sortWithinPartitions("r").mapInArrow(_audits, "s string, cost long, audit string")


def report(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None,
) -> DataFrame:
    """One row per conversation: ``conv_id``, fault counts, ``cost`` and ``audit`` of its cheapest repair."""
    rows = _prepared(turns, conv_id, turn, role, text, copies)
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    marked = rows.select(
        "conv", "turn", "h", "copies", F.left("role", F.lit(1)).alias("initial"), (last == "").alias("blank"), (~last.isin(*ENDINGS)).alias("cut"))
    light = kept(marked.groupBy("conv", "turn", "h", "initial", "blank", "cut").agg(F.sum("copies").alias("copies")), "turns")
    firsts = light.where("copies > 0").groupBy("conv", "h").agg(
        F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("first"))
    first = F.when(F.col("unnumbered"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first"))
    lettered = join_null_safe(light, firsts, ["conv", "h"]).select("conv", "turn", "h", _symbols(F.coalesce(first, F.lit(True))).alias("symbols"))
    key = turns.schema[conv_id].dataType.simpleString()
    ordered = lettered.repartition("conv").sortWithinPartitions("conv", "turn", "h").select("conv", "turn", "symbols")
    found = kept(ordered.mapInArrow(
        _signatures, f"conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"), "conversations")
    return found.join(best_audits(found).withColumnRenamed("s", "signature"), "signature").drop("signature")


def _ordered(turns: DataFrame, made: DataFrame, conv_id: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """The rows of each conversation behind one head row that holds its report."""
    rows = _prepared(turns, conv_id, turn, role, text, copies).withColumn("head", F.lit(False))
    heads = made.withColumnRenamed("conv_id", "conv").withColumn("head", F.lit(True))
    both = rows.unionByName(heads, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", F.desc("head"), "turn", "h")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per batch a list of heads (their rows as dicts) and repaired turns ``(role, text, edit)``, in order."""
    audit, at, q = "", 0, START

    def inserted():
        nonlocal at, q
        while audit[at:at + 1] == "I":
            at, q = at + 1, FORCED[q]
            yield NAMES[q], "", "I"

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["head"]:
                out.extend(inserted())
                audit, at, q = row["audit"], 0, START
                out.append(row)
                continue
            for _ in range(row["copies"]):
                out.extend(inserted())
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                q = SYSTEM if edit == "K" and q == START and row["role"][:1] == "s" else FORCED[q]
                out.append((row["role"] if edit == "K" else NAMES[q], row["text"], edit))
        yield out
    yield list(inserted())


def repaired(
    turns: DataFrame, made: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None,
) -> DataFrame:
    """The turns after repair: ``conv_id``, ``position`` (from 0), ``role``, ``text`` and ``edit`` (K, R or I). ``made`` is their ``report``."""
    ordered = _ordered(turns, made, conv_id, turn, role, text, copies)
    field = turns.schema[conv_id].dataType
    types = (to_arrow_type(field), pa.int64(), *[pa.string()] * 3)

    def rows(batches):
        conv, position = None, 0
        for found in _edits(batches):
            out = []
            for item in found:
                if isinstance(item, dict):
                    conv, position = item["conv"], 0
                else:
                    out.append((conv, position, *item))
                    position += 1
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv_id", "position", "role", "text", "edit"])

    return ordered.mapInArrow(rows, f"conv_id {field.simpleString()}, position long, role string, text string, edit string")


def digests(
    turns: DataFrame, made: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None,
) -> DataFrame:
    """``made`` with ``repaired_sha256``, the hash of the repaired turns ``role:text`` joined by newlines, taken as they stream by."""
    ordered = _ordered(turns, made, conv_id, turn, role, text, copies)
    field = turns.schema[conv_id].dataType
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    names = ("conv", *longs, "audit", "repaired_sha256")
    types = (to_arrow_type(field), *[pa.int64()] * len(longs), pa.string(), pa.string())

    def batch(done):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in done], t) for n, t in zip(names, types)], names=["conv_id", *names[1:]])

    def rows(batches):
        head, digest, started = None, None, False
        for found in _edits(batches):
            done = []
            for item in found:
                if isinstance(item, dict):
                    if head is not None:
                        done.append({**head, "repaired_sha256": digest.hexdigest()})
                    head, digest, started = item, hashlib.sha256(), False
                else:
                    digest.update((("\n" if started else "") + f"{item[0]}:{item[1]}").encode())
                    started = True
            yield batch(done)
        if head is not None:
            yield batch([{**head, "repaired_sha256": digest.hexdigest()}])

    return ordered.mapInArrow(rows, f"conv_id {field.simpleString()}, {REPORT}, repaired_sha256 string")
