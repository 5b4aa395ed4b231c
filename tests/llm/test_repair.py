"""Conversation repair against a search of all edit sequences, and on odd rows."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from tallymill.llm import repair
from tallymill.llm.targets import damaged_turns

WORDY = re.compile(r"[^\x20\x09-\x0D]")
CHOICES = ["Fine.", "Cut off", "", " \n", "Why?", "x\t", "é!"]


def turn_order(row):
    role, text = (" " if x is None else x for x in row[1:])
    return (row[0] is not None, row[0] or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest())


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = WORDY.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def all_repairs(rows, found):
    """Least (cost, audit) of every way to edit, with the turns it leaves, by plain recursion over places and the last role."""
    @functools.cache
    def best(i, last, inserts):
        options = []
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserts < 3:
            for c in nexts.replace("s", ""):
                cost, audit, left = best(i, c, inserts + 1)
                options.append((cost + 2, "I" + audit, ((dict(u="user", a="assistant")[c], ""), *left)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, left = best(i + 1, last, 0)
            options.append((cost + 3, "D" + audit, left))
            if found[i] not in ("blank", "duplicate"):
                late = found[i] == "truncated"
                if role[:1] and role[:1] in nexts:
                    cost, audit, left = best(i + 1, role[:1], 0)
                    options.append((cost + late, "K" + audit, ((role, text), *left)))
                for c in nexts.replace("s", ""):
                    cost, audit, left = best(i + 1, c, 0)
                    options.append((cost + late + 2, "R" + audit, ((dict(u="user", a="assistant")[c], text), *left)))
        return min(options, default=(10**9, "", ()))
    return best(0, "", 0)


def expected(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in sorted(rows, key=turn_order)]
    found = faults(rows)
    cost, audit, left = all_repairs(tuple(rows), found)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    legal = sum((a[1][:1] + b[1][:1]) in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{x}" for r, x in left)
    return (gaps, *[found.count(f) for f in ("blank", "duplicate", "truncated")], max(0, len(rows) - 1) - legal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest()), list(left)


def conversations(seed, n=150):
    r = random.Random(seed)
    rows = []
    for c in [None, *range(n)]:
        for _ in range(r.randrange(7)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c, r.choice([None, *range(9)]), role, r.choice([None, *CHOICES])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair_against_all_edit_sequences(spark):
    rows = conversations(1)
    df = spark.createDataFrame([(*x, "clash", 5, 1.0) for x in rows], SCHEMA + ", h string, cost long, conv double")
    made = repair.report(df)
    by = {}
    for c, *rest in rows:
        by.setdefault(c, []).append(tuple(rest))
    got = {x["conv_id"]: tuple(x)[1:] for x in repair.digests(df, made).collect()}
    assert got == {c: expected(v)[0] for c, v in by.items()}
    left = {}
    for x in sorted(repair.repaired(df, made).collect(), key=lambda x: x["position"]):
        assert x["position"] == len(left.setdefault(x["conv_id"], []))
        left[x["conv_id"]].append((x["role"], x["text"]))
    assert left == {c: e for c, v in by.items() if (e := expected(v)[1])}


def test_damage_and_copies(spark):
    rows = conversations(2, 400)
    df = spark.createDataFrame(rows, SCHEMA)
    by = {}
    for c, t, role, text in rows:
        kept = by.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        kept.extend([row] * (0 if kind == 0 else 2 if kind == 3 else 1))
    turns = damaged_turns(df)
    got = {x["conv_id"]: tuple(x)[1:] for x in repair.digests(turns, repair.report(turns, copies="copies"), copies="copies").collect()}
    assert any(not v for v in by.values())
    assert got == {c: expected(v)[0] for c, v in by.items()}


def test_endings_are_computed_once():
    signatures = sorted(("ABEI"[i % 4] + "EIEIEI" * 50 for i in range(4)), key=lambda s: s[::-1])
    automaton = repair.Automaton()
    for s in signatures:
        automaton.read(s[::-1])
    assert automaton.nodes == 1 + 300 + 4


def test_long_conversation_and_texts(spark):
    long = [(7, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(20_000)] + [(8, 0, "user", "Very long. " * 200_000)]
    df = spark.createDataFrame(long, SCHEMA)
    got = {x["conv_id"]: x for x in repair.digests(df, repair.report(df)).collect()}
    assert got[7]["cost"] == 0 and got[7]["audit"] == "K" * 20_000 and (got[8]["cost"], got[8]["audit"]) == (2, "KI")
    assert got[8]["repaired_sha256"] == hashlib.sha256(("user:" + "Very long. " * 200_000 + "\nassistant:").encode()).hexdigest()


def test_no_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    made = repair.report(df)
    assert made.collect() == [] and repair.digests(df, made).collect() == [] and repair.repaired(df, made).collect() == []
