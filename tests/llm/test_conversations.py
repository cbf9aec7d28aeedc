"""Conversation repair against plain rules, block tables against a search of all edits."""

import random
import zlib
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pytest

from docreg.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 1:
            text = ""
        elif h == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def plain_edits(rows):
    """Least (cost, initials) by trying every edit; rows are (initial, must go, cut)."""
    arcs = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]

    @lru_cache(None)
    def least(i, state, made):
        if made > len(rows) * 2 + 4:
            return (1 << 30, "")
        found = []
        if i == len(rows) and state in (0, 3):
            found.append((0, ""))
        for role in "ua":
            if role in arcs[state]:
                cost, rest = least(i, arcs[state][role], made + 1)
                found.append((cost + 2, "I" + rest))
        if i < len(rows):
            initial, gone, cut = rows[i]
            cost, rest = least(i + 1, state, made)
            found.append((cost + 3, "D" + rest))
            if not gone:
                for role, to in arcs[state].items():
                    cost, rest = least(i + 1, to, made)
                    if role == initial:
                        found.append((cost + cut, "K" + rest))
                    if role in "ua":
                        found.append((cost + 2 + cut, "R" + rest))
        return min(found, default=(1 << 30, ""))

    return least(0, 0, 0)


def plain_repair(rows):
    want = {}
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in plain_damage(rows) if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(SPACES)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = plain_edits(tuple((r[1][:1], f in ("blank", "duplicate"), int(f == "truncated")) for r, f in zip(own, faults)))
        made = len(audit.replace("D", ""))
        out, at, k = [], 0, -(made % 2)
        for e in audit:
            _, role, text = own[at] if e != "I" else (None, "", "")
            at += e != "I"
            if e != "D":
                out.append((role if e == "K" else ("user", "assistant")[k % 2]) + ":" + text)
                k += 1
        turns = {r[0] for r in own} - {None}
        initials = [r[1][:1] for r in own]
        want[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha256("\n".join(out).encode()).hexdigest(),
        )
    return want


def random_rows(seed, convs, turns=9):
    rng = random.Random(seed)
    texts = ["Yes.", "Yes.", "No!", "why", "why ", "", " \t\n", None, "a. b", "Is it?\n", "é", "end. ", " "]
    rows = []
    for c in range(convs):
        n = rng.randint(1, turns)
        for t in range(n):
            turn = None if rng.random() < 0.05 else rng.choice((t, t, t, t + 3, 0))
            rows.append((None if c == 3 else c, turn, rng.choice(("system", "user", "assistant", "user", "assistant", "tool", "", None)), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("chunk", [3, cv.CHUNK])
def test_random_conversations(spark, monkeypatch, chunk):
    monkeypatch.setattr(cv, "CHUNK", chunk)
    rows = random_rows(chunk, 120)
    rows += rows[:40]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS audit", "1 AS n", "'y' AS digest")
    got = {r.conv_id: tuple(r)[1:] for r in cv.repair_digest(df.repartition(5)).collect()}
    assert got == plain_repair(rows)


def test_all_rows_dropped_and_no_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.")], SCHEMA)
    assert [tuple(r) for r in cv.repair_digest(df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]
    assert cv.repair_digest(df.limit(0)).count() == 0


def test_one_conversation_with_most_rows(spark, monkeypatch):
    """Very many whole repeats, and a long conversation that many slices share."""
    monkeypatch.setattr(cv, "CHUNK", 50)
    rng = random.Random(2)
    rows = [(1, t, ("user", "assistant")[t % 2], rng.choice(("Yes.", f"Row {t}.", f"cut {t}"))) for t in range(400)] + [(1, 7, "user", "again.")] * 333 + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    hurt = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", n long")
    parts = cv.symbol_chunks(cv.row_faults(hurt)).where("conv_id = 1").collect()
    assert len(parts) > 14 and all(len(p.symbols) <= 50 for p in parts)
    got = {r.conv_id: tuple(r)[1:] for r in cv.repair_digest(df).collect()}
    damaged = plain_damage(rows)
    audit = got[1][6]
    assert len(audit.replace("I", "")) == sum(r[0] == 1 for r in damaged)
    # the same conversation by one table lookup a symbol
    symbols = np.concatenate([np.frombuffer(p.symbols, np.uint8) for p in sorted(
        cv.symbol_chunks(cv.row_faults(cv.damaged(df))).where("conv_id = 1").collect(),
        key=lambda p: (p.turn is not None, p.turn or 0, p.role, p.digest, p.part))])
    costs = cv.block_tables().vectors[cv.block_tables().end]
    for s in symbols[::-1]:
        costs = cv._before(int(s), costs)
    assert got[1][5] == costs[0]


def test_block_tables_against_every_edit():
    rng = random.Random(9)
    tables = cv.block_tables()
    for _ in range(3000):
        symbols = [rng.randrange(9) for _ in range(rng.randint(0, 11))]
        rows = tuple((cv._SYMBOLS[s][0], s == cv.GONE, cv._SYMBOLS[s][1]) for s in symbols)
        assert tables.repair(np.array(symbols, np.uint8)) == plain_edits(rows), symbols


def test_repaired_rows_are_real_conversations(spark):
    rows = random_rows(5, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    hurt = cv.damaged(df)
    audits = cv.audit_conversations(df, hurt)
    found = {}
    for r in cv.repaired_rows(audits, hurt).collect():
        found.setdefault(r.conv_id, []).append((r.position, r.role, r.text))
    want = {k: v[-1] for k, v in plain_repair(rows).items()}
    for conv, digest in want.items():
        lines = [f"{role}:{text}" for _, role, text in sorted(found.get(conv, []))]
        assert sha256("\n".join(lines).encode()).hexdigest() == digest
