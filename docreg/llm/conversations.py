"""Repair of conversation structure by Four-Russians block tables.

A conversation is repaired when the initials of its roles spell ``(s?(ua)+)?``. Each
row is one of ten symbols: what its role and its faults allow. The cheapest repair of
a suffix is a vector of four costs, one for each state of that pattern; as any state
reaches the others by a few inserted rows, the vector less its least entry is one of
few. So the transitions of all blocks of ``BLOCK`` symbols from all such vectors are
worked out once, and a conversation is processed from its end by one lookup a block.
The edits are traced from the front; a block is expanded backward from the vector
behind it, so of all cheapest repairs the one with the least text of initials is
taken at every step, and traced blocks are remembered too.

Faults are found by joins and aggregates. Whole repeats are counted before anything
is shuffled, and symbols travel as one byte a row, in chunks of sorted slices: a
conversation that holds a third of all rows is cut by many tasks, and only its bytes
meet where its costs are summed. Its rows stay spread until the repaired text is read
in order for the one digest that is asked of it, which streams.

Defined results: null roles and texts, and null ids and turns in the text that is
hashed, are one blank; rows without conversation are a conversation; rows of one turn
follow each other by role and the digest of their text, repeats side by side; the
initial of an empty role is empty; a conversation without rows after damage is kept
with zeros; other columns are not read; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreg.common import reliable
from docreg.llm.base import SPACES

#: Symbols to a block.
BLOCK = 4
#: Rows to a chunk of symbols.
CHUNK = 65_536
#: Costs of the edits, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States of the pattern: nothing yet, after s, after u, after a. What each may read,
#: and where that leads.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_MADE = ("u", "u", "a", "u")  # the one role that may be made up in each state
_DONE = (0, 3)
_FAR = 1 << 40
#: Symbols: a row that must go, role initials and other roles (whole or truncated), nothing.
_SYMBOLS = [("x", 0), *[(role, cut) for role in "sua?" for cut in (0, 1)], ("", 0)]
GONE, NOTHING = 0, len(_SYMBOLS) - 1
_ROLES = {"u": "user", "a": "assistant"}


def _closed(costs: list[int]) -> tuple[int, ...]:
    """The costs once rows may be inserted first."""
    costs = list(costs)
    for _ in range(2):
        for state, made in enumerate(_MADE):
            costs[state] = min(costs[state], INSERT + costs[_NEXT[state][made]])
    return tuple(costs)


def _before(symbol: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """The costs before a symbol, from those behind it."""
    role, cut = _SYMBOLS[symbol]
    if symbol == NOTHING:
        return costs
    own = [DELETE + c for c in costs]
    if symbol != GONE:
        for state, arcs in enumerate(_NEXT):
            own[state] = min(own[state], REROLE + cut * TRUNCATED + costs[arcs[_MADE[state]]])
            if role in arcs:
                own[state] = min(own[state], cut * TRUNCATED + costs[arcs[role]])
    return _closed(own)


class BlockTables:
    """Transitions of all blocks from all normalised cost vectors that can occur."""

    def __init__(self):
        last = _closed([0 if s in _DONE else _FAR for s in range(len(_NEXT))])
        self.vectors, self._ids, rows, costs = [], {}, [], []
        self.end, self.end_cost = self._id(last)
        at = 0
        while at < len(self.vectors):
            found = [self._id(_before(s, self.vectors[at])) for s in range(len(_SYMBOLS))]
            rows.append([f[0] for f in found])
            costs.append([f[1] for f in found])
            at += 1
        one, one_cost = np.array(rows), np.array(costs)
        to, cost = np.arange(at)[:, None], np.zeros((at, 1), np.int64)
        for _ in range(BLOCK):
            # a block is its first symbol before the block of the others
            cost = (cost[:, None, :] + one_cost[to].swapaxes(1, 2)).reshape(at, -1)
            to = one[to].swapaxes(1, 2).reshape(at, -1)
        self.to, self.cost = to.tolist(), cost.tolist()
        self._places = np.array([len(_SYMBOLS) ** k for k in reversed(range(BLOCK))])
        self._traced: dict[tuple[int, int, int], tuple[str, int]] = {}

    def _id(self, costs: tuple[int, ...]) -> tuple[int, int]:
        low = min(costs)
        vector = tuple(c - low for c in costs)
        if vector not in self._ids:
            self._ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self._ids[vector], low

    def _trace(self, code: int, behind: int, state: int) -> tuple[str, int]:
        """The initials of a block's edits from a state, and the state after it."""
        found = self._traced.get((code, behind, state))
        if found is None:
            symbols = [code // int(p) % len(_SYMBOLS) for p in self._places]
            costs = [self.vectors[behind]]
            for symbol in reversed(symbols):
                costs.append(_before(symbol, costs[-1]))
            costs.reverse()
            edits, now = [], state
            for i, symbol in enumerate(symbols):
                if symbol != NOTHING:
                    now = self._edit(symbol, costs[i], costs[i + 1], now, edits)
            found = self._traced[code, behind, state] = ("".join(edits), now)
        return found

    @staticmethod
    def _edit(symbol: int, here: tuple[int, ...], behind: tuple[int, ...], state: int, edits: list[str]) -> int:
        """The least of the cheapest edits up to the one that takes the symbol."""
        role, cut = _SYMBOLS[symbol]
        while True:
            made = _NEXT[state][_MADE[state]]
            if here[state] == DELETE + behind[state]:
                edits.append("D")
                return state
            if here[state] == INSERT + here[made]:
                edits.append("I")
                state = made
                continue
            if symbol != GONE and role in _NEXT[state] and here[state] == cut * TRUNCATED + behind[_NEXT[state][role]]:
                edits.append("K")
                return _NEXT[state][role]
            edits.append("R")
            return made

    def repair(self, symbols: np.ndarray) -> tuple[int, str]:
        """Least cost of a repair, and its edits."""
        codes = np.concatenate([np.full(-len(symbols) % BLOCK, NOTHING, np.uint8), symbols]).reshape(-1, BLOCK) @ self._places
        vector, total, behind = self.end, self.end_cost, []
        for code in codes[::-1].tolist():
            behind.append(vector)
            total += self.cost[vector][code]
            vector = self.to[vector][code]
        total += self.vectors[vector][0]
        edits, state = [], 0
        for code in codes.tolist():
            piece, state = self._trace(code, behind.pop(), state)
            edits.append(piece)
        edits.append({0: "", 3: "", 2: "I", 1: "II"}[state])
        return total, "".join(edits)


@lru_cache(maxsize=1)
def block_tables() -> BlockTables:
    return BlockTables()


# --- damage and faults


def damaged(conversations: DataFrame, parts: int = 20) -> DataFrame:
    """(conv_id, turn, role, text, n) after damage: by the hash of conversation and
    turn a row is dropped, loses its text or its full stops, is there twice, or
    becomes the user's."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")), F.lit(parts)).alias("_h")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text"), h).where("_h <> 0")
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_h") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_h") == 3, 2).otherwise(1).alias("n"))


def _digested(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.sha2("text", 256))


def row_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, initial, blank, cut, first) per distinct row:
    ``n`` rows like it, and whether the first of them is the first of its text."""
    bare = F.rtrim("text", F.lit(SPACES))
    flags = _digested(rows).select(
        "conv_id", "turn", "role", "digest", "n", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut")
    )
    distinct = flags.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    distinct = reliable(distinct)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = distinct.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("_times")).where("_times > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    return distinct.join(again, same, "left").select(
        "conv_id", "turn", "role", "digest", "n", F.substring("role", 1, 1).alias("initial"), "blank", "cut",
        (F.col("first").isNull() | F.col("first.turn").eqNullSafe(F.col("turn"))).alias("first"),
    )


# --- chunks of symbols, and the costs of whole conversations


def _chunk(rows: list[dict]) -> dict:
    """Rows of one conversation in order as symbols and counts."""
    symbols, counts = [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    before = None
    for r in rows:
        n = r["n"]
        kept = r["first"] and not r["blank"]
        symbols.append((1 + 2 * "sua".index(r["initial"]) if r["initial"] in ("s", "u", "a") else 7) + r["cut"] if kept else GONE)
        symbols += [GONE] * (n - 1)
        counts["blank"] += n if r["blank"] else 0
        counts["duplicate"] += 0 if r["blank"] else n - r["first"]
        counts["truncated"] += kept and r["cut"]
        counts["illegal"] += n - 1 + (before is not None and before + r["initial"] not in ("su", "ua", "au"))
        before = r["initial"]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    return {
        "conv_id": rows[0]["conv_id"], "turn": rows[0]["turn"], "role": rows[0]["role"], "digest": rows[0]["digest"], "part": rows[0].get("part", 0),
        "symbols": bytes(symbols), "head": rows[0]["initial"], "tail": before, "low": min(turns, default=None), "high": max(turns, default=None),
        "turns": len(set(turns)), **counts,
    }


_CHUNK = "turn long, role string, digest string, part long, symbols binary, head string, tail string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long"


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 1024, size=lambda r: 0) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += size(r)
        if len(held) >= most or weight > 1 << 24:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _ordered(*ahead: str) -> list:
    return [*ahead, F.col("turn").asc_nulls_first(), "role", "digest"]


def symbol_chunks(faults: DataFrame) -> DataFrame:
    """Sorted slices of the rows, each conversation of a slice as symbols of ``CHUNK``
    rows at most (whole repeats count as one row of it)."""
    ddl = f"conv_id {faults.schema['conv_id'].dataType.simpleString()}, {_CHUNK}"
    schema = _arrow(faults.sparkSession, ddl)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for _, rows in groupby(_rows_of(batches), key=lambda r: r["conv_id"]):
                held, size = [], 0
                for r in rows:
                    # very many repeats of one row are handed on in parts
                    while r["n"] > CHUNK:
                        if held:
                            yield _chunk(held)
                        held = []
                        yield _chunk([{**r, "n": CHUNK}])
                        r = {**r, "n": r["n"] - CHUNK, "first": False, "part": r.get("part", 0) + 1}
                    if held and size + r["n"] > CHUNK:
                        yield _chunk(held)
                        held = []
                    size = r["n"] + (size if held else 0)
                    held.append(r)
                if held:
                    yield _chunk(held)

        yield from _batched(each(), schema, size=lambda r: len(r["symbols"]))

    slices = faults.repartitionByRange(*_ordered("conv_id")).sortWithinPartitions(*_ordered("conv_id"))
    return slices.mapInArrow(chunks, ddl)


_AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audited(conv_id, chunks: list[dict]) -> dict:
    real = [c for c in chunks if c["symbols"]]
    cost, audit = block_tables().repair(np.frombuffer(b"".join(c["symbols"] for c in real), np.uint8)) if real else (0, "")
    pairs = list(zip(real, real[1:]))
    low, high = min((c["low"] for c in real if c["low"] is not None), default=None), max((c["high"] for c in real if c["high"] is not None), default=None)
    turns = sum(c["turns"] for c in real) - sum(a["high"] is not None and a["high"] == b["low"] for a, b in pairs)
    total = lambda name: sum(c[name] for c in real)
    return {
        "conv_id": conv_id, "gaps": 0 if low is None else high - low + 1 - turns, "blank": total("blank"), "duplicate": total("duplicate"),
        "truncated": total("truncated"), "illegal": total("illegal") + sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in pairs),
        "cost": cost, "audit": audit,
    }


def audit_conversations(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations``: counts of faults in ``rows``,
    cost and edits of the cheapest repair."""
    chunks = symbol_chunks(row_faults(rows))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in chunks.schema.fields if f.name not in ("conv_id", "symbols")]
    empty = conversations.select("conv_id").distinct().select("conv_id", *nothing, F.lit(b"").alias("symbols"))
    all_chunks = chunks.unionByName(empty)
    ddl = f"conv_id {chunks.schema['conv_id'].dataType.simpleString()}, {_AUDIT}"
    schema = _arrow(chunks.sparkSession, ddl)

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (_audited(conv_id, list(rows)) for conv_id, rows in groupby(_rows_of(batches), key=lambda r: r["conv_id"]))
        yield from _batched(each, schema, size=lambda r: len(r["audit"]))

    return all_chunks.repartition("conv_id").sortWithinPartitions(*_ordered("conv_id"), "part").mapInArrow(audits, ddl)


# --- the repaired rows


def _repaired(audit: str, rows: Iterator[dict]) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that the edits make of a conversation's rows."""
    made = len(audit) - audit.count("D")
    at = made % 2  # an odd number begins with a system row
    place = 0
    parity = -at

    def role() -> str:
        return "user" if parity % 2 == 0 else "assistant"

    for r in rows:
        for _ in range(r["n"]):
            while audit[place] == "I":
                yield role(), ""
                parity, place = parity + 1, place + 1
            edit = audit[place]
            place += 1
            if edit == "D":
                continue
            yield (r["role"] if edit == "K" else role()), r["text"]
            parity += 1
    for _ in audit[place:]:
        yield role(), ""
        parity += 1


def _beside_audits(audits: DataFrame, rows: DataFrame) -> DataFrame:
    """Each conversation's audit row, then its rows in order."""
    texts = _digested(rows).withColumn("_own", F.lit(1))
    heads = audits.withColumn("_own", F.lit(0))
    both = heads.unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(*_ordered("conv_id", "_own"))


def _conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    for _, rows in groupby(_rows_of(batches), key=lambda r: r["conv_id"]):
        head = next(rows)
        yield head, _repaired(head["audit"], rows)


def repaired_rows(audits: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, position, role, text) of the repaired conversations."""
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, position long, role string, text string"
    schema = _arrow(rows.sparkSession, ddl)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (
            {"conv_id": head["conv_id"], "position": i, "role": role, "text": text}
            for head, found in _conversations_of(batches) for i, (role, text) in enumerate(found)
        )
        yield from _batched(each, schema, size=lambda r: len(r["text"]))

    return _beside_audits(audits, rows).mapInArrow(repaired, ddl)


def repair_digest(conversations: DataFrame) -> DataFrame:
    """Every conversation after damage: faults, cost, edits, and the digest of what
    the edits make of it."""
    rows = damaged(conversations)
    audits = reliable(audit_conversations(conversations, rows))
    ddl = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, {_AUDIT}, repaired_sha256 string"
    schema = _arrow(conversations.sparkSession, ddl)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for head, found in _conversations_of(batches):
                digest = sha256()
                for i, (role, text) in enumerate(found):
                    digest.update((("\n" if i else "") + role + ":" + text).encode("utf-8"))
                yield {name: head.get(name, digest.hexdigest()) for name in schema.names}

        yield from _batched(each(), schema, size=lambda r: len(r["audit"]))

    return _beside_audits(audits, rows).mapInArrow(digests, ddl)
