"""Repair of conversations: the cheapest edits that give each one the order system, user, assistant, user, assistant, ...

Rows of a conversation are taken by turn (nulls first; rows of one turn by role, then by the SHA-256 of the text). The first fault
of a row counts: blank, duplicate (role and text came before), truncated (the last character that is no white space is none of
`.!?`). Keeping a row costs nothing, another role 1, deleting it 2 (which blank rows and duplicates need), an inserted empty row
5, and a truncated row that stays 5. What is left has to match `(s?(ua)+)?` in the initials of its roles. Of the cheapest edits,
those whose initials (D, I, K, R) come first in ASCII order are taken.

Texts are reduced to two flags and a digest before anything is shuffled; equal rows of a turn become one with a count. The rows
are then sorted by range, so a conversation of any length is spread over tasks, and cut into segments of `SEGMENT` rows. The
search itself takes one byte a row: backward, the costs of the four states are kept at every sqrt(n)-th row only; forward, each
block's costs are computed again from the checkpoint at its end, and the first tight edit in ASCII order is taken at each row.
The few vectors of costs that occur, up to a constant, are remembered with what follows from them. Longer conversations
yield their edits in pieces, and texts join these at the end.

Null ids of conversations are one conversation, null roles and texts are one space; a row with an empty role cannot be kept as it is. Rows without a turn come first and do not count
in gaps. A conversation without rows has no result; an empty table gives no rows. Ids may have any type that can be sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelayer.llm.texts import importable, lean, written

BLANKS = " \t\n\x0b\x0c\r"
CLOSING = (".", "!", "?")
SEGMENT = 4096
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLES = "suax"  # initials; x stands for all others
# States: nothing yet, after a system row, after a user row, after an assistant row. What each initial leads to.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NAMES = {"u": "user", "a": "assistant"}
INSERT, DELETE, RENAME, OPEN_END = 5, 2, 1, 5


class Step(NamedTuple):
    """What one state does at one row: inserted roles, the row's letter, its new role (if any), whether it stays, the next state."""

    inserted: tuple[str, ...]
    letter: str
    role: str | None
    stays: bool
    state: int


def _insertion(state: int) -> tuple[str, int]:
    return ("a", 3) if state == 2 else ("u", 2)


def _relaxed(costs: list[int]) -> tuple[int, ...]:
    """Costs when rows may be inserted first."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[_insertion(s)[1]]) for s, c in enumerate(costs)]
    return tuple(costs)


END = _relaxed([0, 1000, 1000, 0])
_known: dict[tuple[int, tuple[int, ...]], tuple[tuple[int, ...], int, tuple[Step, ...]]] = {}


def _options(symbol: int, after: tuple[int, ...], state: int) -> list[tuple[int, Step]]:
    """Edits of a row in one state in ASCII order of their letters, with the cost from there on."""
    role, fault = ROLES[symbol & 3], symbol >> 2
    found = [(DELETE + after[state], Step((), "D", None, False, state))]
    if fault in (FINE, TRUNCATED):
        extra = OPEN_END if fault == TRUNCATED else 0
        if state in NEXT.get(role, {}):
            found.append((extra + after[NEXT[role][state]], Step((), "K", None, True, NEXT[role][state])))
        for new in "ua":
            if state in NEXT[new]:
                found.append((RENAME + extra + after[NEXT[new][state]], Step((), "R", NAMES[new], True, NEXT[new][state])))
    return found


def step(symbol: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int, tuple[Step, ...]]:
    """Costs before a row (the least of them taken off, and that one), and the first tight edits of each state.

    `after` are the costs behind the row with their least taken off; few different ones occur, so they are remembered.
    """
    if (found := _known.get((symbol, after))) is None:
        options = [_options(symbol, after, s) for s in range(4)]
        costs = _relaxed([min(c for c, _ in o) for o in options])
        steps = []
        for state in range(4):
            inserted: list[str] = []
            at = state
            while True:
                tight = [s for c, s in options[at] if c == costs[at]]
                new, to = _insertion(at)
                may_insert = costs[at] == INSERT + costs[to]
                if tight and (tight[0].letter == "D" or not may_insert):
                    steps.append(tight[0]._replace(inserted=tuple(inserted)))
                    break
                inserted.append(NAMES[new])
                at = to
        least = min(costs)
        found = _known[(symbol, after)] = tuple(c - least for c in costs), least, tuple(steps)
    return found


def edits(symbols: bytes) -> Iterator[int | Step]:
    """The whole cost, then the step at each row and a last one behind all rows."""
    n = len(symbols)
    size = isqrt(n) + 1
    least = min(END)
    costs, total = tuple(c - least for c in END), least
    checkpoints = [costs]
    for k in range(n - 1, -1, -1):
        costs, more, _ = step(symbols[k], costs)
        total += more
        if k % size == 0:
            checkpoints.append(costs)
    checkpoints.pop()
    yield total + costs[0]
    state = 0
    for begin in range(0, n, size):
        block, costs, todo = symbols[begin : begin + size], checkpoints.pop(), []
        for symbol in reversed(block):
            costs, _, steps = step(symbol, costs)
            todo.append(steps)
        for steps in reversed(todo):
            now = steps[state]
            state = now.state
            yield now
    inserted = []
    while END[state]:
        new, state = _insertion(state)
        inserted.append(NAMES[new])
    yield Step(tuple(inserted), "", None, False, state)


class Repair(NamedTuple):
    """`turns`: the rows; `keys`: distinct rows in order, with a `place` each; `edits`: pieces of the edits of each conversation."""

    turns: DataFrame
    keys: DataFrame
    edits: DataFrame


EDITS = (
    "piece BIGINT, audit STRING, messages ARRAY<STRUCT<place: BIGINT, role: STRING>>, "
    "stats STRUCT<gaps: BIGINT, blank: BIGINT, duplicate: BIGINT, truncated: BIGINT, illegal: BIGINT, cost: BIGINT>"
)


def _faults(text: Column) -> tuple[Column, Column]:
    solid = F.rtrim(text, F.lit(BLANKS))
    return F.length(solid) == 0, ~F.substring(solid, -1, 1).isin(*CLOSING)


def plan_repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """Finds the edits of all conversations."""
    importable(conversations.sparkSession)
    space = F.lit(" ")
    turns = conversations.select(
        F.struct(F.col(conv_col).alias("id")).alias("conv"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col), space).alias("role"),
        F.coalesce(F.col(text_col), space).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    blank, truncated = _faults(F.col("text"))
    facts = turns.select("conv", "turn", "role", "digest", blank.alias("blank"), truncated.alias("truncated"))
    keys = facts.groupBy("conv", "turn", "role", "digest", "blank", "truncated").agg(F.count(F.lit(1)).alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    again = keys.groupBy("conv", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    fault = (
        F.when(F.col("blank"), BLANK)
        .when(F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn")), DUPLICATE)
        .when(F.col("truncated"), TRUNCATED)
        .otherwise(FINE)
    )
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES[:3])), F.substring("role", 1, 1)) - 1, F.lit(3))
    initial = F.when(initial < 0, 3).otherwise(initial)
    order = ["conv", "turn", "role", "digest"]
    ranged = keys.join(again, ["conv", "role", "digest"], "left").select(*order, (fault * 4 + initial).cast("int").alias("symbol"), "copies")
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order)
    keys = written(ranged.withColumn("place", F.monotonically_increasing_id()), "conversation-keys")
    segment = F.floor(F.col("place") / SEGMENT)
    rows = F.sort_array(F.collect_list(F.struct("place", "turn", "symbol", "copies")))
    segments = keys.groupBy("conv", segment.alias("segment")).agg(rows.alias("rows"))
    segments = segments.repartition(F.col("conv")).sortWithinPartitions("conv", "segment")
    schema = T.StructType([segments.schema["conv"], *T.StructType.fromDDL(EDITS).fields])
    return Repair(turns, keys, written(segments.mapInArrow(lean(_repaired), schema), "conversation-edits"))


class _Conversation:
    """One conversation while its segments come in: a byte a row, and what its rows say about turns."""

    def __init__(self, conv: dict):
        self.conv, self.symbols, self.places = conv, bytearray(), []
        self.turns, self.least, self.last = 0, None, None

    def add(self, rows: list[dict]) -> None:
        first = len(self.symbols)
        for row in rows:
            symbol, turn = row["symbol"], row["turn"]
            self.symbols.append(symbol)
            if row["copies"] > 1:  # all but the first are duplicates, or as blank as the first
                self.symbols.extend(bytes([symbol if symbol >> 2 == BLANK else DUPLICATE * 4 + (symbol & 3)]) * (row["copies"] - 1))
            if turn is not None and turn != self.last:
                self.turns += 1
                self.least = turn if self.least is None else self.least
                self.last = turn
        self.places.append((first, rows[0]["place"], [r["copies"] for r in rows] if any(r["copies"] > 1 for r in rows) else None))

    def row_places(self) -> Iterator[int]:
        for k, (first, place, copies) in enumerate(self.places):
            end = self.places[k + 1][0] if k + 1 < len(self.places) else len(self.symbols)
            if copies is None:
                yield from range(place, place + end - first)
            else:
                for i, c in enumerate(copies):
                    for _ in range(c):
                        yield place + i

    def pieces(self) -> Iterator[dict]:
        symbols = bytes(self.symbols)
        roles, faults = symbols.translate(bytes(b"suax"[k & 3] for k in range(256))), symbols.translate(bytes(k >> 2 for k in range(256)))
        legal = sum(roles[k : k + 2] in (b"su", b"ua", b"au") for k in range(len(roles) - 1))
        steps = edits(symbols)
        stats = {"gaps": self.last - self.least + 1 - self.turns if self.turns else 0}
        stats |= {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED)}
        stats |= {"illegal": len(roles) - 1 - legal, "cost": next(steps)}
        places, letters, messages, piece = self.row_places(), [], [], 0
        for k, now in enumerate(steps):
            letters.append("I" * len(now.inserted) + now.letter)
            messages += [{"place": None, "role": r} for r in now.inserted]
            place = next(places, None)
            if now.stays:
                messages.append({"place": place, "role": now.role})
            if len(letters) == SEGMENT or k == len(symbols):
                yield {"conv": self.conv, "piece": piece, "audit": "".join(letters), "messages": messages, "stats": None if piece else stats}
                letters, messages, piece = [], [], piece + 1


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of conversations whose segments come one after the other, in order."""
    kind: pa.DataType | None = None
    now: _Conversation | None = None
    out: list[dict] = []

    def flushed(most: int) -> Iterator[pa.RecordBatch]:
        if len(out) > most:
            yield _packed(out, kind)
            out.clear()

    for batch in batches:
        kind = batch.schema.field("conv").type
        for conv, rows in zip(batch.column("conv").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            if now is None or now.conv != conv:
                for piece in now.pieces() if now else ():
                    out.append(piece)
                    yield from flushed(1000)
                now = _Conversation(conv)
            now.add(rows)
    for piece in now.pieces() if now else ():
        out.append(piece)
        yield from flushed(1000)
    yield from flushed(0)


def _packed(rows: list[dict], conv: pa.DataType) -> pa.RecordBatch:
    whole = pa.int64()
    stats = pa.struct([(c, whole) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])
    messages = pa.list_(pa.struct([("place", whole), ("role", pa.string())]))
    kinds = {"conv": conv, "piece": whole, "audit": pa.string(), "messages": messages, "stats": stats}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], names=list(kinds))


def audits(repair: Repair) -> DataFrame:
    """`conv_id`, the counts, `cost` and `audit` (the initials of all edits in order) of each conversation."""
    pieces = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "audit"))), lambda p: p["audit"]), "")
    whole = repair.edits.groupBy("conv").agg(F.max("stats").alias("stats"), pieces.alias("audit"))
    return whole.select("conv.id", "stats.*", "audit").withColumnRenamed("id", "conv_id")


def repaired_turns(repair: Repair) -> DataFrame:
    """`conv_id`, `piece` and `position` (the order within), `role` and `text` of what is left; inserted rows have an empty text."""
    messages = repair.edits.select("conv", "piece", F.posexplode("messages").alias("position", "message")).select("conv", "piece", "position", "message.*")
    keys = repair.keys.select("place", F.col("role").alias("old"), "digest")
    texts = repair.turns.groupBy("conv", F.col("role").alias("old"), "digest").agg(F.first("text").alias("text"))
    kept = messages.where("place IS NOT NULL").join(keys, "place").join(texts, ["conv", "old", "digest"])
    kept = kept.select("conv.id", "piece", "position", F.coalesce("role", "old").alias("role"), "text")
    added = messages.where("place IS NULL").select("conv.id", "piece", "position", "role", F.lit("").alias("text"))
    return kept.unionByName(added).withColumnRenamed("id", "conv_id")


def conversation_digests(rows: DataFrame) -> DataFrame:
    """`conv_id` and `sha256` of its `role:text`, joined by newlines. Rows come in order and are hashed one after the other: a hash
    of a conversation is a sequence by its nature, but no more than a batch of rows is held."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kind, done = None, None, None, []
        for batch in batches:
            kind = batch.schema.field("conv").type
            for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], names=["conv", "sha256"])
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()])], names=["conv", "sha256"])

    conv = F.struct(F.col("conv_id").alias("id")).alias("conv")
    lines = rows.select(conv, "piece", "position", F.concat_ws(":", "role", "text").alias("line"))
    lines = lines.repartition(F.col("conv")).sortWithinPartitions("conv", "piece", "position").select("conv", "line")
    schema = T.StructType([lines.schema["conv"], T.StructField("sha256", T.StringType())])
    return lines.mapInArrow(lean(hashed), schema).select(F.col("conv.id").alias("conv_id"), "sha256")
