"""Cheapest repair of conversations whose roles must read: nothing, or an optional system turn and then pairs of user and assistant.

The grammar has four states: at the start, after the system turn, after a user turn, after an assistant turn; the first and the last may end. For each cost 0, 1, 2, ...
a layer holds, for every place between turns, the bitset of states from which the rest can be brought to an end at just that cost: a kept turn leads into its own
layer, an edit into the layer less its cost. The first layer that has the start at place 0 gives the cost. The audit is then read off the layers' bits from the front,
the least letter first. Long conversations are solved in blocks of BLOCK turns from the last to the first, each beginning with the costs at its end, so that work is in proportion to turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import trimmed

#: Turns of a block.
BLOCK = 64
START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
ENDS = START | ASSISTANT
#: Roles as codes: any other, system, user, assistant. A turn's code has DELETED and LATE beside.
ROLES, DELETED, LATE = " sua", 4, 8
#: Where a turn of a role leads from each state, and where any user or assistant turn leads: there is just one such turn that fits.
STEP = ({}, {START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT})
ANY = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


def _back(step: dict[int, int]) -> list[int]:
    """For each bitset the states that ``step`` leads from into it."""
    return [sum(a for a, b in step.items() if b & states) for states in range(16)]


BACK, BACK_ANY = [_back(s) for s in STEP], _back(ANY)


@dataclass(frozen=True)
class Costs:
    """What edits cost; a turn that breaks off costs ``late`` more unless it is deleted."""

    rerole: int = 3
    delete: int = 4
    insert: int = 3
    late: int = 3


def _layers(codes: bytes, lo: int, hi: int, ends: dict[int, int], last: bool, costs: Costs, full: bool) -> tuple[list[list[int]], dict[int, int]]:
    """The layers of turns lo to hi, the first for the least of ``ends`` (state: cost from ``hi`` on), and the cost from ``lo`` on for each state.

    Layers stop once the start is met, or with ``full`` all states. Insertions at ``hi`` belong to the next block unless this is the last.
    """
    n, base = hi - lo, min(ends.values())
    layers: list[list[int]] = []
    met: dict[int, int] = {}
    wanted = START | SYSTEM | USER | ASSISTANT if full else START
    none = [0] * (n + 1)
    c = 0
    while wanted & ~sum(met):
        new = [0] * (n + 1)
        inserted = layers[c - costs.insert] if c >= costs.insert else none
        deleted = layers[c - costs.delete] if c >= costs.delete else none
        reroled, late_reroled = (layers[c - x] if c >= x else none for x in (costs.rerole, costs.rerole + costs.late))
        late = (layers[c - costs.late] if c >= costs.late else none) if costs.late else new
        x = sum(s for s, v in ends.items() if v == base + c)
        new[n] = x | BACK_ANY[inserted[n]] if last else x
        for i in range(n - 1, -1, -1):
            code = codes[lo + i]
            x = BACK_ANY[inserted[i]] | deleted[i + 1]
            if not code & DELETED:
                kept, other = (late, late_reroled) if code & LATE else (new, reroled)
                x |= BACK[code & 3][kept[i + 1]] | BACK_ANY[other[i + 1]]
            new[i] = x
        layers.append(new)
        for s in (START, SYSTEM, USER, ASSISTANT):
            if new[0] & s and s not in met:
                met[s] = c
        c += 1
    return layers, {s: base + v for s, v in met.items()}


def solve(codes: bytes, costs: Costs = Costs()) -> tuple[int, str]:
    """The least cost, and of the cheapest audits (D, I, K and R in order) the ASCII-least. codes: a byte a turn, role code and marks."""
    bounds = [*range(0, len(codes), BLOCK), len(codes)] if codes else [0, 0]
    ends = [{}] * (len(bounds) - 1) + [{START: 0, ASSISTANT: 0}]
    layers = None
    for b in range(len(bounds) - 2, -1, -1):
        layers, ends[b] = _layers(codes, bounds[b], bounds[b + 1], ends[b + 1], b == len(bounds) - 2, costs, b > 0)
    cost, out, state, left = ends[0][START], [], START, ends[0][START]
    for b, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        last = b == len(bounds) - 2
        if b:
            layers, _ = _layers(codes, lo, hi, ends[b + 1], last, costs, True)
        base = min(ends[b + 1].values())
        i, n = 0, hi - lo
        while i < n or last and (left or not state & ENDS):
            c = left - base
            fits = lambda spent, place, to: spent <= c and layers[c - spent][place] & to  # noqa: B023, E731
            code = codes[lo + i] if i < n else DELETED
            more = costs.late if code & LATE else 0
            if i < n and fits(costs.delete, i + 1, state):
                letter, spent, to, i = "D", costs.delete, state, i + 1
            elif fits(costs.insert, i, ANY[state]):
                letter, spent, to = "I", costs.insert, ANY[state]
            elif not code & DELETED and fits(more, i + 1, STEP[code & 3].get(state, 0)):
                letter, spent, to, i = "K", more, STEP[code & 3][state], i + 1
            else:
                letter, spent, to, i = "R", costs.rerole + more, ANY[state], i + 1
            out.append(letter)
            state, left = to, left - spent
    return cost, "".join(out)


#: Why a turn is at fault, its first fault only.
FAULTS = ("blank", "duplicate", "truncated")
ROW, SLIM, GONE = 1, 0, -1


def faults(turns: DataFrame, conv: str, turn: str, role: str, text: str, here: Column) -> DataFrame:
    """``turns`` with ``fault``: blank, duplicate or truncated, or null; of equal turns all but the first by turn are duplicates."""
    solid = F.substring(F.rtrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    same = Window.partitionBy(conv, "here", role, text).orderBy(F.col(turn).asc_nulls_first())
    nth = F.row_number().over(same)
    fault = F.when(solid == "", FAULTS[0]).when(nth > 1, FAULTS[1]).when(~solid.isin(".", "!", "?"), FAULTS[2])
    return turns.withColumn("here", here).withColumn("fault", F.when(F.col("here"), fault))


def _prepared(turns: DataFrame, conv: str, turn: str, role: str, text: str, here: Column | None) -> DataFrame:
    """Rows by conversation: first a slim one for each turn, then each turn with its text, both in order."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), F.coalesce(F.lit(True) if here is None else here, F.lit(False)).alias("here"))
    rows = faults(rows.repartition("conv"), "conv", "turn", "role", "text", F.col("here"))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0) + F.when(F.col("fault").isin("blank", "duplicate"), DELETED).when(F.col("fault") == "truncated", LATE).otherwise(0)
    code = code + F.when(F.col("fault") == "duplicate", 16).otherwise(0)
    passes = F.when(F.col("here"), F.array(F.lit(SLIM), F.lit(ROW))).otherwise(F.array(F.lit(GONE)))
    rows = rows.select("conv", F.explode(passes).alias("part"), "turn", "role", "text", code.cast("int").alias("code"))
    # Equal turns stand together; the order among turns of one number is that of role and text.
    rows = rows.sortWithinPartitions("conv", "part", F.col("turn").asc_nulls_first(), "role", "text")
    full = F.col("part") == ROW
    return rows.select("conv", "part", "turn", F.when(full, F.col("role")).alias("role"), F.when(full, F.col("text")).alias("text"), "code")


@dataclass
class _Open:
    """A conversation that is being read."""

    conv: object
    codes: bytearray
    least: int | None = None
    most: int | None = None
    turns: int = 0
    before: int | None = None
    cost: int = 0
    audit: str | None = None
    at: int = 0
    written: int = 0
    pairs: bool = True

    def slim(self, turn: int | None, code: int) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += turn != self.before
            self.before = turn
        self.codes.append(code)

    def settle(self, costs: Costs) -> None:
        if self.audit is None:
            self.cost, self.audit = solve(bytes(self.codes), costs)
            outputs = sum(x != "D" for x in self.audit)
            self.pairs = outputs % 2 == 0

    def role(self) -> str:
        """What an inserted or reroled turn is at this place."""
        user = (self.written % 2 == 0) == self.pairs
        return "user" if user else "assistant"

    def edits(self, turn: tuple[str, str] | None) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) up to and with the next turn, or after the last one."""
        while self.at < len(self.audit):
            letter = self.audit[self.at]
            if letter != "I" and turn is None:
                return
            self.at += 1
            if letter == "I":
                out = "I", self.role(), ""
            elif letter == "R":
                out = "R", self.role(), turn[1]
            else:
                out = letter, *turn
            self.written += letter != "D"
            yield out
            if letter != "I":
                return


def _read(batches: Iterator[pa.RecordBatch], costs: Costs, opened, edit, closed) -> Iterator[list]:
    """Streams conversations; opened(conv), edit(...) and closed(...) make rows. What is held of a conversation is a byte or two for each turn."""
    now: _Open | None = None

    def end() -> Iterator:
        now.settle(costs)
        for x in now.edits(None):
            yield from edit(now, x)
        yield from closed(now)

    for batch in batches:
        out: list = []
        for conv, part, turn, role, text, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    out.extend(end())
                now = _Open(conv, bytearray())
                opened(now)
            if part == SLIM:
                now.slim(turn, code)
            elif part == ROW:
                now.settle(costs)
                for x in now.edits((role, text)):
                    out.extend(edit(now, x))
        yield out
    if now is not None:
        yield list(end())


def _counts(codes: bytearray) -> tuple[int, int, int, int]:
    duplicate = sum(c >= 16 for c in codes)
    blank = sum(bool(c & DELETED) for c in codes) - duplicate
    late = sum(bool(c & LATE) for c in codes)
    illegal = sum((a & 3, b & 3) not in ((1, 2), (2, 3), (3, 2)) for a, b in zip(codes, codes[1:], strict=False))
    return blank, duplicate, late, illegal


def _stream(rows: DataFrame, schema: T.StructType, costs: Costs, make) -> DataFrame:
    arrow = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _read(batches, costs, *make()):
            if found:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x, strict=True)) for x in found], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(trimmed(run), schema)


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", here: Column | None = None, costs: Costs = Costs()) -> DataFrame:
    """(conv, place, edit, role, text): the edits of every conversation in order, with what they leave; a deleted turn has no place.

    See ``reports`` for which turns count and in which order.
    """
    kind = turns.schema[conv_col].dataType
    schema = T.StructType([T.StructField(conv_col, kind), T.StructField("place", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edit", "role", "text")]])

    def make():
        edit = lambda now, x: [(now.conv, None if x[0] == "D" else now.written - 1, *x)]
        return (lambda now: None), edit, (lambda now: [])

    return _stream(_prepared(turns, conv_col, turn_col, role_col, text_col, here), schema, costs, make)


def reports(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", here: Column | None = None, costs: Costs = Costs()) -> DataFrame:
    """A row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and the SHA-256 of its repaired turns, ``role:text`` joined by newlines.

    Turns go by number, null first, those of one number by role and text. Null roles and texts are one space; a conversation without an id is one of its own.
    Turns that are not ``here`` are as if absent, but their conversation gets a row; without turns it has zeros and an empty audit. Other columns are ignored, an
    empty table gives an empty one. A conversation is read as a stream, twice in one sorted pass: its codes, then its texts; its turns need not fit into memory.
    """
    kind = turns.schema[conv_col].dataType
    longs, strings = ("gaps", *FAULTS, "illegal", "cost"), ("audit", "repaired_sha256")
    schema = T.StructType([T.StructField(conv_col, kind), *[T.StructField(c, T.LongType()) for c in longs], *[T.StructField(c, T.StringType()) for c in strings]])

    def make():
        digest: list = []

        def opened(now: _Open) -> None:
            digest[:] = [hashlib.sha256(), b""]

        def edit(now: _Open, x: tuple[str, str, str]) -> list:
            if x[0] != "D":
                digest[0].update(digest[1] + f"{x[1]}:{x[2]}".encode())
                digest[1] = b"\n"
            return []

        def closed(now: _Open) -> list:
            gaps = 0 if now.least is None else now.most - now.least + 1 - now.turns
            return [(now.conv, gaps, *_counts(now.codes), now.cost, now.audit, digest[0].hexdigest())]

        return opened, edit, closed

    return _stream(_prepared(turns, conv_col, turn_col, role_col, text_col, here), schema, costs, make)
