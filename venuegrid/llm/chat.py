"""Operator 1: repair of chat turns at the least cost, and their rendering.

The legal sequences are: at most one system turn first, then user and assistant in
turn, user first, assistant last. A dynamic programme over the automaton's states
keeps a turn, relabels it, merges it into the turn before, or inserts an empty turn
before it or at the end.

Conversations are sorted over all tasks by range and cut into segments of a fixed
number of turns, so a conversation of any length spreads out. A conversation that
spans segments is put together from one small cost matrix for each segment: costs
run forward over the segments, choices run back, and each segment is then traced
with the costs it begins with and the state it has to end in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuegrid.llm.ship import ship
from venuegrid.session import settle

#: Roles, and what the repairs cost.
ROLES = ("system", "user", "assistant")
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 5, 1, 3
SEGMENT = 1_000

# a state is the role of the last turn; 3 is the start
_NEXT = {3: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
_FINAL, _INF = (2, 3), math.inf


def _moves(role: str | None) -> list[tuple[int, int, int, int, int]]:
    """(cost, order, from, to, inserted role or -1) of a turn; ``order`` ranks equal costs: keep, merge, relabel, insert."""
    own = ROLES.index(role) if role in ROLES else -1
    change = lambda to: 0 if to == own else RELABEL_UNKNOWN if own < 0 else RELABEL
    out = []
    for before, after in _NEXT.items():
        if before != 3:
            out.append((MERGE + change(before), 1, before, before, -1))
        for to in after:
            out.append((change(to), 0 if change(to) == 0 else 2, before, to, -1))
            for last in _NEXT[to]:
                out.append((INSERT + change(last), 3, before, last, to))
    return sorted(out)


_MOVES = {role: _moves(role) for role in (*ROLES, None)}


def _moves_of(role: str | None):
    return _MOVES.get(role, _MOVES[None])


def forward(roles: list[str | None], start: list[float]) -> list[list[float]]:
    """Least cost to reach each state before the first turn and after each turn."""
    costs = [start]
    for role in roles:
        now, new = costs[-1], [_INF] * 4
        for cost, _, before, to, _ in _moves_of(role):
            total = now[before] + cost
            if total < new[to]:
                new[to] = total
        costs.append(new)
    return costs


def trace(roles: list[str | None], costs: list[list[float]], end: int) -> tuple[list, int]:
    """(moves, state before the first turn) of the cheapest way to end in ``end``; ties take the first move, from the back."""
    out = []
    for k in range(len(roles) - 1, -1, -1):
        move = next(m for m in _moves_of(roles[k]) if m[3] == end and costs[k][m[2]] + m[0] == costs[k + 1][end])
        out.append(move)
        end = move[2]
    return out[::-1], end


def last_state(costs: list[float]) -> tuple[int, int]:
    """(state that the turns end in, role of the last empty turn to insert or -1); after a system turn a user turn is inserted too."""
    ends = [(costs[s], 0, s, -1) for s in _FINAL] + [(costs[1] + INSERT, 1, 1, 2), (costs[0] + 2 * INSERT, 2, 0, 2)]
    _, _, state, insert = min(ends)
    return state, insert


_START = [_INF, _INF, _INF, 0.0]


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a partition and cut them into segments."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array([k // SEGMENT for k in range(at, at + n)], pa.int64())],
            names=[*batch.schema.names, "part", "at", "segment"],
        )
        at += n


def _pieces(rows: pa.Table) -> list[tuple[str, int, int]]:
    """(conversation key, first row, row after the last) of the runs of one conversation in a sorted segment."""
    keys, out, begin = rows["key"].to_pylist(), [], 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[begin]:
            out.append((keys[begin], begin, k))
            begin = k
    return out


def _matrices(rows: pa.Table) -> pa.Table:
    """Cost from each state to each state over the first and the last piece of a segment, which may go on elsewhere."""
    rows = rows.sort_by("at")
    roles, pieces = rows["role"].to_pylist(), _pieces(rows)
    out = []
    for key, a, b in {pieces[0], pieces[-1]}:
        cells = []
        for s in range(4):
            cells += forward(roles[a:b], [0.0 if k == s else _INF for k in range(4)])[-1]
        out.append({"key": key, "part": rows["part"][0].as_py(), "segment": rows["segment"][0].as_py(), "cells": cells})
    return pa.Table.from_pylist(out, pa.schema([("key", pa.string()), ("part", pa.int64()), ("segment", pa.int64()), ("cells", pa.list_(pa.float64()))]))


def _starts(rows: pa.Table) -> pa.Table:
    """Costs with which each piece of a conversation begins; the last piece also gets the state it ends in."""
    lines = sorted(rows.to_pylist(), key=lambda x: (x["part"], x["segment"]))
    now, out = _START, []
    for line in lines:
        out.append({"key": line["key"], "part": line["part"], "segment": line["segment"], "costs": now, "end": None, "insert": -1, "last": False})
        cells = line["cells"]
        now = [min(now[s] + cells[4 * s + t] for s in range(4)) for t in range(4)]
    out[-1]["last"] = True
    out[-1]["end"], out[-1]["insert"] = last_state(now)
    return pa.Table.from_pylist(out, _INFO)


_INFO = pa.schema([("key", pa.string()), ("part", pa.int64()), ("segment", pa.int64()), ("costs", pa.list_(pa.float64())), ("end", pa.int32()), ("insert", pa.int32()), ("last", pa.bool_())])
_INFO_DDL = "key string, part long, segment long, costs array<double>, end int, insert int, last boolean"


def _entries(rows: pa.Table, info: pa.Table) -> pa.Table:
    """For each piece that goes on, the state it begins in for each state it may end in."""
    rows = rows.sort_by("at")
    costs = {line["key"]: line for line in info.to_pylist()}
    roles, out = rows["role"].to_pylist(), []
    for key, a, b in _pieces(rows):
        if key in costs:
            line = costs[key]
            way = forward(roles[a:b], line["costs"])
            out.append(line | {"entry": [trace(roles[a:b], way, s)[1] if way[-1][s] < _INF else -1 for s in range(4)]})
    return pa.Table.from_pylist(out, _INFO.append(pa.field("entry", pa.list_(pa.int32()))))


def _ends(rows: pa.Table) -> pa.Table:
    """The state in which each piece of a conversation ends."""
    lines = sorted(rows.to_pylist(), key=lambda x: (x["part"], x["segment"]))
    end = lines[-1]["end"]
    for line in reversed(lines):
        line["end"] = end
        end = line.pop("entry")[end]
    return pa.Table.from_pylist(lines, _INFO)


_OUT = "role_out string, action string, inserted_before string, inserted_after string, cost int, fragment string"


def _fragment(role: str, text: str, opens: bool, first: bool) -> str:
    return (("" if first else "<|end|>\n") + f"<|{role}|>\n{text}") if opens else f"\n{text}"


def _repair(rows: pa.Table, info: pa.Table, keep: list[str]) -> pa.Table:
    """Decide and render the turns of a segment."""
    rows = rows.sort_by("at")
    told = {line["key"]: line for line in info.to_pylist()}
    roles, texts = rows["role"].to_pylist(), rows["text"].to_pylist()
    out: list[tuple] = []
    for key, a, b in _pieces(rows):
        line = told.get(key)
        costs = forward(roles[a:b], line["costs"] if line else _START)
        end, insert = (line["end"], line["insert"]) if line else last_state(costs[-1])
        moves, _ = trace(roles[a:b], costs, end)
        for k, (cost, order, before, to, inserted) in enumerate(moves):
            text, role = texts[a + k] or "", ROLES[to]
            head = _fragment(ROLES[inserted], "", True, before == 3) if inserted >= 0 else ""
            body = head + _fragment(role, text, order != 1, before == 3 and inserted < 0)
            tail = ""
            if k == len(moves) - 1 and (line is None or line["last"]):
                after = [] if insert < 0 else [1, 2] if end == 0 else [insert]
                tail = "".join(_fragment(ROLES[r], "", True, False) for r in after) + "<|end|>\n"
                cost += INSERT * len(after)
            else:
                after = []
            out.append((
                role, ("keep", "merge", "relabel", "insert")[order], ROLES[inserted] if inserted >= 0 else None,
                ",".join(ROLES[r] for r in after) or None, cost, body + tail,
            ))
    made = [pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()))]
    names = [c.split()[0] for c in _OUT.split(", ")]
    return pa.Table.from_arrays([*(rows[c] for c in keep), *made], names=[*keep, *names])


def repaired(
    turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row for each row of ``turns``: conversation, turn, role, and

    ``role_out``; ``action``: keep, merge (into the turn before), relabel, or insert
    (an empty turn ``inserted_before`` it); ``inserted_after``: roles of empty turns
    after the last one; ``cost``; ``fragment``: its part of the rendered conversation,
    which is the fragments of a conversation one after the other.

    Ties between equally cheap ways take keep before merge before relabel before
    insert, from the last turn back. A missing or unknown role fits every role at the
    same cost. A missing text is empty. Rows without a conversation are one
    conversation; turns with the same number, or none (these come first), follow in
    the order of role and text; equal rows are turns of their own. Other columns are
    not read. An empty table gives an empty result.
    """
    ship(turns.sparkSession)
    kinds = {c: turns.schema[c].dataType.simpleString() for c in (conversation, turn, role)}
    rows = turns.select(
        turns[f"`{conversation}`"].alias("conv"), turns[f"`{turn}`"].alias("turn"), turns[f"`{role}`"].cast("string").alias("role"),
        turns[f"`{text}`"].cast("string").alias("text"),
    ).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")))
    order = ["key", "turn", "role", "text"]
    spread = rows.repartitionByRange("key", "turn", "role", F.xxhash64("text")).sortWithinPartitions(*order)
    kind = f"conv {kinds[conversation]}, turn {kinds[turn]}, role string, text string, key string"
    numbered = settle(spread.mapInArrow(_number, f"{kind}, part long, at long, segment long"), "turns")
    place = ["part", "segment"]

    cells = settle(numbered.select("key", "role", "at", *place).groupBy(*place).applyInArrow(_matrices, "key string, part long, segment long, cells array<double>"), "cells")
    several = cells.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    starts = settle(cells.join(several, "key", "left_semi").groupBy("key").applyInArrow(_starts, _INFO_DDL), "starts")
    touched = numbered.select("key", "role", "at", *place).join(starts.select(*place).distinct(), place, "left_semi")
    entries = touched.groupBy(*place).cogroup(starts.groupBy(*place)).applyInArrow(_entries, f"{_INFO_DDL}, entry array<int>")
    ends = settle(entries.groupBy("key").applyInArrow(_ends, _INFO_DDL), "ends")
    keep = ["conv", "turn", "role", *place, "at"]
    schema = f"conv {kinds[conversation]}, turn {kinds[turn]}, role string, part long, segment long, at long, {_OUT}"
    out = numbered.groupBy(*place).cogroup(ends.groupBy(*place)).applyInArrow(partial(_repaired, keep=keep), schema)
    return out.select(F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role), *[c.split()[0] for c in _OUT.split(", ")])


def _repaired(rows: pa.Table, info: pa.Table, *, keep: list[str]) -> pa.Table:  # Spark counts positional parameters
    return _repair(rows, info, keep)
