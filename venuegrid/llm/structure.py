"""Operator 13: least-cost repair of the structure of conversations by Four-Russians block tables.

Each row is one of ten symbols: its role's initial with or without a cut end, a row
that has to go, or nothing. Repaired roles follow an automaton of four states (start,
after system, after user, after assistant), so the costs of the rest of a conversation
are a vector of four numbers, one for each state before it. Vectors less their minimum
are few; ``Tables`` lists those that occur and stores for each of them and each block of
``BLOCK`` symbols the vector before the block and what is added. Runs of blocks are then
done by lookup, from the end to the start. For the edits the blocks are expanded again:
costs inside a block run back from the vector behind it, and choices run forward, each
time the first letter that keeps the cost, so that ties give the least string.

Equal rows are one row with a number. Rows are sorted over all tasks by range and cut
into segments of bounded size. A conversation of several segments is joined through one
4 x 4 cost matrix for each segment, first inside a partition, then over the partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuegrid.llm.columns import WHITE
from venuegrid.llm.scratch import Scratch
from venuegrid.llm.ship import ship

#: Costs of the edits, and what a cut row costs that stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
BLOCK, SYMBOLS = 4, 10
SEGMENT_ROWS, SEGMENT_BYTES = 1_000, 1 << 20
_INF = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
GONE, NOTHING = 8, 9  # symbols; the others are 2 * (s, u, a, other) + cut
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: the state that a role's initial leads to, and the one that a chosen role leads to
_KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
_CHOSEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


def symbol(initial: str, fault: str | None) -> int:
    if fault in ("blank", "duplicate"):
        return GONE
    return 2 * ("sua".index(initial) if initial and initial in "sua" else 3) + (fault == "truncated")


def _with_inserts(costs: list[int]) -> list[int]:
    for _ in range(2):
        costs = [min(costs[s], INSERT + costs[_CHOSEN[s]]) for s in range(4)]
    return costs


def before(code: int, after: list[int]) -> list[int]:
    """Costs from each state before a row, given those after it."""
    if code == NOTHING:
        return list(after)
    if code == GONE:
        return [min(_INF, DELETE + c) for c in after]
    role, cut = code // 2, CUT * (code % 2)
    out = []
    for s in range(4):
        least = min(DELETE + after[s], REROLE + cut + after[_CHOSEN[s]])
        if s in _KEPT[role]:
            least = min(least, KEEP + cut + after[_KEPT[role][s]])
        out.append(least)
    return [min(_INF, c) for c in _with_inserts(out)]


#: costs at the end of a conversation; legal ends are nothing and an assistant's row
LAST = tuple(_with_inserts([0, _INF, _INF, 0]))


def _normal(costs) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(c - least if c < _INF // 2 else _INF for c in costs), least


class Tables:
    """Vectors that occur, and where symbols and blocks of symbols lead from each of them."""

    def __init__(self):
        basis = [tuple(0 if s == t else _INF for s in range(4)) for t in range(4)]
        starts = [_normal(_with_inserts(list(b)))[0] for b in basis]
        self.vectors: list[tuple[int, ...]] = list(dict.fromkeys([_normal(LAST)[0], *starts]))
        self.ends = [self.vectors.index(v) for v in starts]
        places = {v: k for k, v in enumerate(self.vectors)}
        to, add = [], []
        at = 0
        while at < len(self.vectors):
            row = [_normal(before(code, list(self.vectors[at]))) for code in range(SYMBOLS)]
            for v, _ in row:
                if v not in places:
                    places[v] = len(self.vectors)
                    self.vectors.append(v)
            to.append([places[v] for v, _ in row])
            add.append([plus for _, plus in row])
            at += 1
        self.places = places
        step, plus = np.array(to, np.int32), np.array(add, np.int32)
        self.to, self.add = step, plus
        for _ in range(BLOCK - 1):  # one more symbol in front; a block's number has its first symbol as lowest digit
            n = self.to.shape[1]
            further, more = step[self.to], self.add[:, :, None] + plus[self.to]
            self.to, self.add = (x.reshape(len(x), n * SYMBOLS) for x in (further, more))

    def run(self, blocks: np.ndarray, lengths: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector before, cost added) of many runs of blocks, each read from its end; ``start`` are the vectors behind them."""
        first = np.cumsum(lengths) - lengths
        vector, cost = start.copy(), np.zeros(len(start), np.int64)
        for turn in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > turn)
            block = blocks[first[live] + lengths[live] - 1 - turn]
            cost[live] += self.add[vector[live], block]
            vector[live] = self.to[vector[live], block]
        return vector, cost


@cache
def tables() -> Tables:
    return Tables()


def numbered(codes: np.ndarray) -> np.ndarray:
    """Symbols as numbers of blocks; the last block ends with nothings. The last symbol of a block is its highest digit."""
    padded = np.concatenate([codes, np.full(-len(codes) % BLOCK, NOTHING, np.uint8)]).reshape(-1, BLOCK).astype(np.int64)
    return padded @ SYMBOLS ** np.arange(BLOCK)


class Tracer:
    """Edits of a block from the vector behind it and the state before it; what was worked out is kept."""

    def __init__(self):
        self.known: dict[tuple, tuple] = {}

    def block(self, codes: bytes, vector: int, state: int) -> tuple[list[str], int, int]:
        """(letters of each row, state after, cost)."""
        found = self.known.get((codes, vector, state))
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[codes, vector, state] = self._expand(codes, list(tables().vectors[vector]), state)
        return found

    @staticmethod
    def _expand(codes: bytes, after: list[int], state: int) -> tuple[list[str], int, int]:
        costs = [after]
        for code in reversed(codes):
            costs.append(before(code, costs[-1]))
        costs.reverse()
        letters, total = [], 0
        for k, code in enumerate(codes):
            out = ""
            while code != NOTHING:
                letter, to, cost = next(
                    (letter, to, cost) for letter, to, cost, rest in _moves(code, state, costs[k], costs[k + 1]) if cost + rest == costs[k][state]
                )
                out, state, total = out + letter, to, total + cost
                if letter != "I":
                    break
            letters.append(out)
        return letters, state, total

    def run(self, codes: bytes, vector: int, state: int) -> tuple[list[str], int, int]:
        """The same of a run of symbols: vectors between blocks by lookup from the end, then block by block from the start."""
        blocks = numbered(np.frombuffer(codes, np.uint8)).tolist()
        behind = [vector]
        for block in reversed(blocks[1:]):
            behind.append(int(tables().to[behind[-1], block]))
        letters, total = [], 0
        for k, after in enumerate(reversed(behind)):
            own, state, cost = self.block(codes[BLOCK * k:BLOCK * (k + 1)], after, state)
            letters += own
            total += cost
        return letters, state, total


def _moves(code: int, state: int, here: list[int], after: list[int]) -> Iterator[tuple[str, int, int, int]]:
    """(letter, state, cost, cost of the rest) of the edits at a row, by letter."""
    yield "D", state, DELETE, after[state]
    yield "I", _CHOSEN[state], INSERT, here[_CHOSEN[state]]
    if code != GONE:
        cut, kept = CUT * (code % 2), _KEPT[code // 2].get(state)
        if kept is not None:
            yield "K", kept, KEEP + cut, after[kept]
        yield "R", _CHOSEN[state], REROLE + cut, after[_CHOSEN[state]]



def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def _marked(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct rows with their number ``n`` and the first fault of the first of them, in no order."""
    rows = turns.select(
        turns[f"`{conversation}`"].alias("conv"), turns[f"`{turn}`"].alias("turn"),
        *(F.coalesce(turns[f"`{c}`"].cast("string"), F.lit(" ")).alias(to) for c, to in ((role, "role"), (text, "text"))),
    )
    rows = rows.withColumn("key", _key(F.col("conv"))).withColumn("h", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    # a missing turn comes first; neither part of the place is null, so the join keeps the grouping's partitions
    rows = rows.withColumn("has", F.col("turn").isNotNull()).withColumn("place", F.coalesce(F.col("turn").cast("string"), F.lit("")))
    own = rows.groupBy("key", "has", "place", "h").agg(*(F.first(c).alias(c) for c in ("conv", "turn", "role", "text")), F.count("*").alias("n"))
    firsts = rows.groupBy("key", "h").agg(F.min(F.struct("has", "turn", "place")).alias("m")).select("key", F.col("m.has").alias("has"), F.col("m.place").alias("place"), "h", F.lit(True).alias("first"))
    own = own.join(firsts, ["key", "has", "place", "h"], "left")
    seen = F.translate("text", WHITE, "")
    fault = F.when(seen == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), "truncated")
    return own.select("key", "conv", "turn", "role", "text", "n", fault.alias("fault"))


def _cells(codes: list[np.ndarray]) -> list[list[int]]:
    """For each run of symbols the 16 least costs from each state before it to each state after it; -1 where there is no way."""
    blocks = [numbered(c) for c in codes for _ in range(4)]
    lengths = np.array([len(b) for b in blocks], np.int64)
    vector, cost = tables().run(np.concatenate(blocks), lengths, np.tile(tables().ends, len(codes)))
    table = np.array(tables().vectors)[vector]
    cells = np.where(table < _INF // 2, table + cost[:, None], -1).reshape(len(codes), 4, 4)
    return cells.transpose(0, 2, 1).reshape(len(codes), 16).tolist()


def _segments(batches: Iterator[pa.RecordBatch], types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one conversation in the order of a sorted partition."""
    from pyspark import TaskContext

    part, done, out, held, size, written = TaskContext.get().partitionId(), 0, [], [], 0, 0

    def close() -> None:
        nonlocal done, held, size
        codes = np.array([symbol(r["role"][:1], r["fault"]) for r in held], np.uint8)
        rows = [{k: r[k] for k in ("turn", "role", "text", "n", "fault")} for r in held]
        out.append({"key": held[0]["key"], "conv": held[0]["conv"], "part": part, "seq": done, "codes": codes, "rows": rows})
        done, held, size = done + 1, [], 0

    def written_out() -> pa.RecordBatch:
        for o, cells in zip(out, _cells([o["codes"] for o in out])):
            o["cells"], o["codes"] = cells, o["codes"].tobytes()
        made = pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in types.items()], names=list(types))
        out.clear()
        return made

    for batch in batches:
        for row in batch.to_pylist():
            if held and (held[0]["key"] != row["key"] or len(held) >= SEGMENT_ROWS or size >= SEGMENT_BYTES):
                close()
            held.append(row)
            size += len(row["text"]) + 50
            written += len(row["text"]) + 50
            if written >= 4 * SEGMENT_BYTES and out:
                yield written_out()
                written = 0
    if held:
        close()
    if out:
        yield written_out()


def _ends(segments: DataFrame) -> DataFrame:
    """(key, part, seq, vector, state, last) of the segments of conversations that have several.

    ``vector``: costs behind the segment; ``state``: the one before it. Costs run back
    and states forward, first inside the partitions, then over them, so no task holds
    more of a conversation than one partition's segments or one line for each partition.
    """
    several = segments.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    light = segments.select("key", "part", "seq", "codes", "cells").join(several, "key", "left_semi")
    pieces = light.select("key", "part", "seq", "cells").groupBy("key", "part").applyInPandas(_joined_cells, "key string, part long, cells array<long>")
    behind = pieces.groupBy("key").applyInPandas(_costs_behind, "key string, part long, after array<long>, last boolean")
    found = light.join(behind, ["key", "part"]).groupBy("key", "part").applyInPandas(
        _vectors, "key string, part long, seq long, vector int, last boolean, exits array<int>"
    )
    return found


def _states(found: DataFrame) -> DataFrame:
    ways = found.groupBy("key", "part").applyInPandas(_joined_exits, "key string, part long, exits array<int>")
    entries = ways.groupBy("key").applyInPandas(_entries_of_parts, "key string, part long, entry int")
    return found.join(entries, ["key", "part"]).groupBy("key", "part").applyInPandas(_entries, "key string, part long, seq long, vector int, last boolean, state int")


def _square(cells) -> np.ndarray:
    square = np.array(cells, np.int64).reshape(4, 4)
    return np.where(square < 0, _INF, square)


def _joined_cells(rows: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for cells in rows.sort_values("seq")["cells"]:
        own = _square(cells)
        whole = own if whole is None else np.minimum((whole[:, :, None] + own[None, :, :]).min(axis=1), _INF)
    return pd.DataFrame({"key": rows["key"][:1], "part": rows["part"][:1], "cells": [np.where(whole >= _INF // 2, -1, whole).ravel().tolist()]})


def _back(cells, after: np.ndarray) -> np.ndarray:
    return (_square(cells) + after[None, :]).min(axis=1)


def _costs_behind(pieces: pd.DataFrame) -> pd.DataFrame:
    pieces, after, out = pieces.sort_values("part", ascending=False), np.array(LAST), []
    for key, part, cells in zip(pieces["key"], pieces["part"], pieces["cells"]):
        out.append((key, part, after.tolist(), not out))
        after = _back(cells, after)
    return pd.DataFrame(out, columns=["key", "part", "after", "last"])


def _vectors(rows: pd.DataFrame) -> pd.DataFrame:
    rows, tracer, out = rows.sort_values("seq", ascending=False), Tracer(), []
    after, last = np.array(rows["after"].iloc[0]), bool(rows["last"].iloc[0])
    for key, part, seq, codes, cells in zip(*(rows[c] for c in ("key", "part", "seq", "codes", "cells"))):
        vector = tables().places[_normal(after.tolist())[0]]
        out.append((key, part, seq, vector, last and not out, [tracer.run(codes, vector, s)[1] for s in range(4)]))
        after = _back(cells, after)
    return pd.DataFrame(out, columns=["key", "part", "seq", "vector", "last", "exits"])


def _joined_exits(rows: pd.DataFrame) -> pd.DataFrame:
    way = np.arange(4)
    for exits in rows.sort_values("seq")["exits"]:
        way = np.array(exits)[way]
    return pd.DataFrame({"key": rows["key"][:1], "part": rows["part"][:1], "exits": [way.tolist()]})


def _entries_of_parts(ways: pd.DataFrame) -> pd.DataFrame:
    state, out = START, []
    ways = ways.sort_values("part")
    for key, part, exits in zip(ways["key"], ways["part"], ways["exits"]):
        out.append((key, part, state))
        state = int(exits[state])
    return pd.DataFrame(out, columns=["key", "part", "entry"])


def _entries(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("seq")
    state, states = int(rows["entry"].iloc[0]), []
    for exits in rows["exits"]:
        states.append(state)
        state = int(exits[state])
    return rows.assign(state=states)[["key", "part", "seq", "vector", "last", "state"]]


def _edited(batches: Iterator[pa.RecordBatch], types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Segments with their edits in the place of their rows."""
    tracer = Tracer()
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            out = {k: part.column(k) for k in types if k != "edits"}
            lines = part.select(["codes", "rows", "vector", "state", "last"]).to_pylist()
            out["edits"] = pa.array([_edits(tracer, **line) for line in lines], types["edits"])
            yield pa.RecordBatch.from_arrays([out[k] for k in types], names=list(types))


def _edits(tracer: Tracer, codes: bytes, rows: list[dict], vector: int, state: int, last: bool) -> list[dict]:
    letters, end, _ = tracer.run(codes, vector, state)
    out = []

    def insert() -> None:
        nonlocal state
        state = _CHOSEN[state]
        out.append({"edit": "I", "times": 1, "turn": None, "fault": None, "was": None, "role": _NAMES[state], "text": ""})

    for row, code, own in zip(rows, codes, letters):
        for letter in own[:-1]:
            insert()
        made = {"edit": own[-1], "times": 1, "turn": row["turn"], "fault": row["fault"], "was": row["role"], "role": None, "text": None}
        if own[-1] == "K":
            state = _KEPT[code // 2][state]
            made |= {"role": row["role"], "text": row["text"]}
        elif own[-1] == "R":
            state = _CHOSEN[state]
            made |= {"role": _NAMES[state], "text": row["text"]}
        again = row["n"] - 1
        if code == GONE:
            made["times"], again = row["n"], 0
        out.append(made)
        if again:
            out.append({"edit": "D", "times": again, "turn": row["turn"], "fault": "duplicate", "was": row["role"], "role": None, "text": None})
    while last and state not in (START, ASSISTANT):
        insert()
    return out


def repaired(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments of repaired conversations: (key, conv, part, seq, whole, edits).

    The segments of a conversation follow each other by ``part`` and ``seq``; ``whole``
    marks the only one. ``edits`` lists in order, for each row or empty insertion:
    ``edit`` (K keep, R give role user or assistant, D delete, I insert), ``times`` (equal
    deletions in a row), ``turn``, ``fault`` (blank, duplicate, truncated or none) and
    ``was``, the role it had; ``role`` and ``text`` of what stands after it, null where nothing does.

    The edits cost least; ties give the least string of letters. Rows follow by turn,
    missing turns first, then by role and text; equal rows after the first are
    duplicates. A missing role or text is one blank, so it fits no role or is blank.
    Rows without a conversation are one conversation. Other columns are not read, and
    their names may be any. Conversations and texts may be of any length. An empty table gives no rows.
    """
    ship(turns.sparkSession)
    with Scratch(turns.sparkSession) as scratch:
        marked = _marked(turns, conversation, turn, role, text)
        spread = marked.repartitionByRange("key", "turn", "role", F.left("text", F.lit(100))).sortWithinPartitions("key", "turn", "role", "text")
        kinds = {c: turns.schema[c].dataType.simpleString() for c in (conversation, turn)}
        ddl = f"key string, conv {kinds[conversation]}, part long, seq long, codes binary, cells array<long>, rows array<struct<turn: {kinds[turn]}, role: string, text: string, n: long, fault: string>>"
        segments = scratch.keep(spread.mapInArrow(partial(_segments, types=_types(turns, ddl)), ddl), "segments")
        ends = scratch.keep(_states(scratch.settle(_ends(segments), "vectors")), "ends")
    several = ends.select("key").distinct()
    one = segments.join(several, "key", "left_anti").select(
        "key", "conv", "part", "seq", "codes", "rows", F.lit(tables().places[_normal(LAST)[0]]).alias("vector"), F.lit(START).alias("state"),
        F.lit(True).alias("last"), F.lit(True).alias("whole"),
    )
    many = segments.join(ends, ["key", "part", "seq"]).select("key", "conv", "part", "seq", "codes", "rows", "vector", "state", "last", F.lit(False).alias("whole"))
    ddl = (
        f"key string, conv {kinds[conversation]}, part long, seq long, whole boolean, "
        f"edits array<struct<edit: string, times: long, turn: {kinds[turn]}, fault: string, was: string, role: string, text: string>>"
    )
    out = [x.mapInArrow(partial(_edited, types=_types(turns, ddl)), ddl) for x in (one, many)]
    return out[0].unionByName(out[1])


def _types(df: DataFrame, ddl: str) -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)
    return {field.name: field.type for field in schema}


_LEGAL = ("su", "ua", "au")


def _summed(batches: Iterator[pa.RecordBatch], types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Figures of conversations from their segments in order; a digest takes in one segment after the other."""
    out, held = [], None
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for row in batch.slice(at, 64).to_pylist():
                if held is not None and held.key != row["key"]:
                    out.append(held.line())
                    held = None
                held = held or _Sum(row["key"], row["conv"])
                held.add(row["edits"])
            if len(out) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in types.items()], names=list(types))
                out = []
    if held is not None:
        out.append(held.line())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in types.items()], names=list(types))


class _Sum:
    def __init__(self, key: str, conv):
        self.key, self.conv, self.hash, self.lines, self.audit = key, conv, hashlib.sha256(), 0, []
        self.count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.cost = self.turns = 0
        self.initial = self.least = self.most = None

    def add(self, edits: list[dict]) -> None:
        for e in edits:
            letter, times = e["edit"], e["times"]
            self.audit.append(letter * times)
            self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[letter] * times
            if letter != "I":
                initial = e["was"][:1]
                self.illegal += times - 1 + (self.initial is not None and self.initial + initial not in _LEGAL)
                self.initial = initial
                if e["fault"]:
                    self.count[e["fault"]] += times
                if letter != "D" and e["fault"] == "truncated":
                    self.cost += CUT
                if e["turn"] is not None:
                    self.turns += e["turn"] != self.most
                    self.least, self.most = e["turn"] if self.least is None else self.least, e["turn"]
            if e["role"] is not None:
                self.hash.update((("\n" if self.lines else "") + e["role"] + ":" + e["text"]).encode())
                self.lines += 1

    def line(self) -> dict:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {
            "key": self.key, "conv": self.conv, "gaps": gaps, **self.count, "illegal": self.illegal, "cost": self.cost,
            "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest(),
        }


def figures(segments: DataFrame) -> DataFrame:
    """One line for each conversation in ``repaired``'s segments: key, conv, counts, cost, audit and digest.

    A digest reads a text from its start to its end, so the segments of a conversation
    that has several pass one task, one at a time; the others stay where they are.
    """
    kind = segments.schema["conv"].dataType.simpleString()
    ddl = f"key string, conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    work = partial(_summed, types=_types(segments, ddl))
    sorted_ = segments.where("not whole").repartition("key").sortWithinPartitions("key", "part", "seq")
    return segments.where("whole").mapInArrow(work, ddl).unionByName(sorted_.mapInArrow(work, ddl))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by a hash of conversation and turn; a missing role or text is one blank."""
    blank = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.withColumn("fate", F.pmod(F.crc32(name.cast("binary")), F.lit(20))).where("fate <> 0")
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def audited(turns: DataFrame) -> DataFrame:
    """One line for each ``conv_id`` of ``turns``: figures of the repair of its damaged rows; zeros where none is left."""
    lines = figures(repaired(damaged(turns)))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = turns.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    return every.join(lines.drop("conv"), "key", "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
