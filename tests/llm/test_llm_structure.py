import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from venuegrid.llm import queries, structure

SMALL = "/root/testdata/sf0.001"
WHITE, LEGAL = " \t\n\x0b\f\r", re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def marked(rows):
    """Sorted rows of one conversation as (turn, role, text, fault)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode("utf-8"), r[2].encode("utf-8")))
    seen, out = set(), []
    for turn, role, text in rows:
        left = text.translate(dict.fromkeys(map(ord, WHITE)))
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired lines): least costs by plain dynamic programming that carries whole strings."""
    best = {"": (0, "", ())}  # last role initials of the repaired sequence: "", s, u, a

    def better(table, state, made):
        if state not in table or made[:2] < table[state][:2]:
            table[state] = made

    def insert(table):
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                to = "a" if state == "u" else "u"
                better(table, to, (cost + 5, audit + "I", (*lines, ("user" if to == "u" else "assistant") + ":")))
        return table

    # what follows a state does not depend on the way to it, so the least way to each state is enough
    ways = insert(best)
    for _, role, text, fault in rows:
        new = {}
        for state, (cost, audit, lines) in ways.items():
            better(new, state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            cut = 5 * (fault == "truncated")
            to = "a" if state == "u" else "u"
            better(new, to, (cost + 1 + cut, audit + "R", (*lines, ("user" if to == "u" else "assistant") + ":" + text)))
            if role[:1] == to or role[:1] == "s" and state == "":
                better(new, role[:1], (cost + cut, audit + "K", (*lines, f"{role}:{text}")))
        ways = insert(new)
    return min((w for state, w in ways.items() if state in ("", "a")), key=lambda w: w[:2])


def every_way(rows):
    """(cost, audit) by trying all edits of a few rows."""
    best = None

    def go(k, initials, cost, audit, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if k == len(rows) and LEGAL.fullmatch(initials) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if inserts < 2:
            for role in "ua":
                go(k, initials + role, cost + 5, audit + "I", inserts + 1)
        if k == len(rows):
            return
        _, role, _, fault = rows[k]
        go(k + 1, initials, cost + 2, audit + "D", 0)
        if fault not in ("blank", "duplicate"):
            cut = 5 * (fault == "truncated")
            go(k + 1, initials + (role[:1] or "?"), cost + cut, audit + "K", 0)
            for to in "ua":
                go(k + 1, initials + to, cost + 1 + cut, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def expected(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in damage(rows):
        groups[conv].append((turn, role, text))
    out = {}
    for conv in {r[0] for r in rows}:
        own = marked(groups[conv])
        turns = [r[0] for r in own if r[0] is not None]
        initials = [r[1][:1] for r in own]
        cost, audit, lines = cheapest(own)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(sum(r[3] == f for r in own) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def found(rows):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def test_plain_programme_equals_trying_everything():
    draw = random.Random(1)
    for _ in range(150):
        rows = [(k, draw.choice(["system", "user", "assistant", "tool", ""]), "x.", draw.choice([None, None, "blank", "truncated"])) for k in range(draw.randint(0, 4))]
        assert cheapest(rows)[:2] == every_way(rows)


def test_blocks_equal_the_plain_programme():
    draw, tracer = random.Random(2), structure.Tracer()
    last = structure.tables().places[structure._normal(structure.LAST)[0]]
    for size in [*range(12), 57, 400]:
        for _ in range(20):
            rows = [(k, draw.choice(["system", "user", "assistant", "tool"]), "x", draw.choice([None, None, None, "blank", "truncated"])) for k in range(size)]
            codes = np.array([structure.symbol(r[1][:1], r[3]) for r in rows], np.uint8)
            letters, state, cost = tracer.run(codes.tobytes(), last, structure.START)
            tail = {structure.USER: "I", structure.SYSTEM: "II"}.get(state, "")
            assert (cost + 5 * len(tail), "".join(letters) + tail) == cheapest(rows)[:2]
            cells = np.array(structure._cells([codes])[0]).reshape(4, 4)
            ways = [cells[0][t] + structure.LAST[t] for t in range(4) if cells[0][t] >= 0]
            assert min(ways) == cheapest(rows)[0]


def test_vectors_are_few():
    assert len(structure.tables().vectors) < 300


def test_query_equals_the_plain_programme(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.queries()["op13_structure_repair"](spark, SMALL).collect()
    wanted = expected(rows)
    assert len(out) == len(wanted) and found(out) == wanted


@pytest.mark.parametrize("rows_a_segment", [3, 1000])
def test_long_and_odd_conversations(spark, monkeypatch, rows_a_segment):
    monkeypatch.setattr(structure, "SEGMENT_ROWS", rows_a_segment)
    draw = random.Random(rows_a_segment)
    roles, texts = ["system", "user", "assistant", None, "", "tool", "agent"], ["yes.", "No!", "what", "", None, " \n", "so. ", "x" * 5000 + "?", "\xe9\xa0"]
    rows = [(1, k, draw.choice(roles[:3]), draw.choice([f"{k}.", f"{k}", "again."])) for k in range(700)]
    rows += [(c, draw.choice([None, -3, 0, 1, 2, 9]), draw.choice(roles), draw.choice(texts)) for c in (None, 2, 3, 4) for _ in range(60)]
    rows += [(5, 4, "user", "same.")] * 50 + [(6, None, "system", "s.")] + [(7, t, "user", None) for t in range(30)]
    rows += [(100 + c, 0, "user", "hm.") for c in range(60)]  # some lose their only row
    frame = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, key string, n int, part int")
    out = structure.audited(frame.repartition(5)).collect()
    wanted = expected(rows)
    assert len(out) == len(wanted)
    got = found(out)
    for conv in wanted:
        assert got[conv] == wanted[conv], conv
    assert sum(not w[6] for w in wanted.values()) > 0
    assert structure.audited(frame.limit(0)).collect() == []


def test_edits_render_the_repair(spark):
    frame = spark.createDataFrame([(1, 0, "assistant", "a."), (1, 1, "user", "b"), (1, 2, "user", "c."), (1, 3, "user", " ")], "conv_id long, turn long, role string, text string")
    (row,) = structure.repaired(frame).collect()
    assert row.whole and [e.edit for e in row.edits] == list(cheapest(marked([(0, "assistant", "a."), (1, "user", "b"), (2, "user", "c."), (3, "user", " ")]))[1])
    assert [e.fault for e in row.edits if e.edit != "I"] == [None, "truncated", None, "blank"]
