import itertools
import random
from collections import defaultdict

import pytest

from venuegrid.llm import chat

LEGAL = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def least_cost(roles):
    """By trying every relabelling, merge and insertion."""
    best = {None: 0}
    for role in roles:
        new = {}

        def offer(state, cost, new=new):
            new[state] = min(cost, new.get(state, cost))

        for state, cost in best.items():
            change = lambda to, role=role: 0 if to == role else chat.RELABEL_UNKNOWN if role not in chat.ROLES else chat.RELABEL
            if state is not None:
                offer(state, cost + chat.MERGE + change(state))
            for to in LEGAL[state]:
                offer(to, cost + change(to))
                for then in LEGAL[to]:
                    offer(then, cost + chat.INSERT + change(then))
        best = new
    ends = [c + {"assistant": 0, None: 0, "user": chat.INSERT, "system": 2 * chat.INSERT}[s] for s, c in best.items()]
    return min(ends)


def rows_of(seed, conversations, longest):
    draw = random.Random(seed)
    return [
        (conv, t, draw.choice(["system", "user", "assistant", "tool", None, "user", "assistant"]), draw.choice([None, "", f"t{t}"]))
        for conv in range(conversations) for t in range(draw.randint(1, longest))
    ]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, action string")


def check(rows, out):
    given, made = defaultdict(list), defaultdict(list)
    for r in rows:
        given[r[0]].append(r)
    for r in out:
        made[r.conv_id].append(r)
    for conv, turns in given.items():
        own = sorted(made[conv], key=lambda r: r.turn)
        assert sum(r.cost for r in own) == least_cost([t[2] for t in turns])
        sequence, parts = [], []
        for r, (_, _, _, text) in zip(own, turns):
            if r.inserted_before:
                sequence.append(r.inserted_before)
                parts.append("")
            if r.action == "merge":
                assert sequence[-1] == r.role_out
                parts[-1] += "\n" + (text or "")
            else:
                sequence.append(r.role_out)
                parts.append(text or "")
            for role in (r.inserted_after or "").split(",") if r.inserted_after else []:
                sequence.append(role)
                parts.append("")
        state = None
        for role in sequence:
            assert role in LEGAL[state]
            state = role
        assert state == "assistant"
        assert "".join(r.fragment for r in own) == "".join(f"<|{role}|>\n{part}<|end|>\n" for role, part in zip(sequence, parts))


def test_repairs_are_legal_and_cheapest(spark):
    rows = rows_of(1, 60, 12) + [(100 + k, t, role, "x") for k, roles in enumerate(itertools.product(["system", "user", "assistant"], repeat=3)) for t, role in enumerate(roles)]
    check(rows, chat.repaired(frame(spark, rows)).collect())


@pytest.mark.parametrize("partitions", [2, 17])
def test_a_conversation_over_many_segments(spark, partitions):
    rows = rows_of(2, 1, 1) + [(7, t, r[2], r[3]) for t, r in enumerate(rows_of(3, 300, 20))] + rows_of(4, 3, 10)[1:]
    rows = [r for k, r in enumerate(rows) if (r[0], r[1]) not in {(x[0], x[1]) for x in rows[:k]}] if len(rows) < 500 else list({(r[0], r[1]): r for r in rows}.values())
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = chat.repaired(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert len([r for r in rows if r[0] == 7]) > 2 * chat.SEGMENT
    check(sorted(rows, key=lambda r: (r[0], r[1])), out)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "q"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 0, "user", "x" * 100_000)]
    out = chat.repaired(frame(spark, rows)).collect()
    assert len(out) == 5
    assert sorted(r.action for r in out if r.conv_id == 1) == ["keep", "merge"]
    assert chat.repaired(frame(spark, rows).limit(0)).count() == 0
