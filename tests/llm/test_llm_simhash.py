import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_brute import SPACED, lower

from venuegrid.llm import queries, simhash, words

SMALL = "/root/testdata/sf0.001"


def brute_print(text):
    w = SPACED.findall(lower(text))
    grams = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    codes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def brute_groups(docs):
    """doc_id -> (fingerprint, component) of (doc_id, text), every two fingerprints compared."""
    prints = {}
    for i, text in docs:
        if i is not None:
            prints.setdefault(i, set()).add(brute_print(text))
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any((x ^ y).bit_count() <= 2 for x in prints[a] for y in prints[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return prints, {i: find(i) for i in ids}


@pytest.mark.parametrize("size", [1, 50, 1 << 20])
def test_fingerprints_follow_their_definition(size, monkeypatch):
    draw = random.Random(size)
    pool = ["a", "B", "Zz", "\xe9t\xe9", "日本", "the", "x" * 40, "\xc9", "1", "\xa0"]
    texts = ["".join(draw.choice(pool) + draw.choice([" ", "\t\n", "  ", "\x0b"]) for _ in range(draw.randint(0, 30))) for _ in range(200)]
    texts += [None, "", " \n ", "one", "one two", "no blank at the end of this"]
    monkeypatch.setattr(simhash, "_CHUNK", max(1, size // 7))
    monkeypatch.setattr(words, "RUN_BYTES", size)
    found = simhash.fingerprints(*words.text_buffers(pa.array(texts, pa.string())))
    assert found.tolist() == [brute_print(t) for t in texts]


def test_the_code_is_perfect():
    moves, first, count = simhash._moves(2)
    assert len(moves) == sum(__import__("math").comb(23, w) for w in range(6))
    assert (count[:, 0] == 1).all()  # each word has one anchor within the radius
    assert (simhash.syndrome(moves[first[:, 0]]) == np.arange(1 << 11)).all()


def test_a_home_is_among_the_anchors_of_all_near_fingerprints():
    draw = random.Random(4)
    for _ in range(60):
        x = draw.getrandbits(64)
        y = x
        for bit in draw.sample(range(64), draw.randint(0, 2)):
            y ^= 1 << bit
        home = simhash.anchors(np.array([x], np.uint64), 0)[1]
        at = simhash.anchors(np.array([y], np.uint64))[1]
        assert len(home) == 1 and home[0] in at and len(set(at.tolist())) == len(at)
        for anchor in at.tolist():
            assert ((y ^ anchor) & ((1 << 46) - 1)).bit_count() <= 2 * simhash.RADIUS + simhash.THRESHOLD


def test_links_equal_all_pairs(spark):
    draw = random.Random(6)
    centres = [0, 2**64 - 1, *(draw.getrandbits(64) for _ in range(30))]
    prints = set(centres)
    for c in centres:
        for _ in range(25):
            y = c
            for bit in draw.sample(range(64), draw.randint(1, 4)):
                y ^= 1 << bit
            prints.add(y)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    rows = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long")).collect()
    expected = {(a, b) for k, b in enumerate(signed) for a in signed[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert len(rows) == len(expected) and {tuple(r) for r in rows} == expected


def check(docs, rows):
    prints, groups = brute_groups(docs)
    assert len(rows) == len(docs)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert int(r.fingerprint, 16) in prints[r.doc_id] and len(r.fingerprint) == 16
            assert r.component_id == groups[r.doc_id]


def test_query_equals_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(docs, queries.queries()["op12_simhash"](spark, SMALL).collect())


def test_odd_rows_and_columns(spark):
    long = " ".join(f"w{k % 977}" for k in range(300_000))
    docs = [(5, "one two three four"), (9, "One  two\nthree four"), (9, "other words stand here"), (3, "other words stand here"), (None, "other words stand here"),
            (7, None), (8, ""), (8, ""), (2, " \t"), (11, long), (12, long + " end"), (13, "x" * 3_000_000)]
    frame = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in docs], "doc_id long, text string, print string, node int, component_id int")
    check(docs, simhash.near_copies(frame).collect())
    assert simhash.near_copies(frame.limit(0)).collect() == []
    names = simhash.near_copies(frame)
    assert names.columns == ["doc_id", "fingerprint", "component_id"]
