"""Line runs, near copies and test passages against plain Python."""

import random
import time
from collections import Counter

import pytest
from llm_brute import LETTERS, dedup_lines, lower, near_groups, test_hits

from venuegrid.llm import decontamination, line_dedup, ngram_join


def sentence(draw, n, words=60):
    return " ".join(f"w{draw.randint(0, words)}" for _ in range(n))


@pytest.fixture(scope="module")
def near():
    draw = random.Random(1)
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one  TWO"), (5, "one two three")]
    for family in range(6):
        base = sentence(draw, draw.randint(8, 90), 500).split()
        for _ in range(draw.randint(1, 12)):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = f"x{draw.randint(0, 9)}"
            docs.append((len(docs), " ".join(copy)))
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, f"c{i}") for i, t in docs], "doc_id long, text string, n_shingles string")


@pytest.mark.parametrize("hot", [10_000, 1])
def test_near_groups(spark, near, hot):
    rows = ngram_join.similar_groups(frame(spark, near), hot=hot).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == near_groups(near)
    assert len(rows) == len(near)


def test_odd_rows_of_near_groups(spark):
    long = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    docs = [(1, long), (1, long), (None, long), (2, other), (2, long), (3, other), (4, "z")]
    rows = sorted((tuple(r) for r in ngram_join.similar_groups(frame(spark, docs)).collect()), key=str)
    assert rows == sorted([(1, 36, 1), (1, 36, 1), (None, 36, None), (2, 36, 1), (2, 36, 1), (3, 36, 1), (4, 1, 4)], key=str)
    assert ngram_join.similar_groups(frame(spark, docs).limit(0)).count() == 0
    kept = ngram_join.one_of_each_group(frame(spark, docs))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, long), (1, long), (None, long), (4, "z")], key=str)
    assert kept.columns == ["doc_id", "text", "n_shingles"]


def line_docs(seed):
    draw = random.Random(seed)
    lines = [sentence(draw, draw.choice([1, 2, 3, 6]), 400) for _ in range(40)] + ["", "  "]
    docs = []
    for i in range(40):
        own = [draw.choice(lines) for _ in range(draw.randint(0, 14))]
        if docs and draw.random() < 0.5:
            source = draw.choice(docs)[1].split("\n")
            at = draw.randrange(len(source))
            own += source[at:at + draw.randint(1, 8)]
        docs.append((i, "\n".join(own)))
    return docs


@pytest.mark.parametrize("seed, least", [(1, 8), (2, 5), (3, 12), (4, 1)])
def test_line_runs(spark, seed, least):
    docs = line_docs(seed)
    rows = line_dedup.deduplicated(frame(spark, docs), min_words=least).collect()
    assert {r.doc_id: (r.lines.n_lines, r.lines.n_deleted, r.lines.text) for r in rows} == dedup_lines(docs, least)


def test_odd_rows_of_line_runs(spark):
    draw = random.Random(7)
    long = "\n".join(sentence(draw, 30) for _ in range(3))
    docs = [(None, long), (1, long), (1, long), (2, None), (3, ""), (4, "\n \n"), (5, "a " * 120_000), (6, "a " * 120_000), (7, "own\n" + long)]
    given = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, Lines int")
    out = line_dedup.deduplicated(given)
    assert out.columns == ["doc_id", "text", "lines"]
    found = sorted(((r.doc_id, r.lines.n_lines, r.lines.n_deleted, r.lines.text) for r in out.collect()), key=str)
    want = [(None, 3, 0, long), (1, 3, 3, ""), (1, 3, 3, ""), (2, 0, 0, None), (3, 0, 0, ""), (4, 0, 0, "\n \n"), (5, 1, 0, "a " * 120_000), (6, 1, 1, ""), (7, 4, 3, "own")]
    assert found == sorted(want, key=str)
    kept = line_dedup.without_copies(given)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, 2, 3, 4, 5, 7], key=str)
    assert kept.columns == ["doc_id", "text", "Lines"]
    assert line_dedup.deduplicated(given.limit(0)).count() == 0


def test_rows_given_several_times_are_one_document(spark, monkeypatch):
    draw = random.Random(8)
    lines = [f"{sentence(draw, 2)} {k}" for k in range(60)]
    rows = [(1, "\n".join(lines))] * 3 + [(2, "\n".join(["own", *lines]))] + [(None, "\n".join(["none", *lines[:8]]))] * 100
    given = spark.createDataFrame(rows, "doc_id long, text string")
    most = []

    class Counting(line_dedup.Scratch):
        def settle(self, df, name):
            out = super().settle(df, name)
            most.append(out.count())
            return out

    monkeypatch.setattr(line_dedup, "Scratch", Counting)
    line_dedup.deduplicated(given, min_words=4)
    assert max(most) <= 2 * (60 + 61 + 9)
    found = Counter((r.doc_id, r.lines.n_lines, r.lines.n_deleted) for r in line_dedup.deduplicated(given).collect())
    assert found == {(1, 60, 0): 3, (2, 61, 60): 1, (None, 9, 0): 100}


def test_ranks_are_places_of_sorted_keys(spark):
    draw = random.Random(2)
    keys = [(draw.randint(0, 30), draw.randint(0, 3)) for _ in range(500)]
    from venuegrid.llm.scratch import Scratch

    with Scratch(spark) as scratch:
        rows = line_dedup.ranked(scratch, spark.createDataFrame(keys, "a long, b long"), ["a", "b"]).collect()
    ordered = sorted(k for k in keys if keys.count(k) > 1)
    assert {(r.a, r.b): r.rank for r in rows} == {k: ordered.index(k) for k in set(ordered)}


def passages(seed):
    draw = random.Random(seed)
    items = [(k, sentence(draw, draw.choice([0, 1, 3, 9, 10, 11, 40]), 30)) for k in range(25)] + [(25, None), (None, "one odd item without an id"), (3, "two texts of one id")]
    docs = [(0, None), (1, ""), (2, "one odd item, without AN id!")]
    for k in range(60):
        parts = [sentence(draw, draw.randint(0, 40), 30)]
        if draw.random() < 0.6:
            item = (draw.choice(items)[1] or "").split()
            at = draw.randint(0, max(0, len(item) - 10))
            parts.append(" ".join(item[at:at + draw.randint(5, 30)]).upper())
        parts.append(sentence(draw, draw.randint(0, 10), 30))
        docs.append((len(docs), ", ".join(parts)))
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_test_passages(spark, block_bytes):
    docs, items = passages(4)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    given = frame(spark, docs)
    out = decontamination.with_matches(given, bench, into="m", block_bytes=block_bytes).withColumn("n_hit", decontamination.hit_words("m"))
    rows = out.collect()
    assert {r.doc_id: (r.m.n_words, r.n_hit, r.m["items"]) for r in rows} == {i: test_hits(t, items) for i, t in docs}
    for r in rows:
        text = dict(docs)[r.doc_id]
        if r.m.longest:
            w = LETTERS.findall(lower(text))
            run = w[r.m.longest_at:r.m.longest_at + r.m.longest]
            owners = [LETTERS.findall(lower(t)) for i, t in items if (None if i is None else str(i)) == r.m.longest_item]
            assert any(run == o[k:k + len(run)] for o in owners for k in range(len(o)))
    clean = decontamination.decontaminated(given, bench, block_bytes=block_bytes)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in docs if not test_hits(t, items)[1])
    assert clean.columns == given.columns


def test_empty_tables_of_passages(spark):
    docs, items = passages(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.with_matches(frame(spark, docs).limit(0), bench).count() == 0
    rows = decontamination.with_matches(frame(spark, docs), bench.limit(0)).collect()
    assert len(rows) == len(docs) and not any(r.contamination.spans for r in rows)


def longest_match(text, items):
    """(words, first place, id of the first item in order of id and text) by trying every pair of places."""
    words, best = LETTERS.findall(lower(text)), (0, None, None)
    for item, item_text in sorted(((None if i is None else str(i), t) for i, t in items if t), key=lambda x: (x[0] is not None, x[0] or "", x[1])):
        w = LETTERS.findall(lower(item_text))
        for a in range(len(words)):
            for b in range(len(w)):
                size = 0
                while a + size < len(words) and b + size < len(w) and words[a + size] == w[b + size]:
                    size += 1
                if size >= min(10, len(w)) and (size > best[0] or (size == best[0] and a < best[1])):
                    best = (size, a, item)
    return best


@pytest.mark.parametrize("seed, words", [(1, 2), (2, 30)])
def test_longest_matches(spark, seed, words):
    draw = random.Random(seed)
    intro = sentence(draw, 12, words)
    items = [(k, f"{intro if k % 2 else ''} {sentence(draw, draw.choice([2, 10, 25]), words)}") for k in range(14)]
    items += [(20, items[3][1]), (21, items[3][1]), (None, items[5][1])]
    docs = [(k, " ".join([sentence(draw, 6, words), draw.choice(items)[1], intro, sentence(draw, 6, words)])) for k in range(15)] + [(90, None), (91, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.with_matches(frame(spark, docs), bench, into="m").collect()
    assert {r.doc_id: (r.m.longest, r.m.longest_at, r.m.longest_item) for r in rows} == {i: longest_match(t, items) for i, t in docs}
    assert {r.doc_id: r.m["items"] for r in rows} == {i: test_hits(t, items)[2] for i, t in docs}


def test_many_equal_items_cost_one_search(spark):
    """10,000 equal items of one word, and as many with one introduction, against long texts of these words."""
    intro = " ".join(f"word{k}" for k in range(14))
    items = [(k, "ring") for k in range(10_000)] + [(k + 10_000, f"{intro} end{k}") for k in range(10_000)]
    docs = [(1, "ring " * 100_000), (2, f"{intro} end77 " * 200), (3, "word1 word2 clean")]
    start = time.time()
    rows = {r.doc_id: r.m for r in decontamination.with_matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), into="m").collect()}
    assert time.time() - start < 60
    assert len(rows[1]["items"]) == 10_000 and rows[1].spans == [0, 100_000] and (rows[1].longest, rows[1].longest_at) == (1, 0)
    assert len(rows[2]["items"]) == 10_000 and rows[2].spans == [0, 3_000] and (rows[2].longest, rows[2].longest_item) == (15, "10077")
    assert not rows[3].spans and rows[3].longest == 0
