"""Language-model scores, toxicity, URL models and quality rules."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_brute import fold, interpolated

from venuegrid.llm import interpolation, quality_rules, queries, toxicity, url_filter, words


def texts(seed, n):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        words = ["the"]
        for _ in range(draw.randint(0, 30)):
            words.append(f"{words[-1][:1]}{draw.randint(0, 3)}" if draw.random() < 0.7 else draw.choice(["The", "a1", "zz,", "\xc9t\xe9"]))
        out.append(" ".join(words))
    return out


def test_interpolation_equals_counting(spark):
    docs = [(i, t) for i, t in enumerate([*texts(1, 120), None, "", " \n"])] + [(10**6, "unseen words only")]
    want = interpolated(docs, lambda lines: interpolation.learn_weights(*map(np.array, zip(*[(b, r, n) for (b, r), n in lines.items()]))))
    rows = interpolation.scored(spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, known, train, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, train, fold(r.doc_id, 7) == 2)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-6)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_interpolation_over_several_blocks_and_shards(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts(2, 200))), "doc_id long, text string").repartition(3).sortWithinPartitions("doc_id")
    docs.write.mode("overwrite").parquet(path := f"{spark.sparkContext.getConf().get('spark.checkpoint.dir', '/tmp')}/llm-blocks")
    docs = spark.read.parquet(path)
    whole = {r.doc_id: tuple(r) for r in interpolation.scored(docs).collect()}
    monkeypatch.setattr(interpolation, "SHARD_BYTES", 500)
    split = {r.doc_id: tuple(r) for r in interpolation.scored(docs).collect()}
    for i, row in whole.items():
        assert row[:5] == split[i][:5] and row[5:] == pytest.approx(split[i][5:])


def test_odd_rows_of_interpolation(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (9, "x" * 200_000)]
    out = interpolation.scored(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.held_out for r in out.where("doc_id is null").collect()] == [None]
    assert out.count() == 4
    assert interpolation.scored(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_packing_round_trip():
    draw = np.random.default_rng(1)
    for kind in (np.uint64, np.int64, np.uint32):
        for size in (0, 1, 1000):
            values = draw.integers(0, 2**31, size).astype(kind)
            assert interpolation.unpack(interpolation.pack(values), kind).tolist() == values.tolist()


def test_weights_grow_with_reliable_contexts():
    bucket, ratio = np.array([0, 0, 3, 3]), np.array([-100_000, 64, -100_000, 64])
    weights = interpolation.learn_weights(bucket, ratio, np.array([90, 10, 10, 90]))
    assert weights[0] < weights[3] and weights[1] == weights[2] == weights[0]


@pytest.fixture(scope="module")
def toxic(spark):
    draw = random.Random(4)
    bad, plain = ["idiot", "stupid", "moron", "clown", "scum"], [f"{a}{b}{c}" for a in ("ban", "tel", "dor", "mi") for b in ("ta", "lo", "ri") for c in ("n", "st", "ke")]
    hidden = {"idiot": "1d10t", "stupid": "s t u p i d", "moron": "moooooron", "clown": "cl0wn", "scum": "s.c.u.m"}
    docs, labels, tests = [], [], []
    for i in range(600):
        words = [draw.choice(plain) for _ in range(draw.randint(5, 60))]
        label = int(draw.random() < 0.4)
        if label:
            for word in draw.sample(bad, 2):
                if fold(i, 3) == 1:
                    tests.append(i)
                    word = hidden[word] if draw.random() < 0.7 else word
                words.insert(draw.randint(0, len(words)), word)
        docs.append((i, " ".join(words), "x"))
        labels.append((i, label))
    docs = spark.createDataFrame(docs, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_hidden_words_are_read_and_found(spark, toxic):
    docs, labels = toxic
    model = toxicity.fit(docs, labels)
    reader = toxicity.Reader(model.characters)
    forms = {"1d10t": "idiot", "s t u p i d": "stupid", "moooooron": "moron", "cl0wn": "clown", "s.c.u.m": "scum"}
    assert {form: reader.read(form) for form in forms} == forms
    assert reader.read("banta") == "banta"
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.scored(docs, model, into="t").collect()
    held = [(truth[r.doc_id], r.t.score >= toxicity.THRESHOLD) for r in rows if fold(r.doc_id, 3) == 1]
    assert sum(t == p for t, p in held) >= 0.97 * len(held)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    clean = {i for i, t in truth.items() if not t}
    assert len(clean - {r.doc_id for r in kept.collect()}) <= 0.02 * len(clean)


def test_every_channel_symbol_opens_a_word(spark, toxic):
    plain = "worthless puke scum stupid trash idiot moron loser"
    hidden = {
        "worthle$$": "worthless", "worthle55": "worthless", "puk3": "puke", "sc.um": "scum", "st-upid": "stupid",
        "t r 4 s h": "trash", "1 d 1 0 t": "idiot", "1 d 1 0 t!": "idiot", "moroon": "moron", "looser": "loser",
        "scUuUm": "scum", "scuUm,": "scum", "s t u p i d.": "stupid", "(s - t - u - p - i - d)": "stupid", "s. c. u. m.": "scum",
    }
    docs, _ = toxic
    trained = docs.select("text").unionByName(spark.createDataFrame([(f"{plain} see too Hannah. {plain}! 1998 250 - 3.75 4 6",)] * 40, "text string"))
    reader = toxicity.Reader(toxicity.character_model(trained))
    buffers = words.text_buffers(pa.array([f"banta {form} telri" for form in hidden]))
    assert sorted(found[:2] for found in toxicity.restored(*buffers, reader)) == list(enumerate(hidden.values()))
    kept = [f"{plain} see too Hannah.", f"{plain.title()}!", "2024 100 - 3.14 1 2 3 (banta) telri! \xc9\xe9", "banta - a telri-banta", "", None]
    assert toxicity.restored(*words.text_buffers(pa.array(kept)), reader) == []


def test_odd_rows_of_toxicity(spark, toxic):
    docs, labels = toxic
    odd = spark.createDataFrame([(None, "1d10t", 1), (1, None, 1), (1, "", 1), (2, "a b c " * 50_000, 1), (2, "0" * 20_000 + "a", 1)], "doc_id long, text string, T int")
    model = toxicity.fit(docs.unionByName(odd.selectExpr("doc_id", "text", "string(T) AS score")), labels.unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")))
    rows = toxicity.scored(odd, model, into="t").collect()
    assert len(rows) == 5 and all(0 <= r.t.score <= 1 for r in rows)
    assert len({r.t.score for r in rows if not r.t.restored and r.doc_id == 1}) <= 1
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.t.score for r in toxicity.scored(docs, none, into="t").collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_toxicity_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.queries()["op4_toxicity"](spark, folder).collect()]
    assert len(rows) == 1000 and all(r.held_out == (fold(r.doc_id, 3) == 1) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(t == p for t, p in held) >= 0.95 * len(held)


URLS = [
    (None, "", "", None), ("no scheme.com/x", "", "", None), ("http://A.Com", "a.com", "", None), ("http://a.com/", "a.com", "/", "com/"),
    ("x://Example.com/en/1?q#f", "example.com", "/en/1", "example.com/en/"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
    ("https://m.www.example.com/en/a", "m.www.example.com", "/en/a", "www.example.com/en/"), ("https://myexample.com/en/a", "myexample.com", "/en/a", "com/"),
    ("https://a.net/es/1", "a.net", "/es/1", "net/es/"), ("https://a.net/fr", "a.net", "/fr", None), ("http://b.net?x=/fr/", "b.net", "", None),
    ("a://b.com://c/d", "b.com:", "//c/d", None), ("http://com/x", "com", "/x", "com/"), ("", "", "", None), ("http://\xc9X.org/\xe9", "\xc9x.org", "/\xe9", None),
]


def test_hosts_paths_and_rules(spark):
    frame = spark.createDataFrame([(k, u, "x") for k, (u, *_) in enumerate(URLS)] * 2, "page_id long, url string, host string")
    out = url_filter.judged(frame, into="v")
    assert out.columns == ["page_id", "url", "host", "v"]
    rows = out.collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r.v.host, r.v.path, r.v.rule) == URLS[r.page_id][1:]
        assert r.v.verdict in ("allow", "block") and (r.v.score_bin is None) == (r.v.rule is not None)
        assert r.v.rule is None or r.v.verdict == dict((b, a) for a, b in url_filter.RULES)[r.v.rule]
    assert url_filter.judged(frame.limit(0)).count() == 0


def test_url_models_equal_counting(spark):
    rows = queries.queries()["op3_url_filter"](spark, "/root/testdata/sf0.01").collect()
    pages = url_filter.judged(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url"), into="v").collect()
    assert len(rows) == len(pages) == 250
    keys = {r.body: r.key for r in spark.createDataFrame([(r.v.host + r.v.path,) for r in pages], "body string").distinct().selectExpr("body", "xxhash64(body) AS key").collect()}
    bodies = {r.v.host + r.v.path: (r.v.verdict if r.v.rule else None) for r in pages}
    held = {b for b in bodies if keys[b] % url_filter.HELD_OUT == 0}
    grams = lambda b: [("\x02" * 4 + b + "\x03")[k:k + 5] for k in range(len(b) + 1)]
    logs = {}
    for verdict in ("allow", "block"):
        counts, follow = [Counter() for _ in range(5)], [defaultdict(set) for _ in range(5)]
        for b, v in bodies.items():
            if v == verdict and b not in held:
                for g in grams(b):
                    for k in range(5):
                        counts[k][g[4 - k:]] += 1
                        counts[k][g[4 - k:4], None] += 1
                        follow[k][g[4 - k:4]].add(g[4])

        def log_p(g, counts=counts, follow=follow):
            p = 1 / 256
            for k in range(5):
                context = g[4 - k:4]
                n, t = counts[k][context, None], len(follow[k][context])
                p = (counts[k][g[4 - k:]] + t * p) / (n + t) if n else p
            return math.log(p)
        logs[verdict] = log_p
    score = lambda b: math.floor(100 * round(sum(logs["block"](g) - logs["allow"](g) for g in grams(b)) / len(grams(b)), 9))
    threshold = url_filter.calibrated([(score(b), v, 1) for b, v in bodies.items() if v and b in held])
    for r in pages:
        if not r.v.rule:
            own = score(r.v.host + r.v.path)
            assert abs(r.v.score_bin - own) <= 1
            if r.v.score_bin == own:
                assert r.v.verdict == ("block" if own >= threshold else "allow")


def test_calibration():
    assert url_filter.calibrated([(-5, "allow", 3), (2, "block", 3)]) == 0
    assert url_filter.calibrated([(1, "allow", 4)]) == 0


def test_copies_of_a_row_lose_their_own_words_once(spark):
    common, own = " ".join(f"c{'abcdefghi'[k]}" for k in range(9)), [" ".join(f"w{n}x{'abcdefghijklmnopqrstu'[k]}" for k in range(21)) for n in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(k, f"{common}\n{text}", "h") for k, text in enumerate(own)]
    given = spark.createDataFrame([*rows, *rows[:1], *rows[1:2] * 30], "doc_id long, text string, source string")
    found = quality_rules.judged(given).collect()
    assert len(found) == len(rows) + 31
    assert {(r.quality.n_words, r.quality.removed_words, r.quality.kept, len(r.quality.removed_lines)) for r in found} == {(30, 9, True, 1)}


def test_odd_rows_of_quality_rules(spark):
    good = " ".join(f"w{k}" for k in range(30))
    rows = [(None, good, None), (1, None, "h"), (1, "", "h"), (2, good, "h"), (2, good, "h"), (3, "x " * 60_000, "h")] + [(k, f"Common 1{k} line\n{good} v{chr(97 + k % 26)}{chr(97 + k // 26)}", "hot") for k in range(10, 60)]
    given = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, Quality int")
    out = quality_rules.judged(given)
    assert out.columns == ["doc_id", "text", "source", "quality"]
    found = out.withColumn("cleaned", quality_rules.cleaned()).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None or r.doc_id == 2:
            assert r.quality.kept and r.quality.n_words == 30 and r.cleaned == good
        elif r.doc_id == 1:
            assert r.quality.base_failed and not r.quality.kept and r.quality.n_words == 0 and r.cleaned == r.text
        elif r.doc_id == 3:
            assert r.quality.n_repeat_words == 60_000 and not r.quality.kept
        else:
            assert r.cleaned == f"{good} v{chr(97 + r.doc_id % 26)}{chr(97 + r.doc_id // 26)}" and r.quality.removed_words == 3 and r.quality.kept
    assert quality_rules.judged(given.limit(0)).count() == 0
