import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from venuegrid.llm import bpe, queries, token_counts, words

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["'s", "'", "re", "'re", "'ll", "ve", "s", "t", "d", " ", "  ", "\n", "\t", "　", "\xa0", "!", "?", "12", "٣", "\xe9",
         "日本", "a", "the", "Z", "\U0001f600", "\x1c", "​", "''", "'S", "́", "m", "'d "]


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        return bpe.Encoder(file.read())


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_blocks_encode_as_the_library_does(encoder, library):
    draw = random.Random(3)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 25))) for _ in range(5000)] + [None, "", "a" * 5000, " " * 300 + "x"]
    offsets, data = words.text_buffers(pa.array(texts, pa.string()))
    ids, first = bpe.encode_block(encoder, offsets, data)
    for k, text in enumerate(texts):
        own = ids[first[k]:first[k + 1]]
        assert own.tolist() == library.encode_ordinary(text or ""), repr(text)
        assert encoder.decode(own).tobytes() == (text or "").encode()


def test_prefix_table_appends_and_edits(encoder):
    draw = random.Random(5)
    for _ in range(200):
        old = "".join(draw.choice(PARTS) for _ in range(30)).encode()
        table = bpe.PrefixTable(encoder, old[:10])
        table.append(old[10:])
        assert table.tokens() == encoder.merged(old)
        a = draw.randint(0, len(old))
        b, new = draw.randint(a, len(old)), draw.choice(PARTS).encode()
        table.edit(a, b, new)
        assert table.tokens() == encoder.merged(old[:a] + new + old[b:])


def test_an_edit_is_local(encoder):
    text = b" unbelievable" * 400
    table = bpe.PrefixTable(encoder, text)
    assert table.edit(20, 21, b"q") < 400
    assert table.tokens() == bpe.PrefixTable(encoder, text[:20] + b"q" + text[21:]).tokens()


def test_query_equals_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.queries()["op5_byte_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows_and_columns(spark, library):
    rows = [(1, None, "x", 7), (None, "", "y", 7), (2, "Hello  world", None, 7), (2, "Hello  world", None, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, BPE string, n_tokens int")
    out = bpe.with_digests(frame, PATH, into="bpe")
    assert out.columns == ["doc_id", "text", "n_tokens", "bpe"]
    assert sorted(r.bpe.n_tokens for r in out.collect()) == [0, 0, *[len(library.encode_ordinary("Hello  world"))] * 2]
    assert [r.bpe.ids for r in bpe.with_ids(frame, PATH).where("doc_id = 2").collect()] == [library.encode_ordinary("Hello  world")] * 2
    assert bpe.with_digests(frame.limit(0), PATH).count() == 0


def test_limit_table_answers_every_limit(spark, library):
    draw = random.Random(9)
    texts = [None, ""] + ["word " * draw.randint(0, 60) for _ in range(60)] + ["x y " * 3000]
    lengths = [len(library.encode_ordinary(t or "")) for t in texts]
    histogram = token_counts.length_histogram(spark.createDataFrame([(t, 1) for t in texts], "text string, length int"), PATH)
    table = token_counts.limit_table(histogram)
    rows = {r.length: r for r in table.collect()}
    assert set(rows) == set(lengths)
    for limit, r in rows.items():
        longer = [n for n in lengths if n > limit]
        assert (r.documents, r.documents_over, r.tokens_over) == (lengths.count(limit), len(longer), sum(longer))
        assert r.truncated_tokens == sum(min(n, limit) for n in lengths)
        assert (r.documents_within, r.tokens, r.all_documents) == (len(lengths) - len(longer), sum(lengths), len(lengths))
    for limit in (0, 7, 33, 10**6):
        assert token_counts.truncated_total(table, limit).head().truncated_tokens == sum(min(n, limit) for n in lengths)
    found = {r.share: r.length for r in token_counts.length_quantiles(table, [0.0, 0.5, 1.0]).collect()}
    ordered = sorted(lengths)
    assert found == {0.0: ordered[0], 0.5: ordered[math_ceil(len(ordered) / 2) - 1], 1.0: ordered[-1]}
    assert token_counts.limit_table(histogram.limit(0)).count() == 0


def math_ceil(x):
    return -int(-x // 1)


def test_pairs_by_the_seam_are_the_pairs_by_merging(encoder):
    assert encoder.ordered
    dice = random.Random(3)
    often, every = sorted(encoder.whole.values())[:600], list(encoder.whole.values())
    refused = 0
    for k in range(20_000):
        tokens = often if k % 2 else every
        left, right = dice.choice(tokens), dice.choice(tokens)
        want = encoder._apart_by_merging(left, right)
        refused += not want
        assert encoder._apart(left, right) == want
    assert refused > 100
