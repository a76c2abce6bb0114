import base64
import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from llm_brute import dedup_lines, near_groups, test_hits

SMALL = "/root/testdata/sf0.001"


def test_stages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_join", "decontamination", "byte_bpe"]

    def run(name, frame):
        out = stages[name](spark, frame, SMALL)
        rows = out.collect()
        return (rows, spark.createDataFrame(rows, out.schema)) if name != "byte_bpe" else (rows, None)

    rows, frame = run("toxicity", docs)
    assert frame.columns == docs.columns
    given = {r.doc_id: r for r in docs.collect()}
    assert all(r == given[r.doc_id] for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert {i for i, t in labels.items() if not t} <= {r.doc_id for r in rows}

    want = dedup_lines([(r.doc_id, r.text) for r in rows], 50)
    rows, frame = run("line_dedup", frame)
    assert frame.columns == docs.columns
    assert {r.doc_id: r.text for r in rows} == {i: t for i, (n, gone, t) in want.items() if not gone or gone < n}
    assert all(r.n_chars == len(r.text) for r in rows)

    groups = near_groups([(r.doc_id, r.text) for r in rows])
    rows, frame = run("ngram_join", frame)
    assert {r.doc_id for r in rows} == {i for i, (_, c) in groups.items() if i == c}

    want = {r.doc_id for r in rows if not test_hits(r.text, items)[1]}
    rows, frame = run("decontamination", frame)
    assert {r.doc_id for r in rows} == want
    texts = {r.doc_id: r.text for r in rows}

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows, _ = run("byte_bpe", frame)
    ids = {i: np.array(library.encode_ordinary(t), "<u4") for i, t in texts.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in rows} == {i: (len(x), hashlib.sha256(x.tobytes()).hexdigest()) for i, x in ids.items()}
    whole = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, rows))


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
