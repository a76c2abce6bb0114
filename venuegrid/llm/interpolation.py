"""Operator 8: word bigram scores by deleted interpolation.

P(w | v) = l(b) c(vw) / c(v) + (1 - l(b)) (c(w) + 1) / (N + V + 1), where b is the
power of two of c(v), the bucket of the context's frequency. The weights l(b) are
learned by expectation-maximisation on documents held out of the counts; then those
documents are counted too.

Counts are looked up in blocks. Each block of texts sends its distinct words and
bigrams, as sorted packed keys with their counts, to shards of the key space; a
shard adds up what all blocks sent and answers each with the totals in the same
order. A frequent word therefore costs one key in a block, and no task holds all keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuegrid.llm import words
from venuegrid.llm.ship import ship
from venuegrid.session import settle

FOLDS, TEST_FOLD, TUNING_FOLD = 7, 2, 3
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 16 << 20
_START, _END = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_RATIO_STEPS, _UNSEEN = 16, -100_000

_KEYS = "shard long, chunk long, u_at long, b_at long, u_keys binary, b_keys binary, u_counts binary, b_counts binary"
_HOME = "chunk long, doc_id {kind}, fold array<int>, ends binary, text binary"
_REPLY = "chunk long, u_at long, b_at long, u_counts binary, b_counts binary, n_train long, n_tuning long, v_train long, v_all long"
_COUNTED = (
    "chunk long, doc_id {kind}, fold array<int>, ends binary, n_known array<long>, unigram binary, bigram binary, "
    "tuning_first binary, tuning_unigram binary, tuning_bigram binary, n_train long, n_tuning long, v_train long, v_all long"
)


def pack(values: np.ndarray) -> bytes:
    """Integers by planes of their bytes, compressed; sorted keys are packed as differences."""
    plain = np.ascontiguousarray(values)
    planes = plain.view(np.uint8).reshape(len(plain), plain.dtype.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: bytes, kind) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    item = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(item, size // item).T).reshape(-1).view(kind)


def _keys_out(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def _keys_in(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


class Tokens:
    """Tokens of a block: the words of each text and its end; ``context`` is the token before, or the start."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        found = words.split_words(offsets, data)
        texts = len(offsets) - 1
        self.text = np.repeat(np.arange(texts), np.diff(found.first) + 1)
        self.ends = found.first[1:] + np.arange(1, texts + 1)  # after the end of each text
        self.code = np.full(len(found.code) + texts, _END, np.uint64)
        self.code[np.arange(len(found.code)) + found.text] = found.code
        begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
        self.context = np.empty_like(self.code)
        self.context[1:] = self.code[:-1]
        self.context[begins] = _START
        self.begins = begins
        self.pair = words.mix(self.context * np.uint64(0x9E3779B97F4A7C15) + self.code)


def _blocks(batches: Iterator[pa.RecordBatch]):
    """(chunk, rows, offsets, bytes); a chunk is named by its place and content, so both scans agree or are found out."""
    task, turn = TaskContext.get().partitionId(), 0
    for rows, offsets, data in words.blocks(batches, size=BLOCK_BYTES):
        digest = hashlib.blake2b(data, digest_size=8, key=f"{task}/{turn}/{rows.num_rows}".encode())
        turn += 1
        yield int.from_bytes(digest.digest(), "little") >> 1, rows, offsets, data


def _fold(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("fold").fill_null(TEST_FOLD).to_numpy(zero_copy_only=False)


def _ask(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """The distinct keys of each block with their counts in learning and in tuning texts, by shard."""
    for chunk, rows, offsets, data in _blocks(batches):
        tokens, fold = Tokens(offsets, data), _fold(rows)
        learns, tunes = (fold != TEST_FOLD) & (fold != TUNING_FOLD), fold == TUNING_FOLD
        parts = []
        for keys, text in (
            (np.concatenate([tokens.code, np.full(rows.num_rows, _START)]), np.concatenate([tokens.text, np.arange(rows.num_rows)])),
            (tokens.pair, tokens.text),
        ):
            own, which = np.unique(keys, return_inverse=True)
            counts = np.stack([np.bincount(which, weights=mask[text], minlength=len(own)).astype(np.uint32) for mask in (learns, tunes)])
            shard = ((own >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)
            parts.append((own, counts, shard))
        columns: list[list] = [[] for _ in range(8)]
        for p in np.union1d(parts[0][2], parts[1][2]).tolist():
            spans = [slice(*np.searchsorted(shard, [p, p + 1])) for _, _, shard in parts]
            line = [p, chunk, spans[0].start, spans[1].start]
            line += [_keys_out(own[s]) for (own, _, _), s in zip(parts, spans)]
            line += [pack(counts[:, s].reshape(-1)) for (_, counts, _), s in zip(parts, spans)]
            for column, value in zip(columns, line):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64() if k < 4 else pa.binary()) for k, c in enumerate(columns)],
            names=["shard", "chunk", "u_at", "b_at", "u_keys", "b_keys", "u_counts", "b_counts"],
        )


def _home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block as one row."""
    for chunk, rows, offsets, data in _blocks(batches):
        one = pa.array([0, rows.num_rows], pa.int32())
        yield pa.RecordBatch.from_arrays([
            pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(one, rows.column("doc_id")), pa.ListArray.from_arrays(one, rows.column("fold").cast(pa.int32())),
            pa.array([pack(offsets)], pa.binary()), pa.array([len(data).to_bytes(8, "little") + pa.compress(data.tobytes(), codec="zstd", asbytes=True)], pa.binary()),
        ], names=["chunk", "doc_id", "fold", "ends", "text"])


def _answer(rows: pa.Table) -> pa.Table:
    """Totals of one shard, for each block in the order of its keys; the shard's own sums as a line without a block."""
    replies: list[list[bytes]] = []
    sums = [0, 0, 0, 0]
    for kind in ("u", "b"):
        keys = [_keys_in(b) for b in rows[f"{kind}_keys"].to_pylist()]
        counts = [unpack(b, np.uint32).reshape(2, -1) for b in rows[f"{kind}_counts"].to_pylist()]
        own, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.stack([np.bincount(which, weights=np.concatenate([c[k] for c in counts]), minlength=len(own)).astype(np.int64) for k in (0, 1)])
        ends = np.cumsum([len(k) for k in keys])
        replies.append([pack(total[:, which[e - len(k):e]].reshape(-1)) for e, k in zip(ends, keys)])
        if kind == "u":
            is_word = own != _START
            sums = [int(x) for x in (total[0][is_word].sum(), total[1][is_word].sum(), (total[0][is_word] > 0).sum(), (total.sum(axis=0)[is_word] > 0).sum())]
    n, shard = rows.num_rows, rows["shard"][0].as_py()
    none = [None]
    return pa.table({
        "chunk": pa.array([*rows["chunk"].to_pylist(), -1 - shard], pa.int64()),
        "u_at": pa.array([*rows["u_at"].to_pylist(), *none], pa.int64()), "b_at": pa.array([*rows["b_at"].to_pylist(), *none], pa.int64()),
        "u_counts": pa.array(replies[0] + none, pa.binary()), "b_counts": pa.array(replies[1] + none, pa.binary()),
        **{name: pa.array([None] * n + [value], pa.int64()) for name, value in zip(("n_train", "n_tuning", "v_train", "v_all"), sums)},
    })


def _count(home: pa.Table, replies: pa.Table, names: list[str]) -> pa.Table:
    """Counts of each token and bigram of a block, packed in the order of the text."""
    kinds = {c: pa.binary() for c in names} | {c: pa.int64() for c in names if c == "chunk" or c.startswith(("n_", "v_"))}
    kinds |= {"doc_id": home.schema.field("doc_id").type, "fold": home.schema.field("fold").type, "n_known": pa.list_(pa.int64())}
    if not home.num_rows:  # a shard's sums
        return pa.table({c: replies[c] if c in replies.column_names else pa.nulls(replies.num_rows, kinds[c]) for c in names})
    line = home.slice(0, 1).to_pylist()[0]
    blob = line["text"]
    data = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    tokens = Tokens(unpack(line["ends"], np.int64), data)
    found = []
    for kind, keys in (("u", np.concatenate([tokens.code, [_START]])), ("b", tokens.pair)):
        own, which = np.unique(keys, return_inverse=True)
        total, seen = np.zeros((2, len(own)), np.int64), 0
        for at, counts in zip(replies[f"{kind}_at"].to_pylist(), replies[f"{kind}_counts"].to_pylist()):
            part = unpack(counts, np.int64).reshape(2, -1)
            total[:, at:at + part.shape[1]] = part
            seen += part.shape[1]
        if seen != len(own) and len(tokens.code):
            raise RuntimeError("the two scans cut the documents into different blocks")
        found.append(total[:, which])
    (uni, bi), texts = found, len(line["doc_id"])
    fold = np.array([TEST_FOLD if f is None else f for f in line["fold"]], np.int64)
    start, uni = uni[:, -1], uni[:, :-1]
    known = np.bincount(tokens.text, weights=uni.sum(axis=0) > 0, minlength=texts).astype(np.int64)
    first = uni[:, :0] if not len(tokens.code) else np.concatenate([start[:, None], uni[:, :-1]], axis=1)
    first[:, tokens.begins] = start[:, None]
    tuned = fold[tokens.text] == TUNING_FOLD
    values = {
        "ends": pack(tokens.ends), "unigram": pack(np.concatenate([uni.sum(axis=0), [start.sum()]])), "bigram": pack(bi.sum(axis=0)),
        "tuning_first": pack(first[0][tuned]), "tuning_unigram": pack(uni[0][tuned]), "tuning_bigram": pack(bi[0][tuned]),
    }
    made = {"chunk": home["chunk"].slice(0, 1), "doc_id": home["doc_id"].slice(0, 1), "fold": home["fold"].slice(0, 1), "n_known": pa.array([known], pa.list_(pa.int64()))}
    made |= {c: pa.array([v], pa.binary()) for c, v in values.items()}
    return pa.table({c: made[c] if c in made else pa.nulls(1, kinds[c]) for c in names})


def _ratios(batches: Iterator[pa.RecordBatch], n: int, v: int) -> Iterator[pa.RecordBatch]:
    """How often which ratio of the two estimates occurs in tuning texts, by bucket."""
    for batch in batches:
        for line in batch.to_pylist():
            first, uni, bi = (unpack(line[f"tuning_{c}"], np.int64) for c in ("first", "unigram", "bigram"))
            seen = first > 0
            first, uni, bi = first[seen], uni[seen], bi[seen]
            bucket = np.log2(first).astype(np.int64)
            ratio = np.full(len(bi), _UNSEEN, np.int64)
            met = bi > 0
            ratio[met] = np.rint(_RATIO_STEPS * np.log2(bi[met] / first[met] * (n + v + 1) / (uni[met] + 1)))
            code, count = np.unique(bucket * 1_000_000 + ratio + 500_000, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code // 1_000_000), pa.array(code % 1_000_000 - 500_000), pa.array(count)], names=["bucket", "ratio", "n"])


def learn_weights(bucket: np.ndarray, ratio: np.ndarray, count: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weight of the bigram estimate for each bucket by EM; a bucket without tuning tokens takes the one below."""
    size = int(bucket.max(initial=0)) + 1
    weights, r = np.full(size, 0.5), np.where(ratio == _UNSEEN, 0.0, np.exp2(ratio / _RATIO_STEPS))
    total = np.bincount(bucket, weights=count, minlength=size)
    for _ in range(rounds):
        mine = weights[bucket] * r
        share = mine / (mine + 1 - weights[bucket])
        weights = np.bincount(bucket, weights=count * share, minlength=size) / np.maximum(total, 1)
        weights = np.minimum(weights, 1 - 1e-6)
    for b in range(size):
        if not total[b]:
            weights[b] = weights[b - 1] if b else 0.0
    return weights


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n: int, v: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            line = {c: batch.column(c)[k].as_py() for c in ("ends", "unigram", "bigram", "n_known")}
            ends, uni, bi = (unpack(line[c], np.int64) for c in ("ends", "unigram", "bigram"))
            uni, start = uni[:-1], uni[-1]
            begins = np.concatenate([[0], ends[:-1]])
            first = np.concatenate([[start], uni[:-1]])
            first[begins] = start
            base = (uni + 1) / (n + v + 1)
            bucket = np.log2(np.maximum(first, 1)).astype(np.int64)
            weight = np.where(first > 0, weights[np.minimum(bucket, len(weights) - 1)], 0.0)
            mixed = weight * bi / np.maximum(first, 1) + (1 - weight) * base
            text = np.repeat(np.arange(len(ends)), ends - begins)
            sums = [np.bincount(text, weights=np.log10(p), minlength=len(ends)) for p in (base, mixed)]
            whole = batch.slice(k, 1)
            yield pa.RecordBatch.from_arrays([
                whole.column("doc_id").flatten(), whole.column("fold").flatten(), pa.array(ends - begins), pa.array(line["n_known"], pa.int64()),
                pa.array(sums[0]), pa.array(sums[1]),
            ], names=["doc_id", "fold", "n_tokens", "n_known", "base_score", "score"])


def scored(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Tokens are the words, A-Z lower-cased, then one end; a missing or empty text is
    the end alone. Learned from rows whose crc32(doc_id) mod 7 is not 2. A row
    without a doc_id is scored, not learned from, and has no ``held_out``. Equal rows
    each count. Without any learning rows every token has the probability 1. Other
    columns are not read; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    fold = F.pmod(F.crc32(docs[f"`{doc_id}`"].cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), fold.alias("fold"), docs[f"`{text}`"].cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).head()[0] or 0
    asked = rows.mapInArrow(partial(_ask, shards=max(1, -(-size // SHARD_BYTES))), _KEYS)
    replies = asked.groupBy("shard").applyInArrow(_answer, _REPLY)
    home = rows.mapInArrow(_home, _HOME.format(kind=f"array<{kind}>"))
    schema = _COUNTED.format(kind=f"array<{kind}>")
    names = [c.split()[0] for c in schema.split(", ")]
    counted = home.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(partial(_counted, names=names), schema)
    counted = settle(counted, "counted")
    sums = counted.where("chunk < 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train", "n_tuning", "v_train", "v_all")]).head()
    blocks = counted.where("chunk >= 0")
    tuning = blocks.select("tuning_first", "tuning_unigram", "tuning_bigram").mapInArrow(partial(_ratios, n=sums.n_train, v=sums.v_train), "bucket long, ratio long, n long")
    table = tuning.groupBy("bucket", "ratio").agg(F.sum("n").alias("n")).toArrow()  # a grid of fixed size
    weights = learn_weights(*(table[c].to_numpy() for c in ("bucket", "ratio", "n")))
    n = sums.n_train + sums.n_tuning
    out = blocks.select("doc_id", "fold", "ends", "n_known", "unigram", "bigram").mapInArrow(
        partial(_score, weights=weights, n=n, v=sums.v_all), f"doc_id {kind}, fold int, n_tokens long, n_known long, base_score double, score double"
    )
    return out.select(
        F.col("doc_id").alias(doc_id), (F.col("fold") == TEST_FOLD).alias("held_out"), "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
    )


def _counted(home: pa.Table, replies: pa.Table, *, names: list[str]) -> pa.Table:
    return _count(home, replies, names)
