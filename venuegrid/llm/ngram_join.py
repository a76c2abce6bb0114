"""Operator 7: links between documents whose word shingles have a Jaccard similarity of 0.8 or more.

1. A sketch of shingle frequencies (fixed size) gives one order of all shingles, rare ones first.
2. Every text becomes a set of 64-bit shingle codes. Documents with equal sets are
   one node; only the first fifth of a node's ordered set, its prefix, is dealt out.
3. Nodes that meet in a prefix shingle and pass the length, positional and suffix
   filters are candidates; each candidate pair is verified once, on whole texts.
4. Candidates are tried in two steps: first each node against the pivots of its
   shingles, then all pairs whose nodes are not yet connected. A pair inside one
   component cannot change the result, so no link between components is lost and
   a large group of near copies is not multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuegrid.functions.components import connected_components
from venuegrid.llm import words
from venuegrid.llm.scratch import Scratch
from venuegrid.llm.ship import ship

WIDTH, NUMERATOR, DENOMINATOR = 5, 4, 5
SKETCH = 1 << 18
MOST_BINS = 512
HOT = 10_000  # nodes of a shingle from which its rows are dealt out by a salt too
BLOOM_WORDS = 1 << 17


def shingles(found: words.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each text, codes): all shingles of a text one after the other; a short text is one shingle."""
    at, code = words.windows(found, width)
    size = np.diff(found.first)
    short = np.flatnonzero((size > 0) & (size < width))
    extra = np.zeros(len(short), np.uint64)
    for k, t in enumerate(short):
        part = found.code[found.first[t]:found.first[t + 1]]
        extra[k] = words.mix(np.array([int(sum(int(c) * (2 * i + 3) for i, c in enumerate(part)) + len(part)) & (2**64 - 1)], np.uint64))[0]
    count = np.maximum(size - width + 1, 0)
    count[short] = 1
    first = np.concatenate([[0], np.cumsum(count)])
    codes = np.empty(first[-1], np.uint64)
    is_short = np.zeros(len(size), bool)
    is_short[short] = True
    codes[np.repeat(~is_short, count)] = code
    codes[first[:-1][short]] = extra
    return first, codes


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(7)).astype(np.int64) & (SKETCH - 1)


def _count_slots(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, np.int64)
    for _, offsets, data in words.blocks(batches):
        counts += np.bincount(_slot(shingles(words.split_words(offsets, data), width)[1]), minlength=SKETCH)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["slot", "n"])


def frequencies(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles for each of the fixed number of slots: an upper bound of every shingle's frequency."""
    rows = docs.select("text").mapInArrow(partial(_count_slots, width=width), "slot int, n long")
    table = rows.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SKETCH rows
    counts = np.zeros(SKETCH, np.int64)
    counts[table["slot"].to_numpy()] = table["n"].to_numpy()
    return counts


def node_of(code_set: np.ndarray) -> int:
    """A 64-bit name of a set of codes."""
    mixed = words.mix(code_set ^ np.uint64(0x5851F42D4C957F2D))
    total = np.append(mixed, np.uint64(len(code_set) * 0x9E3779B97F4A7C15 & 2**64 - 1)).sum(dtype=np.uint64, keepdims=True)
    return int(words.mix(total).astype(np.int64)[0])


def parts_of(code_set: np.ndarray) -> bytes:
    """Sizes of the parts of a set by the low bits of its codes, 255 for 255 or more; larger sets have more parts."""
    bins = 64
    while bins < min(len(code_set), MOST_BINS):
        bins *= 2
    sizes = np.bincount((code_set & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return np.minimum(sizes, 255).astype(np.uint8).tobytes()


def most_shared(a: bytes, b: bytes) -> int:
    """No more than the smaller of each two parts can be shared."""
    x, y = (np.frombuffer(p, np.uint8).astype(np.int64) for p in (a, b))
    full = (x == 255).any() or (y == 255).any()
    while len(x) > len(y):
        x = x[:len(x) // 2] + x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] + y[len(y) // 2:]
    return 1 << 62 if full else int(np.minimum(x, y).sum())


def _sign(batches: Iterator[pa.RecordBatch], counts, width: int) -> Iterator[pa.RecordBatch]:
    frequency = counts.value
    for rows, offsets, data in words.blocks(batches):
        first, codes = shingles(words.split_words(offsets, data), width)
        size, node, prefix, parts = [], [], [], []
        for d in range(rows.num_rows):
            own = np.unique(codes[first[d]:first[d + 1]])
            size.append(len(own))
            node.append(node_of(own) if len(own) else None)
            order = np.argsort(frequency[_slot(own)], kind="stable")[:len(own) // DENOMINATOR + 1]
            prefix.append(own[order].tobytes())
            parts.append(parts_of(own))
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(prefix, pa.binary()), pa.array(parts, pa.binary())],
            names=["doc_id", "n", "node", "prefix", "parts"],
        )


def _deal(batches: Iterator[pa.RecordBatch], counts, hot: int) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of each prefix."""
    frequency = counts.value
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            part = batch.slice(at, 2_000)
            blobs = part.column("prefix").to_pylist()
            count = np.array([len(b) // 8 for b in blobs], np.int64)
            gram = np.frombuffer(b"".join(blobs), np.uint64)
            node = np.repeat(part.column("node").to_numpy(), count)
            place = np.arange(len(gram)) - np.repeat(np.cumsum(count) - count, count)
            heavy = frequency[_slot(gram)]
            ways = np.maximum(1, -(-heavy // hot))
            salt = np.where(heavy > hot, words.mix(node.astype(np.uint64)) % ways.astype(np.uint64), np.uint64(0)).astype(np.int64)
            salt[heavy <= hot] = -1
            yield pa.RecordBatch.from_arrays([
                pa.array(gram.astype(np.int64)), pa.array(salt.astype(np.int32)), pa.array(node),
                pa.array(np.repeat(part.column("n").to_numpy(), count).astype(np.int32)), pa.array(place.astype(np.int32)),
            ], names=["gram", "salt", "node", "n", "place"])


def _filters(a: str, b: str):
    """Length, prefix and positional filter of two rows of the same shingle.

    Sets that share ``need`` shingles also share one among the first size - need + 1
    of each, so for sets of these sizes a later place does not count.
    """
    n1, n2, p1, p2 = (F.col(c).cast("long") for c in (f"{a}.n", f"{b}.n", f"{a}.place", f"{b}.place"))
    length = DENOMINATOR * F.least(n1, n2) >= NUMERATOR * F.greatest(n1, n2)
    need = F.ceil(NUMERATOR * (n1 + n2) / F.lit(NUMERATOR + DENOMINATOR))
    most = F.least(p1, p2) + 1 + F.least(n1 - p1 - 1, n2 - p2 - 1)
    return length & (p1 <= n1 - need) & (p2 <= n2 - need) & (most >= need)


def _pivot_pairs(rows: DataFrame) -> DataFrame:
    """Each node beside the pivot of its shingle, the node with the fewest rarer shingles; pivots of the salted parts of a hot shingle meet in turn."""
    least = F.min(F.struct("place", "node", "n")).alias("pivot")
    local = rows.groupBy("gram", "salt").agg(least)
    near = rows.alias("a").join(local.select("gram", "salt", "pivot.*").alias("b"), ["gram", "salt"])
    heads = local.where("salt >= 0").select("gram", "pivot.*")
    top = heads.groupBy("gram").agg(least).select("gram", "pivot.*")
    far = heads.alias("a").join(top.alias("b"), "gram")
    pairs = [x.where(F.col("a.node") != F.col("b.node")).where(_filters("a", "b")).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")) for x in (near, far)]
    return pairs[0].unionByName(pairs[1])


def _open_pairs(scratch: Scratch, rows: DataFrame, names: DataFrame) -> DataFrame:
    """All pairs of a shingle whose nodes are in different components."""
    named = rows.join(names.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("gram")
    rest = scratch.settle(named.join(mixed, "gram", "left_semi"), "open")
    a, b = rest.alias("a"), rest.alias("b")
    ordered = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.node") < F.col("b.node")))
    met = a.join(b, (F.col("a.gram") == F.col("b.gram")) & ordered & (F.col("a.component") != F.col("b.component")) & _filters("a", "b"))
    return met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def _bloom(keys: DataFrame) -> np.ndarray:
    """A filter of fixed size (BLOOM_WORDS words of 64 bits) that holds all ``key`` values."""
    rows = keys.selectExpr(f"pmod(key, {BLOOM_WORDS * 64}) AS bit").selectExpr("int(bit div 64) AS w", "shiftleft(1L, int(bit % 64)) AS m")
    table = rows.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()  # at most BLOOM_WORDS rows
    bits = np.zeros(BLOOM_WORDS, np.int64)
    bits[table["w"].to_numpy()] = table["m"].to_numpy()
    return bits


def _wanted(batches: Iterator[pa.RecordBatch], bloom, width: int) -> Iterator[pa.RecordBatch]:
    """Texts whose document may be wanted, with their node."""
    bits = bloom.value
    for batch in batches:
        key = batch.column("key").to_numpy() % (BLOOM_WORDS * 64)
        keep = (bits[key >> 6] >> (key & 63)) & 1 == 1
        for rows, offsets, data in words.blocks(iter([batch.filter(pa.array(keep))])):
            first, codes = shingles(words.split_words(offsets, data), width)
            node = [node_of(np.unique(codes[first[d]:first[d + 1]])) for d in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(node, pa.int64()), rows.column("text")], names=["key", "node", "text"])


def _verify(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets are similar."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = []
            for column in ("text_a", "text_b"):
                own = []
                for rows, offsets, data in words.blocks(iter([part]), column):
                    first, codes = shingles(words.split_words(offsets, data), width)
                    own += [np.unique(codes[first[d]:first[d + 1]]) for d in range(rows.num_rows)]
                sets.append(own)
            keep = []
            for x, y in zip(*sets):
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(DENOMINATOR * shared >= NUMERATOR * (len(both) - shared))
            yield part.select(["a", "b"]).filter(pa.array(keep))


def _links(scratch: Scratch, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, tried: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, candidates): the pairs that were verified on whole texts, and those of them that are links; pairs ``tried`` before are left out."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    parts = nodes.select("node", "n", "parts")
    # suffix filter: sets whose parts by code differ much in size cannot share enough
    pairs = pairs.hint("merge").join(parts.toDF("a", "n_a", "parts_a"), "a").hint("merge").join(parts.toDF("b", "n_b", "parts_b"), "b")
    pairs = scratch.settle(pairs.mapInArrow(_suffix_filter, "a long, b long"), "candidates")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = scratch.settle(wanted.join(nodes, "node").select("node", F.xxhash64("rep").alias("key")), "wanted")
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(wanted))
    rows = docs.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(partial(_wanted, bloom=bloom, width=width), "key long, node long, text string")
    # The keys are compared after a join by node alone, so that one shuffle of the texts serves the join and the choice of one text a node.
    held = rows.join(wanted.select("node", F.col("key").alias("want")).hint("shuffle_hash"), "node").where(F.col("key").bitwiseXOR(F.col("want")) == 0)
    texts = scratch.settle(held.dropDuplicates(["node"]).select("node", "text"), "texts")
    sides = pairs.hint("merge").join(texts.toDF("a", "text_a"), "a").hint("merge").join(texts.toDF("b", "text_b"), "b")
    return scratch.settle(sides.mapInArrow(partial(_verify, width=width), "a long, b long"), "verified"), pairs


def _suffix_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = map(most_shared, batch.column("parts_a").to_pylist(), batch.column("parts_b").to_pylist())
        total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        keep = [(NUMERATOR + DENOMINATOR) * m >= NUMERATOR * t for m, t in zip(shared, total.tolist())]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def similar_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Words are runs of bytes other than white space, A-Z lower-cased; a document's
    set holds its distinct shingles of ``width`` words, or its whole sequence if it
    has fewer. Two documents link when the Jaccard similarity of their sets is 0.8
    or more; ``component_id`` is the smallest doc_id that links reach.

    A text without words has an empty set and links with nothing. A row without a
    doc_id links with nothing and has no component. Rows that share a doc_id are
    one document, and links of any of their texts hold for it. Other columns are
    not read. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        kind = docs.schema[doc_id].dataType.simpleString()
        rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
        out = scratch.keep(_components(scratch, rows, kind, width, hot), "components")
    return out.select(F.col("doc_id").alias(doc_id), "n_shingles", "component_id")


def _components(scratch: Scratch, docs: DataFrame, kind: str, width: int, hot: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    counts = frequencies(docs, width)
    shared = context.broadcast(counts)
    signed = docs.mapInArrow(partial(_sign, counts=shared, width=width), f"doc_id {kind}, n long, node long, prefix binary, parts binary")
    signed = scratch.settle(signed, "signatures")
    ids = signed.select("doc_id", "n", "node")
    known = signed.where("node is not null and doc_id is not null")
    nodes = scratch.settle(known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("parts").alias("parts")), "nodes")
    dealt = known.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")).mapInArrow(
        partial(_deal, counts=shared, hot=hot), "gram long, salt int, node long, n int, place int"
    )
    met = dealt.selectExpr("*", "count(*) over (partition by gram, salt) as m").where("m > 1 or salt >= 0").drop("m")
    postings = scratch.settle(met, "postings")

    repeated = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    same = known.join(repeated.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    linked, tried = _links(scratch, docs, nodes, _pivot_pairs(postings), width)
    first = scratch.settle(linked.unionByName(same), "links")
    names = connected_components(first)
    second, _ = _links(scratch, docs, nodes, _open_pairs(scratch, postings, names), width, tried)
    names = connected_components(first.unionByName(second))

    rep = nodes.select("node", "rep").join(names, "node").groupBy("component").agg(F.min("rep").alias("least"))
    groups = names.join(rep, "component").select("node", "least")
    named = nodes.select("node", "rep").join(groups, "node", "left").select("node", F.coalesce("least", "rep").alias("group"))
    named = scratch.settle(named, "named")  # a node of very many copies can then be split in the join
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id"))
    return ids.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each_group(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` whose document has the smallest id of its component; rows without words or doc_id stay."""
    groups = similar_groups(docs, doc_id=doc_id, text=text, **options).distinct()
    copies = groups.where(F.col("component_id") < F.col(doc_id)).select(F.col(doc_id).alias("__copy")).distinct()
    return docs.join(copies, docs[f"`{doc_id}`"] == F.col("__copy"), "left_anti")
