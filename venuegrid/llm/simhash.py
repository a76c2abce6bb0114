"""Operator 12: near copies by SimHash fingerprints and anchors of a covering code.

1. A text's fingerprint takes the majority of each bit over the XXH64 codes of its
   shingles. Documents with equal fingerprints are one node.
2. The anchors are pairs of words of the perfect binary Golay code of length 23, which
   covers its space with radius 3. Each of them answers for 23 bits of a fingerprint; the other
   18 bits are left to the comparison.
3. Of two fingerprints that differ in at most ``THRESHOLD`` bits, the smaller has one
   nearest anchor, its home, within radius 3 on each half; the other is within 3 and
   its share of the threshold on each half. So every fingerprint is copied to
   all anchors within radius and threshold, about 60 of 2**24, and each home is compared
   with the copies at its anchor. A pair is found once, at the home of its smaller side.
4. Links between nodes are followed to connected components.

No fingerprint has more than 2,080 others within two bits, so links grow with the
number of fingerprints; a group of copies is one node, or a few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuegrid.functions.components import connected_components
from venuegrid.llm import words
from venuegrid.llm.rows import ragged
from venuegrid.llm.scratch import Scratch
from venuegrid.llm.ship import ship

WIDTH, SEED, THRESHOLD = 3, 42, 2
#: Length, check bits, covering radius and generator polynomial of the code.
LENGTH, CHECKS, RADIUS, GENERATOR = 23, 11, 3, 0b101011100011
_CHUNK = 1 << 16  # shingles whose bits are counted at a time


def fingerprints(offsets: np.ndarray, data: np.ndarray, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprint of each text: a bit is set where more than half of the shingle codes have it."""
    found = words.split_words(offsets, data)
    size = np.diff(found.first)
    of_text = np.where(size >= width, size - width + 1, (size > 0).astype(np.int64))
    first = ragged(found.first[:-1], of_text)  # first word of each shingle
    last = np.minimum(first + width, np.repeat(found.first[1:], of_text)) - 1
    text = np.repeat(np.arange(len(size)), of_text)
    counts = np.zeros((len(size), 64), np.int64)
    for at in range(0, len(first), _CHUNK):
        part = slice(at, at + _CHUNK)
        low, high = first[part][0], last[part][-1] + 1
        plain, begin, end = _spaced(found.start[low:high], found.end[low:high], data)
        spans = zip(begin[first[part] - low].tolist(), end[last[part] - low].tolist())
        codes = np.array([xxhash.xxh64_intdigest(plain[a:b], seed) for a, b in spans], "<u8")
        bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own, start = np.unique(text[part], return_index=True)
        counts[own] += np.add.reduceat(bits, start, axis=0, dtype=np.int64)
    majority = (2 * counts > of_text[:, None]).astype(np.uint8)
    return np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()


def _spaced(start: np.ndarray, end: np.ndarray, data: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Some words, A-Z lower-cased, with one blank after each, and where each begins and ends."""
    size = end - start
    plain = words.lowered_bytes()[data[ragged(start, np.minimum(size + 1, len(data) - start))]]
    begin = np.cumsum(size + 1) - (size + 1)
    stop = begin + size
    plain[stop[stop < len(plain)]] = 0x20
    return plain.tobytes(), begin, stop


@cache
def _syndromes() -> list[np.ndarray]:
    """Remainder by the generator of each value of each byte of a word of the code's length."""
    single = []
    for place in range(LENGTH):
        rest = 1 << place
        for high in range(place, CHECKS - 1, -1):
            if rest >> high & 1:
                rest ^= GENERATOR << (high - CHECKS)
        single.append(rest)
    tables = []
    for byte in range(0, LENGTH, 8):
        table = np.zeros(256, np.int64)
        for bit, rest in enumerate(single[byte:byte + 8]):
            table[(np.arange(256) >> bit & 1) == 1] ^= rest
        tables.append(table)
    return tables


def syndrome(half: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce([table[half >> 8 * k & 255] for k, table in enumerate(_syndromes())])


@cache
def _moves(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(moves, first, count): for each syndrome and each excess over the radius, the differences that lead to an anchor.

    ``moves[first[s, t]:][:count[s, t]]`` are those with ``t`` more bits than the
    radius; with t = 0 all of up to the radius, of which a perfect code has one.
    """
    weight, move = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for w in range(1, RADIUS + threshold + 1):
        top = np.where(move[-1] > 0, np.floor(np.log2(np.maximum(move[-1], 1))).astype(np.int64) + 1, 0)
        place = ragged(top, LENGTH - top)
        move.append(np.repeat(move[-1], LENGTH - top) | np.int64(1) << place)
        weight.append(np.full(len(move[-1]), w))
    move, weight = np.concatenate(move), np.concatenate(weight)
    key = syndrome(move) * (threshold + 1) + np.maximum(weight - RADIUS, 0)
    order = np.argsort(key, kind="stable")
    count = np.bincount(key, minlength=(threshold + 1) << CHECKS)
    first = np.cumsum(count) - count
    return move[order], first.reshape(-1, threshold + 1), count.reshape(-1, threshold + 1)


def anchors(prints: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(place, anchor): the anchors of each fingerprint within radius and threshold; with threshold 0 the nearest one alone."""
    moves, first, count = _moves(threshold)
    low = (prints & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
    high = (prints >> np.uint64(LENGTH) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
    s_low, s_high = syndrome(low), syndrome(high)
    found = []
    for a in range(threshold + 1):
        for b in range(threshold + 1 - a):
            n_low, n_high = count[s_low, a], count[s_high, b]
            place = np.repeat(np.arange(len(prints)), n_low * n_high)
            turn = ragged(np.zeros(len(prints), np.int64), n_low * n_high)
            left = low[place] ^ moves[first[s_low, a][place] + turn // np.maximum(n_high[place], 1)]
            right = high[place] ^ moves[first[s_high, b][place] + turn % np.maximum(n_high[place], 1)]
            found.append((place, left | right << LENGTH))
    return tuple(np.concatenate(x) for x in zip(*found))


def _sign(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    for rows, offsets, data in words.blocks(batches, size=words.RUN_BYTES):
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(fingerprints(offsets, data, width, seed).view(np.int64))], names=["doc_id", "print"]
        )
    words.let_go()


def _deal(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            prints = batch.column("print").slice(at, 2_000).to_numpy()
            place, anchor = anchors(prints.view(np.uint64), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(prints[place])], names=["anchor", "a" if not threshold else "b"])


def links(prints: DataFrame, *, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b), a < b: each two distinct ``print`` values that differ in at most ``threshold`` bits, once."""
    ship(prints.sparkSession)
    once = prints.select("print").distinct()
    homes = once.mapInArrow(partial(_deal, threshold=0), "anchor long, a long")
    copies = once.mapInArrow(partial(_deal, threshold=threshold), "anchor long, b long")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return homes.join(copies, "anchor").where(near).select("a", "b")


def near_copies(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED, threshold: int = THRESHOLD,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Words are runs of bytes other than white space, A-Z lower-cased; shingles are
    ``width`` words joined by blanks, repeats included, or the whole sequence if there
    are fewer. ``fingerprint`` has 16 hexadecimal digits, all zero for a text without
    words or a missing one; zero links like any other. Two documents link when their
    fingerprints differ in at most ``threshold`` bits; ``component_id`` is the smallest
    doc_id that links reach, itself included.

    A row without a doc_id has a fingerprint, links with nothing and has no component.
    Rows that share a doc_id are one document, and links of any of their texts hold
    for it. Texts may be of any length. Other columns are not read. An empty table
    gives an empty result.
    """
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        signed = scratch.settle(rows.mapInArrow(partial(_sign, width=width, seed=seed), f"doc_id {kind}, print long"), "prints")
        known = signed.where("doc_id is not null")
        nodes = scratch.settle(known.groupBy("print").agg(F.min("doc_id").alias("rep")), "nodes")
        repeated = known.groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("z")).where("a < z")
        same = known.join(repeated.select("doc_id", "a"), "doc_id").select("a", F.col("print").alias("b")).where("a <> b")
        names = connected_components(scratch.settle(links(nodes, threshold=threshold).unionByName(same), "links"))
        least = nodes.join(names, F.col("print") == F.col("node")).groupBy("component").agg(F.min("rep").alias("least"))
        groups = names.join(least, "component").select(F.col("node").alias("print"), "least")
        named = nodes.join(groups, "print", "left").select("print", F.coalesce("least", "rep").alias("group"))
        named = scratch.settle(named, "named")  # the fingerprint of very many copies can then be split in the join
        component = F.when(F.col("doc_id").isNotNull(), F.col("group"))
        out = signed.join(named, "print", "left").select(
            "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), component.alias("component_id"),
        )
        out = scratch.keep(out, "components")
    return out.select(F.col("doc_id").alias(doc_id), "fingerprint", "component_id")
