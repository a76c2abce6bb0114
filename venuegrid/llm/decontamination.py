"""Operator 10: documents that hold passages of test items, by suffix arrays of the training text.

Each block of a task's documents gets a suffix array over its words (a shard).
The suffixes of all test items are sorted too, and each distinct beginning of a window's
length is searched in the shard once, by bisection; the occurrences give the words that
are hit and the items they come from. Each occurrence is then looked up among the item
suffixes behind it, which gives the longest verbatim match. So neither equal items nor
a passage that many items share multiply the work.
The test items are a stated query set: they go to the tasks in blocks of bounded
size, and the documents pass through one scan per block without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuegrid.llm.rows import annotated, ragged
from venuegrid.llm.words import Words, split_words, text_buffers

WINDOW = 10
ITEM_BLOCK_BYTES = 16 << 20
_PAIRS = 1 << 20  # occurrences that are extended at a time

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.LongType()),
    T.StructField("longest_at", T.LongType()),
    T.StructField("longest_item", T.StringType()),
])


@dataclass
class Queries:
    """The distinct windows of all test items, and the item suffixes that begin with each.

    ``ranks`` holds the places in ``alphabet`` of all item words in order, each item
    closed by a mark beyond all words. The suffixes at which a window begins are
    listed in sorted order, so those of one window are neighbours.
    """

    ranks: np.ndarray
    alphabet: np.ndarray
    start: np.ndarray  # position in ``ranks`` of each sorted suffix
    item: np.ndarray  # its item
    shared: np.ndarray  # words it shares with the suffix before it
    first: np.ndarray  # first suffix of each window, and the end
    width: np.ndarray  # words of each window
    owners: np.ndarray  # number of the window's set of items in ``sets``
    sets: list[np.ndarray]
    names: list
    depth: int  # words of the longest item


def test_queries(ids: list, texts: list, window: int) -> Queries:
    """Windows of ``window`` words; an item of fewer words is one window."""
    words = split_words(*text_buffers(pa.array(texts, pa.string())), kind="letters")
    size = np.diff(words.first)
    depth = int(size.max(initial=1))
    items = suffix_array(words, max(depth, window) + 1)
    left = np.repeat(words.first[1:], size) - np.arange(len(words.code))
    length = np.repeat(size, size)
    begins = (left >= window) | ((length < window) & (left == length))
    place = items.order[items.ranks[items.order] < len(items.alphabet)]
    place = place[begins[items.word[place]]]
    word = items.word[place]
    item, width = words.text[word], np.minimum(left[word], window)
    shared = np.zeros(len(place), np.int64)
    shared[1:], _ = _compare(items.ranks, place[:-1], items.ranks, place[1:], shared[1:])
    new = np.ones(len(place), bool)
    new[1:] = (shared[1:] < width[1:]) | (width[1:] != width[:-1])
    first = np.append(np.flatnonzero(new), len(place))
    owners, sets = _owner_sets(item, first, np.array([i is not None for i in ids], bool))
    return Queries(items.ranks, items.alphabet, place, item, shared, first, width[first[:-1]], owners, sets, ids, depth)


def _owner_sets(item: np.ndarray, first: np.ndarray, named: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The named items of each window; windows with the same items share one set."""
    n = max(1, len(named))
    window = np.repeat(np.arange(len(first) - 1), np.diff(first))
    known = named[item] if len(item) else np.zeros(0, bool)
    pairs = np.unique(window[known] * n + item[known])
    ends = np.searchsorted(pairs, np.arange(len(first)) * n)
    owner, numbers = pairs % n, {}
    owners = [numbers.setdefault(owner[a:b].tobytes(), len(numbers)) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return np.array(owners, np.int64), [np.frombuffer(key, owner.dtype) for key in numbers]


def _compare(mine: np.ndarray, at: np.ndarray, theirs: np.ndarray, start: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words two suffixes share, ``known`` of them beforehand, and whether the second one is the smaller.

    Their marks differ, so no comparison runs past an end.
    """
    shared, open_ = known.copy(), np.arange(len(at))
    while len(open_):
        open_ = open_[mine[at[open_] + shared[open_]] == theirs[start[open_] + shared[open_]]]
        shared[open_] += 1
    return shared, theirs[start + shared] < mine[at + shared]


@dataclass
class Shard:
    """A suffix array: ``order`` lists the positions of ``ranks`` by the words that follow, to ``depth`` words at least."""

    order: np.ndarray
    ranks: np.ndarray
    alphabet: np.ndarray
    place: np.ndarray  # position in ``ranks`` of each word
    word: np.ndarray  # word at each position; text ends have the next word's number


def suffix_array(words: Words, depth: int) -> Shard:
    """Sort all suffixes by their first three words, then by tripling the known prefix where suffixes still tie.

    Every text ends with a mark of its own, so no match runs into the next text.
    """
    n, texts = len(words.code), len(words.first) - 1
    alphabet, inverse = np.unique(words.code, return_inverse=True)
    place = np.arange(n) + words.text
    ranks = np.zeros(n + texts, np.int64)
    ranks[place] = inverse
    marks = words.first[1:] + np.arange(texts)
    ranks[marks] = len(alphabet) + np.arange(texts)
    word = np.arange(n + texts) - np.searchsorted(marks, np.arange(n + texts), "left")
    size = n + texts
    group, slots, step = ranks, np.arange(size), 1
    order = np.arange(size)
    while True:
        at = order[slots]
        padded = np.concatenate([group + 1, np.zeros(2 * step, np.int64)])
        keys = [padded[at], padded[at + step], padded[at + 2 * step]]
        if size < 1 << 21:
            sort = np.argsort((keys[0] << 42) | (keys[1] << 21) | keys[2], kind="stable")
        else:
            sort = np.lexsort(keys[::-1])
        at = at[sort]
        order[slots] = at
        keys = [k[sort] for k in keys]
        new = np.ones(len(at), bool)
        new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])
        heads = np.flatnonzero(new)
        group = group.copy() if step > 1 else np.zeros(size, np.int64)
        group[at] = slots[heads][np.cumsum(new) - 1]
        step *= 3
        tied = np.repeat(np.diff(np.append(heads, len(at))) > 1, np.diff(np.append(heads, len(at))))
        slots = slots[tied]
        if step >= depth or not len(slots):
            return Shard(order, ranks, alphabet, place, word)


def _search(shard: Shard, query: np.ndarray, starts: np.ndarray, width: np.ndarray, above: bool) -> np.ndarray:
    """For each window the number of suffixes below it, or with ``above`` those below or beginning with it."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(shard.order), np.int64)
    last = len(shard.ranks) - 1
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        middle = (low[live] + high[live]) >> 1
        at = shard.order[middle]
        below = np.full(len(live), above)
        open_ = np.arange(len(live))
        for k in range(int(width.max())):
            open_ = open_[width[live[open_]] > k]
            mine, theirs = query[starts[live[open_]] + k], shard.ranks[np.minimum(at[open_] + k, last)]
            differs = mine != theirs
            below[open_[differs]] = (theirs < mine)[differs]
            open_ = open_[~differs]
            if not len(open_):
                break
        low[live[below]] = middle[below] + 1
        high[live[~below]] = middle[~below]


def _block_matches(words: Words, queries: Queries):
    """(shard, place of each occurrence, window of it) of a block."""
    shard = suffix_array(words, queries.depth)
    spot = np.searchsorted(shard.alphabet, queries.alphabet)
    known = shard.alphabet[np.minimum(spot, len(shard.alphabet) - 1)] == queries.alphabet
    query = np.append(np.where(known, spot, -1), -1)[np.minimum(queries.ranks, len(queries.alphabet))]
    missing = np.concatenate([[0], np.cumsum(query < 0)])
    start = queries.start[queries.first[:-1]]
    live = np.flatnonzero(missing[start + queries.width] == missing[start])
    if not len(live):
        return shard, live, live
    low = _search(shard, query, start[live], queries.width[live], above=False)
    count = _search(shard, query, start[live], queries.width[live], above=True) - low
    return shard, shard.order[ragged(low, count)], np.repeat(live, count)


def _annotate(offsets, data, queries: Queries) -> pa.StructArray:
    words = split_words(offsets, data, "letters")
    texts, n = len(offsets) - 1, len(words.code)
    shard, at, which = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n and len(queries.start):
        shard, at, which = _block_matches(words, queries)
    word = shard.word[at] if len(at) else at
    text = np.searchsorted(words.first, word, "right") - 1
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, word, 1)
    np.add.at(change, word + queries.width[which], -1)
    hit = np.cumsum(change)[:n] > 0
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    # spans may not join over two texts
    begin, end = list(np.flatnonzero(edge == 1)), list(np.flatnonzero(edge == -1))
    spans: list[list[int]] = [[] for _ in range(texts)]
    for b, e in zip(begin, end):
        while b < e:
            t = int(np.searchsorted(words.first, b, "right")) - 1
            stop = min(e, int(words.first[t + 1]))
            spans[t] += [int(b - words.first[t]), int(stop - words.first[t])]
            b = stop
    items: list[set[str]] = [set() for _ in range(texts)]
    longest = [(0, None, None)] * texts
    if len(at):
        for pair in np.unique(text * len(queries.sets) + queries.owners[which]).tolist():
            items[pair // len(queries.sets)].update(queries.names[i] for i in queries.sets[pair % len(queries.sets)])
        mine = _item_ranks(shard, queries)
        for cut in range(0, len(at), _PAIRS):
            _longest(words, shard, mine, queries, at[cut:cut + _PAIRS], which[cut:cut + _PAIRS], text[cut:cut + _PAIRS], longest)
    return pa.StructArray.from_arrays([
        pa.array(np.diff(words.first), pa.int64()),
        pa.array(spans, pa.list_(pa.int64())),
        pa.array([sorted(names) for names in items], pa.list_(pa.string())),
        pa.array([x[0] for x in longest], pa.int64()),
        pa.array([x[1] for x in longest], pa.int64()),
        pa.array([x[2] for x in longest], pa.string()),
    ], names=RESULT.names)


def _item_ranks(shard: Shard, queries: Queries) -> np.ndarray:
    """The words of a shard by twice their place among the items' words: unknown words lie between, text ends beyond all."""
    spot = np.searchsorted(queries.alphabet, shard.alphabet)
    known = queries.alphabet[np.minimum(spot, len(queries.alphabet) - 1)] == shard.alphabet
    place = np.append(np.where(known, 2 * spot, 2 * spot - 1), np.iinfo(np.int64).max)
    return place[np.minimum(shard.ranks, len(shard.alphabet))]


def _longest(words, shard, mine, queries: Queries, at, which, text, longest) -> None:
    """The longest match of each text; ties: the first place, then the first item.

    Each occurrence of a window is looked up by bisection among the sorted item
    suffixes that begin with it: one of its two neighbours there shares most words with it.
    """
    theirs = 2 * queries.ranks
    begin, end, width = queries.first[which], queries.first[which + 1], queries.width[which]
    low, high = begin.copy(), end.copy()
    live = np.flatnonzero(high - low > 1)
    while len(live):
        middle = (low[live] + high[live]) >> 1
        _, below = _compare(mine, at[live], theirs, queries.start[middle], width[live])
        low[live[below]] = middle[below] + 1
        high[live[~below]] = middle[~below]
        live = live[low[live] < high[live]]
    length, near = width.copy(), low.copy()
    for candidate in (low - 1, low):
        some = np.flatnonzero((candidate >= begin) & (candidate < end))
        shared, _ = _compare(mine, at[some], theirs, queries.start[candidate[some]], width[some])
        better = shared >= length[some]
        length[some[better]], near[some[better]] = shared[better], candidate[some[better]]
    best = np.lexsort((at, -length, text))
    _, first = np.unique(text[best], return_index=True)
    for k in best[first].tolist():
        t, size, place = int(text[k]), int(length[k]), int(shard.word[at[k]] - words.first[text[k]])
        if size > longest[t][0] or (size == longest[t][0] and place < longest[t][1]):
            # item suffixes that share as many words lie around the neighbour
            cuts = np.flatnonzero(queries.shared[begin[k] + 1:end[k]] < size) + begin[k] + 1
            after = np.searchsorted(cuts, near[k], "right")
            a, b = cuts[after - 1] if after else begin[k], cuts[after] if after < len(cuts) else end[k]
            longest[t] = (size, place, queries.names[queries.item[a:b].min()])


def _blocks_of(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> list[DataFrame]:
    """The test items in parts of about ``block_bytes``, dealt by a hash of their text."""
    rows = items.select(items[f"`{item_id}`"].cast("string").alias("id"), items[f"`{item_text}`"].cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text") + 64)).head()[0] or 0
    parts = -(-total // block_bytes)
    if parts <= 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64("text", "id"), F.lit(parts)) == k) for k in range(parts)]


def with_matches(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    into: str = "contamination", window: int = WINDOW, block_bytes: int = ITEM_BLOCK_BYTES,
) -> DataFrame:
    """Every row of ``docs`` with what it shares with the test items, in the struct ``into``.

    ``n_words``; ``spans``: first word and word after the last of each run of hit
    words, one after the other; ``items``: ids of items with a window in the text,
    sorted as strings; ``longest``, ``longest_at``, ``longest_item``: the longest
    verbatim match (0 words without one). A missing or empty text has no words and
    no matches; items without text have no windows; an item without an id hits
    words but is not named; items that share an id are one; equal rows get equal
    results; a column named ``into`` is replaced. Empty tables give no matches.
    """
    for k, part in enumerate(_blocks_of(items, item_id, item_text, block_bytes)):
        rows = part.distinct().orderBy("id", "text").collect()  # at most about block_bytes
        queries = test_queries([r.id for r in rows], [r.text for r in rows], window)
        shared = docs.sparkSession.sparkContext.broadcast(queries)
        name = into if k == 0 else f"{into}_{k}"
        while k and name.lower() in {c.lower() for c in docs.columns}:
            name += "_"
        docs = annotated(docs, text, name, RESULT, partial(_start, shared))
        if k:
            docs = docs.withColumn(into, _merged(into, name)).drop(name)
    return docs


def _start(shared):
    queries = shared.value
    return lambda offsets, data: _annotate(offsets, data, queries)


def _merged(one: str, two: str):
    a, b = F.col(one), F.col(two)
    better = (b["longest"] > a["longest"]) | ((b["longest"] == a["longest"]) & (b["longest_at"] < a["longest_at"]))
    return F.struct(
        a["n_words"].alias("n_words"),
        F.concat(a["spans"], b["spans"]).alias("spans"),
        F.array_sort(F.array_union(a["items"], b["items"])).alias("items"),
        *[F.when(better, b[c]).otherwise(a[c]).alias(c) for c in ("longest", "longest_at", "longest_item")],
    )


def hit_words(into: str = "contamination"):
    """Number of words inside any match; the spans of several item blocks may overlap."""
    spans = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(f"{into}.spans") / 2 - 1).cast("int")),
        lambda k: F.struct(F.get(f"{into}.spans", 2 * k).alias("b"), F.get(f"{into}.spans", 2 * k + 1).alias("e")),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    total = F.aggregate(F.array_sort(spans), start, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), s["e"] - F.greatest(s["b"], acc["to"]))).alias("n"),
        F.greatest(acc["to"], s["e"]).alias("to"),
    ), lambda acc: acc["n"])
    return F.when(F.size(f"{into}.spans") > 0, total).otherwise(F.lit(0).cast("long"))


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that share no window with a test item, unchanged."""
    into = "__contamination"
    return with_matches(docs, items, into=into, **options).where(F.size(f"{into}.spans") == 0).drop(into)
