"""Operator 5: byte-level BPE by prefix dynamic programming, encoding and decoding of whole texts.

The encoding of any byte prefix ends with exactly one token that may follow the
encoding of what is before it. ``PrefixTable`` stores that token for each prefix, so
bytes can be appended, and after an edit only the prefixes near it are done again.
Texts are split by the rank files' usual pattern on arrays of code points; each
distinct piece of a run is encoded once, and a task keeps recent pieces up to a
number of bytes and empties them when it ends.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from venuegrid.llm.rows import annotated, ragged
from venuegrid.llm.words import _codes, mix, power, runs

#: Unicode's white space, and the endings that the pattern splits off after an apostrophe.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

BLOCK_BYTES = 1 << 20
PIECE_BYTES_KEPT, PAIRS_KEPT = 40 << 20, 500_000  # until the task ends; bytes as estimated by ``_held``
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)

RESULT = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


class Encoder:
    """A vocabulary of byte strings by rank."""

    def __init__(self, rank_file: bytes):
        pairs = [line.split() for line in rank_file.splitlines() if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.longest = max(map(len, self.rank))
        self.length = np.array([len(token) for token in self.token], np.int64)
        self.place = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        # tokens that merging gives for their own bytes; others never occur inside a longer piece
        self.parts: dict[int, tuple[int, int]] = {}
        whole = {token: rank for token, rank in self.rank.items() if self._is_whole(token, rank)}
        self.whole = self.rank if len(whole) == len(self.rank) else whole
        self.ordered = all(max(parts) < rank for rank, parts in self.parts.items())
        self.reach: dict[bytes, int] = {}  # the longest token by its last three bytes
        for token in self.whole:
            if len(token) > self.reach.get(token[-3:], 2):
                self.reach[token[-3:]] = len(token)
        self.forget()

    def _is_whole(self, token: bytes, rank: int) -> bool:
        if len(token) == 1:
            return True
        parts = self.merged(token, 2)
        if len(parts) == 2:
            self.parts[rank] = parts[0], parts[1]
        return len(parts) == 2

    def forget(self) -> None:
        """Empty what is kept between pieces."""
        self._follows: dict[int, bool] = {}
        self._pieces: dict[bytes, tuple[int, ...]] = {}
        self._older: dict[bytes, tuple[int, ...]] = {}
        self._held = 0

    def merged(self, piece: bytes, least: int = 1) -> list[int]:
        """Tokens by merging the lowest-ranked neighbours, the definition, down to ``least`` tokens; for short strings."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > least:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives the two tokens."""
        if len(self._follows) >= PAIRS_KEPT:
            self._follows.clear()
        apart = self._apart if self.ordered else self._apart_by_merging
        found = self._follows[left << 32 | right] = apart(left, right)
        return found

    def _apart_by_merging(self, left: int, right: int) -> bool:
        return self.merged(self.token[left] + self.token[right]) == [left, right]

    def _edge(self, token: int, side: int) -> list[int]:
        """The tokens that merging makes one after the other at one end of a token, the last byte or first byte first."""
        out = [token]
        while token in self.parts:
            token = self.parts[token][side]
            out.append(token)
        return out[::-1]

    def _apart(self, left: int, right: int) -> bool:
        """``may_follow`` by the merges that touch the seam only; parts need lower ranks than their token.

        The two tokens at the seam grow in the order of ranks, as they do alone. They
        stay apart if no pair of them that meets has a lower rank than the next merge
        on either side; of equal ranks the one further left comes first.
        """
        token, rank = self.token, self.rank
        before, after = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            grown_left = before[i + 1] if i + 1 < len(before) else 1 << 40
            grown_right = after[j + 1] if j + 1 < len(after) else 1 << 40
            joined = rank.get(token[before[i]] + token[after[j]])
            if joined is not None and joined < grown_left and joined <= grown_right:
                return False
            if i + 1 == len(before) and j + 1 == len(after):
                return True
            if grown_left <= grown_right:
                i += 1
            else:
                j += 1

    def last_tokens(self, data: bytes, last: list[int]) -> None:
        """Extend ``last``, the last token of each prefix, to all prefixes of ``data``."""
        whole, follows, reach = self.whole, self._follows, self.reach
        for end in range(len(last), len(data) + 1):
            for start in range(max(0, end - reach.get(data[max(0, end - 3):end], 2)), end):
                token = whole.get(data[start:end])
                if token is not None:
                    if not start:
                        break
                    fits = follows.get(last[start] << 32 | token)
                    if self.may_follow(last[start], token) if fits is None else fits:
                        break
            else:
                raise ValueError(f"byte {data[end - 1]} has no token")
            last.append(token)

    def walk(self, last: list[int]) -> list[int]:
        """The tokens from the end back to the start."""
        out, end = [], len(last) - 1
        while end:
            out.append(last[end])
            end -= len(self.token[last[end]])
        return out[::-1]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of one match of the pattern; the pieces of late are kept in two generations."""
        found = self._pieces.get(piece)
        if found is None:
            found = self._older.get(piece)
            if found is None:
                token = self.rank.get(piece)
                if token is None:
                    last = [-1]
                    self.last_tokens(piece, last)
                    found = tuple(self.walk(last))
                else:
                    found = (token,)
            if self._held >= PIECE_BYTES_KEPT:
                self._older, self._pieces, self._held = self._pieces, {}, 0
            self._pieces[piece] = found
            self._held += 200 + len(piece) + 40 * len(found)
        return found

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.place[ids], self.length[ids])]


class PrefixTable:
    """The last token of every prefix of a byte string."""

    def __init__(self, encoder: Encoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.last_tokens(self.data, self.last)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes [start, stop); returns the number of prefixes that were done again.

        A prefix's token depends on the last ``longest`` prefixes and bytes only, so
        work ends when that many tokens in a row are as before.
        """
        old, tail = self.last, self.data[stop:]
        self.data = self.data[:start] + new + tail
        self.last = old[:start + 1]
        shift, equal, done = len(new) - (stop - start), 0, 0
        for end in range(start + 1, len(self.data) + 1):
            self.encoder.last_tokens(self.data[:end], self.last)
            token = self.last[end]
            done += 1
            before = end - shift
            equal = equal + 1 if end > start + len(new) and before > stop and old[before] == token else 0
            if equal > self.encoder.longest:
                self.last += old[before + 1:]
                break
        return done

    def tokens(self) -> list[int]:
        return self.encoder.walk(self.last)


@cache
def _kinds() -> np.ndarray:
    import regex

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for found in regex.finditer(pattern, everything):
            kinds[[ord(c) for c in found[0]]] = kind
    kinds[list(WHITE)] = _SPACE
    return kinds


def pieces(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte at which each piece begins, first piece of each text): the matches of the pattern.

    A run of letters, of digits or of other signs is a piece and takes one blank
    before it along. White space ends one sign early where something follows. An
    apostrophe that begins a piece takes one of the endings out of the letters after it.
    """
    point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(point)
    width = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
    byte = np.concatenate([[0], np.cumsum(width)])
    kind = _kinds()[point]
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(byte, offsets)] = True
    edge[n] = True
    begins = edge[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    last_white = (kind == _SPACE) & ~edge[1:]
    last_white[:-1] &= kind[1:] != _SPACE
    if n:
        last_white[-1] = False
    begins |= last_white
    blank = np.flatnonzero(last_white & (point == 0x20))
    begins[blank + 1] = False
    for at in np.flatnonzero(begins & (point == 0x27)):
        stop = at + 3
        ahead = "".join(map(chr, point[at + 1:stop]))
        ends = np.flatnonzero(edge[at + 1:stop + 1])
        ahead = ahead[:ends[0]] if len(ends) else ahead
        ending = next((e for e in ENDINGS if ahead.startswith(e)), None)
        if ending:
            begins[at + 1] = False
            if at + 1 + len(ending) < n:
                begins[at + 1 + len(ending)] = True
    starts = byte[:-1][begins]
    return starts, np.searchsorted(starts, offsets)


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places before a blank or line break that follows a visible ASCII sign; no match of the pattern reaches over them."""
    white, seen = (data[1:] == 0x20) | (data[1:] == 0x0A), (data[:-1] > 0x20) & (data[:-1] < 0x7F)
    return np.flatnonzero(white & seen) + 1


def encode_block(encoder: Encoder, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, first id of each text); long texts are done run by run."""
    out, first, done = [], np.zeros(len(offsets), np.int64), 0
    for at, to in runs(offsets, data, _cuts):
        low, high = np.searchsorted(offsets, at), np.searchsorted(offsets, to, "right")
        ids, places = _encode_run(encoder, offsets[low:high] - at, data[at:to])
        first[low:high] = done + places
        out.append(ids)
        done += len(ids)
    return np.concatenate(out) if out else np.zeros(0, np.int32), first


def _encode_run(encoder: Encoder, edges: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids before each edge)."""
    starts, first = pieces(edges, data)
    ends = np.append(starts[1:], len(data))
    code = np.add.reduceat(_codes(False)[data] * power("up", len(data)), starts) * power("down", len(data))[starts]
    _, example, which = np.unique(mix(code + (ends - starts).astype(np.uint64)), return_index=True, return_inverse=True)
    raw, ids, count = data.tobytes(), [], []
    for a, b in zip(starts[example].tolist(), ends[example].tolist()):
        tokens = encoder.encode(raw[a:b])
        ids += tokens
        count.append(len(tokens))
    count = np.array(count, np.int64)
    place = np.cumsum(count) - count
    of_piece = count[which]
    return np.array(ids, np.int32)[ragged(place[which], of_piece)], np.concatenate([[0], np.cumsum(of_piece)])[first]


@cache
def _encoder(rank_file: bytes) -> Encoder:
    return Encoder(rank_file)


def _start(shared, digests: bool):
    encoder = _encoder(shared.value)

    def annotate(offsets, data):
        ids, first = encode_block(encoder, offsets, data)
        columns = [pa.array(np.diff(first), pa.int64())]
        if digests:
            plain, ends = encoder.decode(ids), np.concatenate([[0], np.cumsum(encoder.length[ids])])[first]
            little, spans = ids.astype("<u4"), range(len(offsets) - 1)
            columns.append(pa.array([hashlib.sha256(little[first[d]:first[d + 1]]).hexdigest() for d in spans]))
            columns.append(pa.array([hashlib.sha256(plain[ends[d]:ends[d + 1]]).hexdigest() for d in spans]))
        return pa.StructArray.from_arrays(columns, names=RESULT.names[:len(columns)])

    annotate.close = encoder.forget
    return annotate


def _start_ids(shared):
    encoder = _encoder(shared.value)

    def annotate(offsets, data):
        ids, first = encode_block(encoder, offsets, data)
        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.StructArray.from_arrays([lists], names=["ids"])

    annotate.close = encoder.forget
    return annotate


def _rank_bytes(path: str) -> bytes:
    with open(path, "rb") as file:  # the driver's file; its bytes go to the tasks
        return file.read()


def with_digests(docs: DataFrame, rank_path: str, *, text: str = "text", into: str = "bpe", digests: bool = True) -> DataFrame:
    """Every row with the struct ``into``: number of tokens, and SHA-256 of the ids (little-endian, 32 bits) and of the decoded bytes.

    A missing text is empty and has no tokens. Texts may be of any length; equal
    rows get equal results; a column named ``into`` is replaced; no special tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_rank_bytes(rank_path))  # the size of one vocabulary file
    kind = T.StructType(RESULT.fields if digests else RESULT.fields[:1])
    return annotated(docs, text, into, kind, partial(_start, shared, digests), BLOCK_BYTES)


def with_ids(docs: DataFrame, rank_path: str, *, text: str = "text", into: str = "bpe") -> DataFrame:
    """Every row with the struct ``into`` of the token ids; cases as in ``with_digests``."""
    shared = docs.sparkSession.sparkContext.broadcast(_rank_bytes(rank_path))
    return annotated(docs, text, into, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))]), partial(_start_ids, shared), BLOCK_BYTES)
