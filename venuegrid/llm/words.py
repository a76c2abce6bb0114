"""Words of whole Arrow batches as numpy arrays, without a Python object per word.

A batch is cut into blocks of whole texts of some megabytes, so the memory of a
task does not depend on the size of a batch. A text longer than a block is a
block of its own, and its codes are worked out run by run. Missing texts have no
words. What a worker keeps from one task to the next is a few megabytes of tables.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20
RUN_BYTES = 1 << 20  # codes are worked out for runs of about this size at a time
#: Seeds of the random byte codes and of the multipliers.
_SEED, _BASE = 20_240_607, np.uint64(0x9E3779B97F4A7C15)

SPACES = (0x20, *range(0x09, 0x0E))


@cache
def word_bytes(kind: str) -> np.ndarray:
    """Which bytes belong to words. ``spaced``: all but white space; ``letters``: a-z, A-Z, 0-9 and all beyond ASCII."""
    table = np.ones(256, bool)
    if kind == "spaced":
        table[list(SPACES)] = False
    else:
        table[:128] = [chr(b).isalnum() for b in range(128)]
    return table


@cache
def lowered_bytes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@cache
def _codes(lowered: bool) -> np.ndarray:
    codes = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return codes[lowered_bytes()] if lowered else codes


@cache
def _powers(which: str) -> np.ndarray:
    return _fresh_powers(which, RUN_BYTES + 1)


def _fresh_powers(which: str, n: int) -> np.ndarray:
    steps = np.full(n, _BASE if which == "up" else np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def power(which: str, n: int) -> np.ndarray:
    """The first powers of the base (``up``) or of its inverse (``down``); only those of a run are kept, a longer table is let go."""
    return _powers(which)[:n] if n <= RUN_BYTES + 1 else _fresh_powers(which, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit codes over all bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a missing text is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0]:offsets[-1]]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, offsets, bytes) for runs of whole texts of about ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, data = text_buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), offsets[at:to + 1] - offsets[at], data[offsets[at]:offsets[to]]
            at = to


def let_go() -> None:
    """Give memory that a task no longer uses back to the system; workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


@dataclass
class Words:
    """Words of a block in order: byte span, text they stand in, 64-bit code; ``first[d]:first[d + 1]`` are those of text d."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    code: np.ndarray

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs(offsets: np.ndarray, data: np.ndarray, may_cut: Callable[[np.ndarray], np.ndarray], size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of whole texts of about ``size`` bytes; a longer text is cut at places that ``may_cut`` finds.

    ``may_cut`` gives the places inside some bytes at which a text may be parted,
    rising. A stretch without any such place stays whole.
    """
    at, n = 0, len(data)
    while at < n:
        to = int(offsets[np.searchsorted(offsets, at + size, "right") - 1])
        if to <= at:
            end, reach = int(offsets[np.searchsorted(offsets, at, "right")]), size
            to = end
            while at + reach < end:
                places = may_cut(data[at:at + reach])
                if len(places):
                    to = at + int(places[-1])
                    break
                reach *= 2
        yield at, to
        at = to


def split_words(offsets: np.ndarray, data: np.ndarray, kind: str = "spaced", lowered: bool = True) -> Words:
    """Words as runs of word bytes inside one text; a code is a polynomial of random byte codes, mixed."""
    inside = word_bytes(kind)
    parts = []
    for at, to in runs(offsets, data, lambda some: np.flatnonzero(~inside[some[1:]]) + 1):
        edges = offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, to)] - at
        start, end, code = _split_run(edges, data[at:to], kind, lowered)
        parts.append((start + at, end + at, code))
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    start, end, code = (np.concatenate(p) for p in zip(*parts))
    return Words(start, end, np.searchsorted(start, offsets), code)


def _split_run(edges: np.ndarray, data: np.ndarray, kind: str, lowered: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, code) of the words of a run in which texts begin at ``edges``."""
    n = len(data)
    inside = word_bytes(kind)[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges] = inside[edges]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    inner = edges[edges > 0] - 1
    closes[inner] = inside[inner]
    start, end = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    code = np.zeros(0, np.uint64)
    if len(start):
        terms = _codes(lowered)[data] * power("up", n)
        terms[~inside] = 0
        code = mix(np.add.reduceat(terms, start) * power("down", n)[start] + (end - start).astype(np.uint64))
    return start, end, code


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, code) of every run of ``width`` words inside one text."""
    n = len(words.code)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = words.text
    at = np.flatnonzero(text[:n - width + 1] == text[width - 1:])
    rates = np.random.default_rng(_SEED + width).integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    code = np.zeros(len(at), np.uint64)
    for k in range(width):
        code += words.code[at + k] * rates[k]
    return at, mix(code)
