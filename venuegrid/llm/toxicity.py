"""Operator 4: toxicity of texts after noisy-channel deobfuscation.

Words written with digits or signs for letters, with letters spaced out or with
letters repeated are read as lattices: each sign may stand for some letters, each
separator may be nothing, each repeat may be dropped. Viterbi decoding under a
character trigram model, trained on all documents, picks the reading. A word without
such a symbol has one path and stays; for the others it costs little to keep pairs of
letters, numbers, and punctuation at the ends. The restored text, in which readings stand for what was written,
is scored by a logistic model on words and word beginnings, fitted on a bounded sample of labelled documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuegrid.llm import words
from venuegrid.llm.rows import annotated
from venuegrid.llm.ship import ship

FOLDS, TEST_FOLD, THRESHOLD = 3, 1, 0.7
SAMPLE_ROWS = {1: 4_000, 0: 8_000}  # labelled documents of each class that the model is fitted on, at most
FEATURES, MIN_TOXIC, MIN_LIFT, MIN_EVIDENCE = 4_000, 4, 4.0, 20.0
BEGINNINGS = (3, 4, 5, 6, 7, 8)  # bytes

#: Letters that signs stand for, and signs that may stand for nothing.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou",
}
SEPARATORS = " .-_*"
PUNCTUATION = "!(|+*"  # signs that plain words have at their ends
_ENDS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum() and (chr(b) in PUNCTUATION or chr(b) not in SIGNS))
_SIGN_COST, _DROP_COST, _REPEAT_COST = math.log(0.9), math.log(0.6), math.log(0.5)
_KEEP_SIGN, _KEEP_SEPARATOR = math.log(1e-4), math.log(0.4)
_KEEP_PAIR, _DROP_PAIR = math.log(0.999), math.log(0.001)
_SYMBOLS = 28  # a to z, letters beyond ASCII, all else

RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("restored", T.ArrayType(T.StringType()))])


def _symbols() -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[97:123] = table[65:91] = np.arange(1, 27)
    table[128:] = 27
    return table


_SYMBOL = _symbols()


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_SYMBOLS**3, np.int64)
    for _, _, data in words.blocks(batches):
        for at in range(0, len(data) - 2, words.RUN_BYTES):
            s = _SYMBOL[data[at:at + words.RUN_BYTES + 2]]
            counts += np.bincount((s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:], minlength=_SYMBOLS**3)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["code", "n"])


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(c | a, b) over the fixed symbols, from all texts; trigrams mixed with bigrams and a uniform share."""
    rows = docs.select(docs[f"`{text}`"].cast("string").alias("text")).mapInArrow(_count_trigrams, "code long, n long")
    table = rows.groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most _SYMBOLS ** 3 rows
    three = np.zeros(_SYMBOLS**3)
    three[table["code"].to_numpy()] = table["n"].to_numpy()
    three = three.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
    two = three.sum(axis=0)
    p2 = (two + 0.1) / (two.sum(axis=1, keepdims=True) + 0.1 * _SYMBOLS)
    return np.log((three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5))


class Reader:
    """Viterbi decoding of written forms."""

    def __init__(self, model: np.ndarray):
        self.model, self._kept = model.ravel().tolist(), {}

    @staticmethod
    def lattice(form: str) -> list[list[tuple[str, float]]]:
        """For each sign its readings with their log probabilities; an empty reading drops it."""
        out, before = [], ""
        number = not any(sign.isalpha() for sign in form)
        first, last = len(form) - len(form.lstrip(_ENDS)), len(form.rstrip(_ENDS))
        for k, sign in enumerate(form):
            if sign.isalpha():
                again = sign == before
                third = again and k > 1 and form[k - 2] == sign
                keep, drop = (_REPEAT_COST, _REPEAT_COST) if form[k + 1:k + 2] == sign else (_KEEP_PAIR, _DROP_PAIR)
                out.append([("", 0.0)] if third else [(sign, keep), ("", drop)] if again else [(sign, 0.0)])
            else:
                edge = not first <= k < last
                letters = SIGNS.get(sign, "")
                readings = [(letter, _SIGN_COST - math.log(len(letters))) for letter in letters]
                if sign in SEPARATORS and not edge:
                    readings.append(("", _DROP_COST))
                kept = 0.0 if number or not readings else _KEEP_SIGN if letters and not edge else _KEEP_SEPARATOR
                out.append([*readings, (sign, kept)])
            before = sign
        return out

    def read(self, form: str) -> str:
        """The likeliest reading; ties go to the reading listed first. Numbers are read as letters as a whole or not at all."""
        found = self._kept.get(form)
        if found is None:
            if len(self._kept) >= 50_000:
                self._kept.clear()
            reading = self._decode(form)
            lettered = reading.isalpha() or any(sign.isalpha() for sign in form)
            found = self._kept[form] = reading if lettered else form
        return found

    def _decode(self, form: str) -> str:
        model = self.model
        paths = {(0, 0): (0.0, None)}
        for readings in self.lattice(form):
            if len(paths) == len(readings) == 1 and readings[0][0]:  # no choice, so no cost to compare
                ((_, b), (cost, path)), letter = *paths.items(), readings[0][0]
                s = ord(letter) - 96 if "a" <= letter <= "z" else 27 if letter.isalpha() else 0
                paths = {(b, s): (cost, (letter, path))}
                continue
            new: dict = {}
            for (a, b), (cost, path) in paths.items():
                for letter, channel in readings:
                    if letter:
                        s = ord(letter) - 96 if "a" <= letter <= "z" else 27 if letter.isalpha() else 0
                        state, total, way = (b, s), cost + channel + model[(a * _SYMBOLS + b) * _SYMBOLS + s], (letter, path)
                    else:
                        state, total, way = (a, b), cost + channel, path
                    if state not in new or total > new[state][0]:
                        new[state] = (total, way)
            paths = new
        (_, _), (_, path) = max(paths.items(), key=lambda x: x[1][0] + model[(x[0][0] * _SYMBOLS + x[0][1]) * _SYMBOLS])
        out = []
        while path is not None:
            letter, path = path
            out.append(letter)
        return "".join(reversed(out))


_is_letter, _is_sign, _is_separator, _is_edge, _is_punctuation = (np.zeros(256, bool) for _ in range(5))
_is_letter[97:123] = _is_letter[65:91] = _is_letter[128:] = True
_is_sign[[ord(s) for s in SIGNS]] = True
_is_separator[[ord(s) for s in SEPARATORS if s != " "]] = True
_is_edge[33:127] = ~(_is_letter | _is_sign)[33:127]
_is_punctuation[[ord(s) for s in PUNCTUATION]] = True


def _pairs(data: np.ndarray) -> np.ndarray:
    """Places of letters that the next letter repeats, in any case; letters beyond ASCII are told apart roughly."""
    same = np.zeros(len(data), bool)
    if len(data) > 1:
        low = data | 32
        same[:-1] = _is_letter[data[:-1]] & (data[:-1] < 128) & _is_letter[data[1:]] & (low[:-1] == low[1:])
        for size, least, most in ((2, 0xC2, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF4)):
            at = np.flatnonzero((data >= least) & (data <= most))
            at = at[at + 2 * size <= len(data)]
            same[at] = (data[at] == data[at + size]) & np.all([low[at + k] == low[at + size + k] for k in range(1, size)], axis=0)
    return same


def _cores(start: np.ndarray, end: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of words without the bytes ``outside`` at their ends; an empty span starts at its end."""
    inside = np.append(np.flatnonzero(~outside), len(outside))
    core_start = np.minimum(inside[np.searchsorted(inside, start)], end)
    core_end = inside[np.maximum(np.searchsorted(inside, end) - 1, 0)] + 1
    return core_start, np.where(core_start < end, core_end, core_start)


def written_forms(offsets: np.ndarray, data: np.ndarray) -> list[tuple[int, str, int, int]]:
    """(text, form, first byte, end) of all that may be obfuscated, without the punctuation at its ends.

    Words with a sign, a separator inside or two equal letters in a row, and runs of
    single letters, signs and separators with at least two letters or signs.
    """
    found = words.split_words(offsets, data)
    if not len(found.code):
        return []
    text, raw = found.text, data.tobytes()

    def before(marks: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(marks)])

    characters = before((data & 0xC0) != 0x80)
    # a token of one character, punctuation apart, or one sign or separator alone
    one_start, one_end = _cores(found.start, found.end, _is_edge[data] | _is_punctuation[data])
    one = characters[one_end] - characters[one_start] == 1
    alone = (one_start == one_end) & (found.end - found.start == 1) & (_is_punctuation | _is_separator)[data[found.start]]
    one_start, one_end = np.where(alone, found.start, one_start), np.where(alone, found.end, one_end)
    single = one | alone
    joined = single[1:] & single[:-1] & (text[1:] == text[:-1])
    bounds = np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8))
    solid = single & (_is_letter | _is_sign)[data[np.minimum(one_start, len(data) - 1)]]
    places = np.flatnonzero(solid)
    out = []
    for a, b in zip(np.flatnonzero(bounds == 1), np.flatnonzero(bounds == -1) + 1):
        left, right = np.searchsorted(places, [a, b])
        if right - left >= 2:
            spans = range(places[left], places[right - 1] + 1)
            form = " ".join(raw[one_start[k]:one_end[k]].decode().lower() for k in spans)
            out.append((int(text[a]), form, int(one_start[spans[0]]), int(one_end[spans[-1]])))
    # words; equal ones are written out once
    start, end = _cores(found.start, found.end, _is_edge[data])
    symbols = before(_is_sign[data] | _is_separator[data] | _pairs(data))
    strange = np.flatnonzero((symbols[end] > symbols[start]) & (characters[end] - characters[start] > 1) & ~single)
    _, first, which = np.unique(found.code[strange], return_index=True, return_inverse=True)
    forms = [raw[start[k]:end[k]].decode().lower() for k in strange[first]]
    return out + [(t, forms[w], a, b) for t, w, a, b in zip(*(x.tolist() for x in (text[strange], which, start[strange], end[strange])))]


def restored(offsets: np.ndarray, data: np.ndarray, reader: Reader) -> list[tuple[int, str, int, int]]:
    """(text, reading, first byte, end of the written form) where the reading differs from the written form."""
    out = []
    for text, form, start, end in written_forms(offsets, data):
        reading = reader.read(form)
        if reading != form:
            out.append((text, reading, start, end))
    return out


def _codes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, first byte) of words and word beginnings."""
    found = words.split_words(offsets, data, "letters")
    if not len(found.code):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    terms = words._codes(True)[data] * words.power("up", len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    text, down = found.text, words.power("down", len(data))[found.start]
    starts, texts, codes = [found.start], [text], [found.code]
    for k in BEGINNINGS:
        long = np.flatnonzero(found.end - found.start > k)
        starts.append(found.start[long])
        texts.append(text[long])
        codes.append(words.mix((total[found.start[long] + k] - total[found.start[long]]) * down[long] + np.uint64(1_000 + k)))
    return np.concatenate(texts), np.concatenate(codes), np.concatenate(starts)


def features(offsets: np.ndarray, data: np.ndarray, reader: Reader) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str]]]:
    """(text, code) pairs of the restored texts, with repeats, and the readings: a reading stands in the place of its written form."""
    text, code, start = _codes(offsets, data)
    found = restored(offsets, data, reader)
    readings = [(t, r) for t, r, _, _ in found]
    if readings:
        from_to = np.array([(a, b) for _, _, a, b in found])
        replaced = np.zeros(len(data) + 1, np.int32)
        np.add.at(replaced, from_to[:, 0], 1)
        np.add.at(replaced, from_to[:, 1], -1)
        kept = np.cumsum(replaced)[start] == 0
        more, extra, _ = _codes(*words.text_buffers(pa.array([r for _, r in readings], pa.string())))
        text, code = np.concatenate([text[kept], np.array([t for t, _ in readings])[more]]), np.concatenate([code[kept], extra])
    return text, code, readings


def _class_counts(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """In how many texts of each class each code occurs."""
    reader = Reader(shared.value)
    for rows, offsets, data in words.blocks(batches, size=words.RUN_BYTES):
        text, code, _ = features(offsets, data, reader)
        toxic = rows.column("toxic").to_numpy()
        order = np.lexsort((text, code))
        text, code = text[order], code[order]
        once = np.ones(len(code), bool)
        once[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
        own, which = np.unique(code[once], return_inverse=True)
        bad = np.bincount(which, weights=toxic[text[once]], minlength=len(own)).astype(np.int64)
        every = np.bincount(which, minlength=len(own))
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(bad), pa.array(every - bad)], names=["code", "bad", "good"])


def _presence(batches: Iterator[pa.RecordBatch], shared, chosen) -> Iterator[pa.RecordBatch]:
    """Which chosen codes each text holds."""
    reader, table = Reader(shared.value), Chosen(chosen.value)
    for rows, offsets, data in words.blocks(batches, size=words.RUN_BYTES):
        text, place = table.found(*features(offsets, data, reader)[:2])
        lists = [[] for _ in range(rows.num_rows)]
        for t, p in zip(text.tolist(), place.tolist()):
            lists[t].append(p)
        yield pa.RecordBatch.from_arrays([rows.column("toxic").cast(pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["toxic", "held"])


class Chosen:
    """Looks up codes among a few chosen ones."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes  # sorted
        self.coarse = np.zeros(1 << 16, bool)
        self.coarse[(codes >> np.uint64(48)).astype(np.int64)] = True

    def found(self, text: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of each chosen code in each text, once."""
        maybe = np.flatnonzero(self.coarse[(code >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.codes, code[maybe]), max(0, len(self.codes) - 1))
        hit = self.codes[place] == code[maybe] if len(self.codes) else np.zeros(len(maybe), bool)
        both = np.unique(text[maybe[hit]].astype(np.int64) * (len(self.codes) + 1) + place[hit])
        return both // (len(self.codes) + 1), both % (len(self.codes) + 1)


def fit_logistic(held: list, toxic: np.ndarray, size: int, ridge: float = 0.02, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic model on sets of codes, by gradient steps with momentum; classes count alike."""
    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    column = np.array([p for h in held for p in h], np.int64)
    weight = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum()))
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(row, weights=w[column], minlength=len(held)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic)
        g = np.append(np.bincount(column, weights=error[row], minlength=size) + ridge * w / max(1, size), error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


class Model:
    """A fitted scorer: character model, chosen codes with weights, offset."""

    def __init__(self, characters: np.ndarray, codes: np.ndarray, weights: np.ndarray, offset: float):
        self.characters, self.codes, self.weights, self.offset = characters, codes, weights, offset


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def _evidence(sizes: dict) -> Column:
    """Log-likelihood ratio of a code and the classes being dependent; few labelled texts choose no chance codes."""
    bad, good = F.col("bad"), F.col("good")
    total, held = sizes[1] + sizes[0], bad + good

    def term(seen: Column, row: Column, size: int) -> Column:
        return F.when(seen > 0, seen * F.log(seen * total / (row * size))).otherwise(0.0)

    return 2 * (term(bad, held, sizes[1]) + term(good, held, sizes[0]) + term(sizes[1] - bad, total - held, sizes[1]) + term(sizes[0] - good, total - held, sizes[0]))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: dict = SAMPLE_ROWS) -> Model:
    """Character model from all of ``docs``; scorer from labelled rows outside the test fold.

    At most ``sample_rows`` documents of each class are used, chosen by a hash of
    their id. Rows without id or label teach nothing; an id labelled twice counts
    with its larger label. Without rows of both classes every score is 0.
    """
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    characters = character_model(docs, text)
    known = labels.select(labels[f"`{doc_id}`"].alias("id"), labels[f"`{label}`"].cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    known = known.where(fold_of(F.col("id")) != TEST_FOLD).groupBy("id").agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in sorted(sample_rows.items())]
    chosen_ids = parts[0].unionByName(parts[1])
    rows = docs.select(docs[f"`{doc_id}`"].alias("id"), docs[f"`{text}`"].cast("string").alias("text")).join(chosen_ids, "id").select("text", "toxic")
    shared = context.broadcast(characters)
    sizes = dict(rows.groupBy("toxic").count().toArrow().to_pandas().itertuples(index=False))
    none = Model(characters, np.zeros(0, np.uint64), np.zeros(0), -math.inf)
    if not sizes.get(0) or not sizes.get(1):
        return none
    counts = rows.mapInArrow(partial(_class_counts, shared=shared), "code long, bad long, good long")
    counts = counts.groupBy("code").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= MIN_TOXIC)
    lift = (F.col("bad") / sizes[1]) / ((F.col("good") + 0.5) / sizes[0])
    best = counts.where((lift >= MIN_LIFT) & (_evidence(sizes) >= MIN_EVIDENCE)).orderBy(F.desc(F.col("bad") / sizes[1] - F.col("good") / sizes[0]), "code").limit(FEATURES)
    codes = np.sort(best.select("code").toArrow()["code"].to_numpy().astype(np.uint64))
    if not len(codes):
        return none
    chosen = context.broadcast(codes)
    held = rows.mapInArrow(partial(_presence, shared=shared, chosen=chosen), "toxic int, held array<int>").toArrow()  # at most the sample's rows
    weights, offset = fit_logistic(held["held"].to_pylist(), held["toxic"].to_numpy(), len(codes))
    return Model(characters, codes, weights, offset)


def _start(shared):
    model = shared.value
    reader, table = Reader(model.characters), Chosen(model.codes)

    def annotate(offsets, data):
        text, code, readings = features(offsets, data, reader)
        at, place = table.found(text, code)
        z = np.bincount(at, weights=model.weights[place], minlength=len(offsets) - 1) + model.offset
        score = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        if not len(model.codes):
            score[:] = 0.0
        lists: list[list[str]] = [[] for _ in range(len(offsets) - 1)]
        for t, reading in readings:
            lists[t].append(reading)
        return pa.StructArray.from_arrays([pa.array(score), pa.array(lists, pa.list_(pa.string()))], names=RESULT.names)

    return annotate


def scored(docs: DataFrame, model: Model, *, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Every row with the struct ``into``: ``score`` from 0 to 1, and ``restored``, the readings of obfuscated words.

    A missing or empty text has the score of a text without any known word. Equal
    texts score alike. A column named ``into`` is replaced. Texts may be of any length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES and the fixed symbols
    return annotated(docs, text, into, RESULT, partial(_start, shared), words.RUN_BYTES)


def without_toxic(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged."""
    into = "__toxicity"
    model = fit(docs, labels, doc_id=doc_id, text=text, **options)
    return scored(docs, model, text=text, into=into).where(F.col(f"{into}.score") < THRESHOLD).drop(into)
