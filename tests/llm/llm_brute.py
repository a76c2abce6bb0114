"""Plain Python versions of the operators, straight from their definitions."""

import math
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near_groups(docs):
    """doc_id -> (n_shingles, component_id) of (doc_id, text) with distinct ids."""
    sets = {}
    for i, text in docs:
        w = SPACED.findall(lower(text))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def dedup_lines(docs, min_words):
    """doc_id -> (lines with words, deleted, text) of (doc_id, text) with distinct ids, by trying every run."""
    worded = {i: [(p, line) for p, line in enumerate(text.split("\n")) if SPACED.search(line)] for i, text in docs}
    seen, gone = set(), defaultdict(set)
    for i in sorted(worded):
        lines = [line for _, line in worded[i]]
        counts = [len(SPACED.findall(line)) for line in lines]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(counts[a:b]) >= min_words:
                    run = tuple(lines[a:b])
                    if run in seen:
                        gone[i].update(range(a, b))
                    seen.add(run)
    out = {}
    for i, text in docs:
        dropped = {worded[i][k][0] for k in gone[i]}
        out[i] = (len(worded[i]), len(gone[i]), "\n".join(line for p, line in enumerate(text.split("\n")) if p not in dropped))
    return out


def test_hits(text, items, window=10):
    """(n_words, n_hit, item ids as sorted strings) of one text."""
    words = LETTERS.findall(lower(text))
    hit, found = set(), set()
    for item, item_text in items:
        w = LETTERS.findall(lower(item_text))
        size = min(window, len(w))
        grams = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if w else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k:k + size]) in grams:
                hit.update(range(k, k + size))
                if item is not None:
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


test_hits.__test__ = False


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def interpolated(docs, weights_of, steps=16):
    """doc_id -> (n_tokens, n_known, train_tokens, base, score); ``weights_of`` gets the tuning lines (bucket, ratio, count)."""
    tokens = {i: SPACED.findall(lower(text)) + ["</s>"] for i, text in docs}

    def counts(keep):
        uni, bi, first = Counter(), Counter(), Counter()
        for i, t in tokens.items():
            if i is not None and keep(fold(i, 7)):
                uni.update(t)
                bi.update(zip(["<s>", *t], t))
                first.update(["<s>", *t[:-1]])
        return uni, bi, first

    uni, bi, first = counts(lambda f: f not in (2, 3))
    n, v = sum(uni.values()), len(uni)
    lines = Counter()
    for i, t in tokens.items():
        if i is not None and fold(i, 7) == 3:
            for a, b in zip(["<s>", *t], t):
                if first[a]:
                    ratio = -100_000 if not bi[a, b] else round(steps * math.log2(bi[a, b] / first[a] * (n + v + 1) / (uni[b] + 1)))
                    lines[int(math.log2(first[a])), ratio] += 1
    weights = weights_of(lines)
    uni, bi, first = counts(lambda f: f != 2)
    n, v = sum(uni.values()), len(uni)
    out = {}
    for i, t in tokens.items():
        base = score = 0.0
        for a, b in zip(["<s>", *t], t):
            p = (uni[b] + 1) / (n + v + 1)
            base += math.log10(p)
            w = weights[min(int(math.log2(first[a])), len(weights) - 1)] if first[a] else 0.0
            score += math.log10((w * bi[a, b] / first[a] if first[a] else 0.0) + (1 - w) * p)
        out[i] = (len(t), sum(uni[x] > 0 for x in t), n, base, score)
    return out
