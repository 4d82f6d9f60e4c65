"""Plain Python versions of the text operators, for small inputs."""

from __future__ import annotations

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def kept_words(docs, width):
    """{row: (number of words, number removed, kept words)} of rows (id, text)."""
    words = [WORD.findall(t or "") for _, t in docs]
    first = {}
    for (doc, _), own in zip(docs, words):
        for i in range(len(own) - width + 1):
            if doc is not None:
                key = tuple(own[i : i + width])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), own in zip(docs, words):
        gone = set()
        for i in range(len(own) - width + 1):
            if doc is not None and first[tuple(own[i : i + width])] < doc:
                gone |= set(range(i, i + width))
        out.append((doc, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return out


def contamination(docs, items, window):
    """Rows (id, number of words, number hit, items as sorted strings)."""
    wins = {}
    for item, text in items:
        own = TOKEN.findall((text or "").translate(LOWER))
        for i in range(max(1, len(own) - window + 1) if own else 0):
            wins.setdefault(tuple(own[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        own, hit, found = TOKEN.findall((text or "").translate(LOWER)), set(), set()
        for win, whose in wins.items():
            for i in range(len(own) - len(win) + 1):
                if tuple(own[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= whose
        out.append((doc, len(own), len(hit), sorted(map(str, found))))
    return out


def edits(a, b):
    """Word edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def kept_lines(docs, min_words):
    """{id: kept text} of rows (id, text) with different ids."""
    lines = [(d, i, line, WORD.findall(line)) for d, t in docs if t is not None for i, line in enumerate(t.split("\n"))]
    judged = sorted((d, i, w) for d, i, _, w in lines if d is not None and len(w) >= min_words)
    gone = {(d, i) for k, (d, i, w) in enumerate(judged) if any(edits(w, o[2]) <= 1 for o in judged[:k])}
    out = {d: None for d, _ in docs}
    for d, t in docs:
        if t is not None:
            out[d] = "\n".join(line for e, i, line, _ in lines if e == d and (d, i) not in gone)
    return out


def shingles(text, size):
    own = WORD.findall((text or "").translate(LOWER))
    if not own:
        return set()
    return {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} or {tuple(own)}


def components(docs, size, percent):
    """{id: (number of shingles, smallest id reachable)} of rows (id, text) with different ids."""
    sets = {d: shingles(t, size) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}
