"""Plain, quadratic versions of the operators for small fixtures."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def least_reachable(ids, linked):
    """The least id that links reach, for each id."""
    top = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(top[a], top[b])
            if top[a] != low or top[b] != low:
                top[a] = top[b] = low
                changed = True
    return top


def similar(docs, n=5):
    """{doc: (set size, class)}; docs: {id: text}."""
    sets = {}
    for d, t in docs.items():
        w = WORDS.findall(lower(t))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    top = least_reachable(ids, links)
    return {d: (len(sets[d]), top[d]) for d in ids}


def leaks(docs, items, span=10):
    """{doc: (words, hit, items, sha, contaminated)}; items: [(id, text)]."""
    windows = collections.defaultdict(set)
    for i, t in items:
        w = LETTERS.findall(lower(t))
        m = min(span, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k : k + m])].add(i)
    out = {}
    for d, t in docs.items():
        w, hit, found = LETTERS.findall(lower(t)), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if x := windows.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    found |= x
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), sha, bool(hit))
    return out


def dedup_lines(docs):
    """{doc: (text, lines, removed)}; docs: {id: text}, in the order of ids."""
    lines = {d: re.split(r"(?<=\n)|(?<=[.!?,;:] )", t) for d, t in sorted(docs.items()) if t is not None}
    first, gone = {}, collections.defaultdict(set)
    for d, l in lines.items():
        key = [x.strip(" \n\r\t\f\x0b") for x in l]
        for k in range(len(l) - 2):
            if first.setdefault(tuple(key[k : k + 3]), (d, k)) != (d, k):
                gone[d] |= {k, k + 1, k + 2}
    for d, g in gone.items():
        for k in sorted(g):
            if k - 1 not in g:
                end = next(e for e in range(k, len(lines[d]) + 1) if e not in g)
                run = "".join(lines[d][k:end])
                if len(run) < 80 and run.count("\n") < 2:
                    gone[d] = gone[d] - set(range(k, end))
    out = {d: ("".join(x for k, x in enumerate(l) if k not in gone[d]), len(l), len(gone[d])) for d, l in lines.items()}
    return out | {d: (None, 0, 0) for d, t in docs.items() if t is None}


def near(vectors, threshold=0.95):
    """{id: (links, class)}; vectors: {id: list or None}."""
    sound = {i: np.array(v, float) for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    sound = {i: v / np.linalg.norm(v) for i, v in sound.items()}
    links = [(a, b) for a in sound for b in sound if a < b and len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] >= threshold]
    n = collections.Counter(x for l in links for x in l)
    top = least_reachable(list(vectors), links)
    return {i: (n[i], top[i]) for i in vectors}


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """{source: target} by raising one level until the whole is dealt; sizes: {source: words}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    whole, stopped = share * sum(sizes.values()), set()
    while True:
        left = whole - sum(most * sizes[s] for s in stopped)
        free = [s for s in order if s not in stopped]
        level = left / sum(weight[s] for s in free) if free else 0
        new = {s for s in free if weight[s] * level > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in stopped else weight[s] * level for s in order}
        stopped |= new
