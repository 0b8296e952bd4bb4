"""Brute-force versions of the operators, for small tables."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(texts):
    """{id: (shingles, component)}"""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(texts, width=50):
    """{id: (words, words left)}"""
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    low = {}
    for i, w in words.items():
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            low[key] = min(low.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - width + 1):
            if low[tuple(w[p : p + width])] < i:
                gone.update(range(p, p + width))
        out[i] = (len(w), [x for p, x in enumerate(w) if p not in gone])
    return out
