"""Plain versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, size):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard_components(rows, percent=90, size=3):
    """{(doc_id, text): (n_shingles, component_id)}; rows with one id are one node."""
    sets = [(d, shingles(t, size)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return Counter((d, len(s), None if d is None else find(d)) for d, s in sets)


def without_lines(rows, least=20, several=3):
    keys = defaultdict(set)
    key = lambda line: line.strip(WHITE).translate(LOWER)
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                keys[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(key(x)) < least or len(keys[key(x)]) < several or max(keys[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def without_passages(rows, size=13):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - size + 1):
            if d is not None:
                first[tuple(w[i:i + size])] = min(d, first.get(tuple(w[i:i + size]), d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i:i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)
