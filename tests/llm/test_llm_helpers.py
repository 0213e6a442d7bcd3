"""Helpers of the tests of this folder."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed_words(rows, weights=(5, 2, 1), ceiling=3):
    """source -> (target in words, words of its longest document) by repeated resharing."""
    size, most = defaultdict(int), defaultdict(int)
    for _, text, _, source, _ in rows:
        n = len(WORD.findall(text or ""))
        size[source] += n
        most[source] = max(most[source], n)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = float(sum(size.values())), set(names), {}
    while free:
        share = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * share > ceiling * size[s]}
        if not full:
            target |= {s: w[s] * share for s in free}
            break
        for s in full:
            target[s] = float(ceiling * size[s])
            left -= target[s]
        free -= full
    return {s: (target[s], most[s]) for s in names}
