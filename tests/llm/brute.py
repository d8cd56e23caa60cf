"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text, width=5):
    lowered = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    found = WORD.findall(lowered)
    if not found:
        return set()
    return {tuple(found[k : k + width]) for k in range(max(1, len(found) - width + 1))}


def similar(rows):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) rows."""
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    shared = defaultdict(int)
    for members in holders.values():
        for n, a in enumerate(members):
            for b in members[n + 1 :]:
                shared[a, b] += 1
    links = [p for p, o in shared.items() if 100 * o >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - o)]
    found = components(list(sets), links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def without_repeats(rows, width=50):
    """{doc_id: (n_words, n_removed, sha256)} of (doc_id, text) rows."""
    split, owner = {i: words(t) for i, t in rows}, {}
    for i in sorted(split):
        for k in range(len(split[i]) - width + 1):
            owner.setdefault(tuple(split[i][k : k + width]), i)
    out = {}
    for i, found in split.items():
        gone = set()
        for k in range(len(found) - width + 1):
            if owner[tuple(found[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = b" ".join(w for k, w in enumerate(found) if k not in gone)
        out[i] = (len(found), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def mix_targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} by capping and sharing out again until none is above its cap."""
    order = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= above
    return target
