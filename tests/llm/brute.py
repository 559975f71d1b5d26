"""Plain forms of the operators' contracts, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))


def near_duplicates(rows, n=5, percent=75):
    """{doc_id: (set size, component)}; rows: (doc_id, text)."""
    sets = {d: shingle_set(t, n) for d, t in rows}
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def contamination(rows, items, window=13):
    """{doc_id: (words, hit words, items, digest, contaminated)}."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        if i is not None and w:
            n = min(window, len(w))
            for k in range(len(w) - n + 1):
                grams[tuple(w[k:k + n])].add(str(i))
    out = {}
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if g := grams.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    found |= g
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def secrets(text, rules):
    text = text or ""
    found = [(m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, text) if len(m.group(r.group)) >= r.least]
    return [(a, rules[k].kind, b) for a, k, b in sorted(found)]


def greedy_pieces(word, vocabulary):
    """Greedy longest match: the first piece carries the mark, later ones do not; 1 for a word that cannot be covered."""
    s, at, n = "▁" + word, 0, 0
    while at < len(s):
        end = next((e for e in range(len(s), at, -1) if s[at:e] in vocabulary and (at == 0) == s[at:e].startswith("▁")), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def rebuilt_words(doc_id, text):
    """The words of a document as the periodic-run contract takes them."""
    import zlib

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def runs(w, power=4, least=6):
    """All maximal runs (start, length, smallest period) of a word list, period by period."""
    found = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, power * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def run_row(doc_id, text):
    from fractions import Fraction

    w = rebuilt_words(doc_id, text)
    found = runs(w)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest())


def rebuilt_conversations(rows):
    """rows: (conv_id, turn, role, text) -> {conv_id: [(role, text)]} as the prefix-trie contract rebuilds them; ties keep role, length order."""
    import zlib

    own = collections.defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", len(r[3] or ""))):
        own[c].append((r or "", x or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c - 100 * int(c / 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def prefix_trie(convs):
    """{(depth, turns)} node rows from {conv_id: turns}."""
    members = collections.defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, who in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(who) - 1) * (len(k[-1][1]) if k else 0)
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in members[k] if len(convs[c]) == len(k)).encode()).hexdigest()
    return [(who[0], len(k), members[k[:-1]][0] if k else None, len(who), kids[k], leaves[k], saved[k], sha(k)) for k, who in members.items()]


def vector_groups(rows, least=0.95):
    """{id: (links, component, kept)} over all pairs; an id with several vectors has their links together. rows: (id, vector)."""
    import math

    import numpy as np

    ids = sorted({i for i, _ in rows if i is not None})
    sound = {(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    sound = [(i, np.array(v) / max(map(abs, v))) for i, v in sorted(sound)]
    parent, count = {i: i for i in ids}, collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in sound:
        for j, y in sound:
            if len(x) == len(y) and (i != j or x is not y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                count[i] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (count[i], find(i), find(i) == i) for i in ids}
