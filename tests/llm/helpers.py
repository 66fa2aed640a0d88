"""Small inputs and plain re-statements of what the operators compute."""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def rows_of(frame, *columns):
    """Collected rows as tuples, in an order that null values do not upset."""
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, size=5):
    w = words(text)
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def shingle_bag(w, first=0, last=None, size=5):
    last = len(w) - size + 1 if last is None else last
    return Counter(tuple(w[k : k + size]) for k in range(first, min(last, len(w) - size + 1)))


def groups(ids, links):
    """Least id reachable from each id."""
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def similar_groups(texts):
    """Set size and least id of the component of every id of a dict of texts."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    return {i: (len(sets[i]), least) for i, least in groups(ids, links).items()}
