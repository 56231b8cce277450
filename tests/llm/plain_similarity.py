"""Plain versions of text similarity: every pair that shares a shingle, and its classes."""

from collections import Counter, defaultdict


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def close_pairs(texts, similarity=0.8):
    """Pairs of keys of ``texts`` whose five-word shingles have this Jaccard similarity or more."""
    sets = {k: plain_shingles(t) for k, t in texts.items()}
    holders, pairs = defaultdict(list), set()
    for key in sorted(sets):
        met = Counter(k for shingle in sets[key] for k in holders[shingle])
        pairs |= {(k, key) for k, n in met.items() if n >= similarity * (len(sets[k]) + len(sets[key]) - n)}
        for shingle in sets[key]:
            holders[shingle].append(key)
    return pairs


def class_of(groups, pairs):
    """The smallest key of each key's class, where groups (key to smallest key) are linked by pairs."""
    up = {k: k for k in groups}

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in [*groups.items(), *pairs]:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {k: root(k) for k in groups}
