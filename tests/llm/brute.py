"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict


class Sets:
    """Union-find in which the least member names a set."""

    def __init__(self, items):
        self.parent = {x: x for x in items}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def ascii_words(text):
    return (text or "").encode().split()


def similar_pairs(sets, above, below):
    """Keys of sets with Jaccard similarity >= above / below."""
    index = defaultdict(list)
    for key, members in sets.items():
        shared = Counter(other for m in members for other in index[m])
        for other, n in shared.items():
            if below * n >= above * (len(members) + len(sets[other]) - n):
                yield other, key
        for m in members:
            index[m].append(key)


def near_duplicates(docs, words, above, below):
    """{doc_id: (set size, component)}."""
    sets = {}
    for key, text in docs.items():
        w = (text or "").encode().lower().split()
        sets[key] = {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    groups = Sets(sets)
    for a, b in similar_pairs(sets, above, below):
        groups.join(a, b)
    return {k: (len(s), groups.find(k)) for k, s in sets.items()}


def unique_lines(docs, above=4, below=5, size=8):
    """{doc_id: (kept text, lines removed)}; ids are distinct."""
    places = defaultdict(list)
    for key in sorted(docs):
        for k, line in enumerate((docs[key] or "").encode().split(b"\n")):
            normal = b" ".join(line.lower().split())
            if normal:
                places[normal].append((key, k))
    order = sorted(places, key=lambda n: places[n][0])
    sets = {i: {n[j:j + size] for j in range(max(1, len(n) - size + 1))} for i, n in enumerate(order)}
    groups = Sets(sets)
    for a, b in similar_pairs(sets, above, below):
        groups.join(a, b)
    gone = defaultdict(set)
    for i, n in enumerate(order):
        kept = places[order[groups.find(i)]][0]
        for key, k in places[n]:
            if (key, k) != kept:
                gone[key].add(k)
    return {key: (None if text is None else "\n".join(p for k, p in enumerate(text.split("\n")) if k not in gone[key]),
                  len(gone[key])) for key, text in docs.items()}


def without_repeats(texts, window):
    """(words, removed, sha256 of the kept words) per text."""
    rows = [ascii_words(t) for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in rows for i in range(len(w) - window + 1))
    out = []
    for w in rows:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def leaks(docs, items, window=13):
    """{(doc_id, item_id)} that share 13 lower-case words in a row."""
    def words(text):
        return re.findall(r"[^\W\d_]+", (text or "").lower())

    index = defaultdict(set)
    for item, text in items.items():
        w = words(text)
        for i in range(len(w) - window + 1):
            index[tuple(w[i:i + window])].add(item)
    return {(doc, item) for doc, text in docs.items() for w in [words(text)]
            for i in range(len(w) - window + 1) for item in index.get(tuple(w[i:i + window]), ())}
