"""Plain single-machine versions of the contracts, to test against."""

import collections
import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np

SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substrings(docs, n=50):
    """{doc_id: (n_words, n_removed, sha of the kept words)}; docs: {doc_id: text}."""
    first = {}
    for i in sorted(docs):
        w = words(docs[i])
        for j in range(len(w) - n + 1):
            first.setdefault(tuple(w[j : j + n]), i)
    out = {}
    for i, text in docs.items():
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < i:
                gone[j : j + n] = [True] * n
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def line_key(line):
    return line.strip(SPACES).translate(_LOW)


def lines(docs, chars=20, least=3):
    holders = collections.defaultdict(set)
    for i, text in docs.items():
        for x in (text or "").split("\n"):
            holders[line_key(x)].add(i)
    out = {}
    for i, text in docs.items():
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if len(line_key(x)) < chars or len(holders[line_key(x)]) < least or max(holders[line_key(x)]) == i]
        out[i] = (len(all_), len(all_) - len(kept), sha("\n".join(kept)))
    return out


def shingle_set(text, n):
    w = words((text or "").translate(_LOW))
    if len(w) >= n:
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def components(sets, num, den):
    """{id: smallest linked id}."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter()
        for t in sets[i]:
            for j in having[t]:
                common[j] += 1
            having[t].append(i)
        for j, c in common.items():
            if den * c >= num * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def base_rules(text, window=8):
    text = text or ""
    w = words(text)
    places = collections.defaultdict(list)
    for i in range(len(w) - window + 1):
        places[tuple(w[i : i + window])].append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + window)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def top_k(vectors, query_ids, k=10):
    ids = np.array(sorted(vectors))
    m = np.array([vectors[i] for i in ids], dtype=np.int64)
    out = set()
    for q in query_ids:
        s = m @ m[np.searchsorted(ids, q)]
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out |= {(int(q), n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(best)}
    return out


def mix_targets(sizes):
    """{source: target}; sizes: {source or None: words}."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    rest, free, out = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while free:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / whole > 2 * sizes[s]]
        if not over:
            out |= {s: rest * weight[s] / whole for s in free}
            break
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            free.discard(s)
        rest -= sum(out[s] for s in over)
    return {s: float(t) for s, t in out.items()}


def crc(text):
    return zlib.crc32((text or "").encode())
