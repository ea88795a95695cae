"""Brute-force versions of the operators that SQL can't express."""

import hashlib
import re
from collections import defaultdict


def sha(b):
    return hashlib.sha256(b).hexdigest()


def bytes_dedup(rows, window=50):
    """(id, n_bytes, n_removed, n_spans, kept) by a table of every window."""
    key = lambda i: float("inf") if i is None else i
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - window + 1):
            w = b[p:p + window]
            least[w] = min(least.get(w, float("inf")), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if least[b[p:p + window]] < key(i):
                gone[p:p + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(i), len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return sorted(out)


def words_dedup(rows, window=13):
    key = lambda i: float("inf") if i is None else i
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    least = defaultdict(lambda: float("inf"))
    for i, t in rows:
        w = split(t)
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            least[k] = min(least[k], key(i))
    out = []
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if least[tuple(w[p:p + window])] < key(i):
                gone[p:p + window] = [True] * window
        out.append((str(i), len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out)


def jaccard_components(rows, shingle=4, num=85):
    """(id, set size, smallest linked id) by comparing all pairs of sets."""
    sets = []
    for i, t in rows:
        low = (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
        w = re.findall(rb"[^\x20\x09-\x0D]+", low)
        sets.append((i, {tuple(w[p:p + shingle]) for p in range(max(1, len(w) - shingle + 1))} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(None if i is None else find(i))) for i, s in sets)
