"""Suffix-array dedup of bytes by prefix-free parsing.

Rolling-hash triggers cut every document into phrases: a phrase is a maximal run
of window starts with the same trigger (the smallest hash of the window's k-byte
grams) plus the bytes to the end of its last window.  Where a phrase starts and
ends depends on the windows' content alone, so copies are parsed alike.  In highly
repetitive text the distinct phrases (the dictionary) are far fewer than the
phrases of all documents (the parse), and corpus order follows from both:

1. Triggers that one document alone holds are dropped with their windows: those
   are unique.
2. Parse: every distinct phrase meets its occurrences, and the smallest document is
   its first.  All windows of later occurrences also start there, so they are
   settled.  The first occurrence is open only if its trigger stands in another
   phrase of the dictionary.
3. Dictionary: the suffix array of the open phrases of a group (cut at the window,
   grouped by trigger), each suffix in the parse's document order.  Suffixes that
   tie over the whole window are equal strings; the smallest document of a tie
   settles them.  A trigger with more than ``hot`` phrases is not gathered in one
   group: its phrases are cut into single windows, grouped by content.

Flags go back to the documents as bitmaps, overlapping flagged windows are removed.

Defined results: null or empty texts have no bytes; documents shorter than the
window keep all; rows that share an id never remove each other's bytes; a null id
counts as larger than every other; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from .shards import (BLOBS, NO_ID, SHARD_BYTES, Shard, Shards, blobs, bucket_of, census_answer, census_blobs, census_read,
                     exchange, shard_pass, write_shards)

WINDOW = 50
GRAM = 20
HOT = 2048   # phrases of one trigger that one group gathers

_PHRASE = np.dtype([("trigger", np.uint64), ("phrase", np.uint64), ("doc", np.int64)])
SETTLED, OPEN, OPEN_HOT = 1, 2, 3


class _Parse:
    """Phrases of one shard: first window start, number of windows, trigger, document id."""

    def __init__(self, s: Shard, window: int, gram: int):
        self.s, self.window = s, window
        self.valid = tk.valid_starts(s.off, window)
        m = tk.triggers(s.buf, window, gram, tk.BYTE_SYMBOL)
        head = self.valid.copy()
        head[1:] &= ~(self.valid[:-1] & (m[1:] == m[:-1]))
        self.at = np.flatnonzero(head)
        tail = self.valid.copy()
        tail[:-1] &= ~(self.valid[1:] & (m[1:] == m[:-1]))
        self.n = np.flatnonzero(tail) + 1 - self.at
        self.trigger = m[self.at]
        self.row = np.searchsorted(s.off, self.at, "right") - 1
        self.doc = s.ids[self.row]

    def keep(self, mask: np.ndarray) -> None:
        for name in ("at", "n", "trigger", "row", "doc"):
            setattr(self, name, getattr(self, name)[mask])

    def entries(self):
        """Hash of each phrase, its entry (distinct phrases by bucket), the entries' first phrase."""
        h = tk.span_hashes(self.s.buf, self.at, self.at + self.n + self.window - 1, tk.BYTE_SYMBOL)
        order = np.lexsort((self.doc, h, self.trigger))
        t, p = self.trigger[order], h[order]
        head = np.ones(len(order), bool)
        head[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1])
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(head) - 1
        return h, entry, order[head]


def _parse_answer(payloads: list[bytes], hot: int) -> list[bytes]:
    """Per distinct phrase of a shard: settled (a smaller document has it), open, or neither."""
    parts = [np.frombuffer(p, _PHRASE) for p in payloads]
    x = np.concatenate(parts)
    order = np.lexsort((x["doc"], x["phrase"], x["trigger"]))
    s = x[order]
    new_t = np.ones(len(s), bool)
    new_t[1:] = s["trigger"][1:] != s["trigger"][:-1]
    new_p = new_t.copy()
    new_p[1:] |= s["phrase"][1:] != s["phrase"][:-1]
    first = np.flatnonzero(new_p)
    smallest = np.repeat(s["doc"][first], np.diff(np.concatenate([first, [len(s)]])))
    tops = np.flatnonzero(new_t)
    phrases = np.repeat(np.add.reduceat(new_p, tops, dtype=np.int64), np.diff(np.concatenate([tops, [len(s)]])))
    code = np.where(smallest < s["doc"], SETTLED, np.where(phrases > hot, OPEN_HOT, np.where(phrases > 1, OPEN, 0)))
    out = np.empty(len(s), np.uint8)
    out[order] = code
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return [c.tobytes() for c in np.split(out, cuts)]


def _answers(bucket: np.ndarray, buckets: int, got: dict[int, bytes]) -> np.ndarray:
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    out = np.zeros(len(bucket), np.uint8)
    for b, x in got.items():
        out[cut[b]:cut[b + 1]] = np.frombuffer(x, np.uint8)
    return out


class _Open:
    """Open phrases of a shard as dictionary entries, in the order they are sent."""

    def __init__(self, x: _Parse, h: np.ndarray, entry: np.ndarray, first: np.ndarray, code: np.ndarray, buckets: int):
        of = first[(code == OPEN) | (code == OPEN_HOT)]
        hot = (code[entry[of]] == OPEN_HOT) if len(of) else np.zeros(0, bool)
        whole, cut = of[~hot], of[hot]
        n = x.n[cut]
        each = np.repeat(x.at[cut] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())
        at = np.concatenate([x.at[whole], each])
        size = np.concatenate([x.n[whole], np.ones(len(each), np.int64)])
        doc = np.concatenate([x.doc[whole], np.repeat(x.doc[cut], n)])
        order = np.argsort(at, kind="stable")
        key = np.empty(len(at), np.uint64)
        content = tk.span_hashes(x.s.buf, at[order], at[order] + x.window, tk.BYTE_SYMBOL)
        key[order] = content
        key[:len(whole)] = x.trigger[whole]
        bucket = bucket_of(key, buckets)
        order = np.argsort(bucket, kind="stable")
        self.at, self.size, self.doc, self.bucket = at[order], size[order], doc[order], bucket[order]


def _suffix_classes(buf: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Class number of ``buf[p:p + window]`` for each of ``at``: the suffix array cut at the
    window, refined eight bytes at a time among ties."""
    size = len(at)
    order = np.arange(size)
    group = np.zeros(size, np.int64)
    steps = list(range(0, window - 7, 8)) + ([window - 8] if window % 8 else []) if window >= 8 else list(range(window))
    word = np.zeros(max(1, len(buf) - 7), np.uint64)
    if window >= 8:
        for i in range(8):
            word = (word << np.uint64(8)) | buf[i:i + len(word)].astype(np.uint64)
    else:
        word = buf
    for d in steps:
        if d == steps[0]:
            idx = np.arange(size)
        else:
            same = group[1:] == group[:-1]
            tied = np.zeros(size, bool)
            tied[1:] |= same
            tied[:-1] |= same
            idx = np.flatnonzero(tied)
        if not len(idx):
            break
        key = word[at[order[idx]] + d]
        sub = np.lexsort((key, group[idx]))
        order[idx] = order[idx[sub]]
        k, g = key[sub], group[idx]  # groups stay where they are, members are sorted within
        new = np.zeros(size, bool)
        new[1:] = group[1:] != group[:-1]
        split = np.zeros(len(idx), bool)
        split[1:] = (g[1:] == g[:-1]) & (k[1:] != k[:-1])
        new[idx[split]] = True
        group = np.cumsum(new)
    out = np.empty(size, np.int64)
    out[order] = group
    return out


def _pack(x: _Open, raw: np.ndarray, window: int):
    def pack(c: slice) -> bytes:
        at, n = x.at[c], x.size[c]
        m = len(at)
        text = b"".join([raw[a:a + k + window - 1].tobytes() for a, k in zip(at.tolist(), n.tolist(), strict=True)])
        return np.int64(m).tobytes() + x.doc[c].tobytes() + n.astype(np.int32).tobytes() + text
    return pack


def _dictionary_answer(window: int):
    def answer(payloads: list[bytes]) -> list[bytes]:
        docs, sizes, texts, counts = [], [], [], []
        for p in payloads:
            m = int(np.frombuffer(p, np.int64, 1)[0])
            docs.append(np.frombuffer(p, np.int64, m, 8))
            sizes.append(np.frombuffer(p, np.int32, m, 8 + 8 * m).astype(np.int64))
            texts.append(np.frombuffer(p, np.uint8, offset=8 + 12 * m))
            counts.append(int(sizes[-1].sum()))
        n, buf = np.concatenate(sizes), np.concatenate(texts)
        base = np.concatenate([[0], np.cumsum(n + window - 1)[:-1]])
        starts = np.repeat(base - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        doc = np.repeat(np.concatenate(docs), n)
        klass = _suffix_classes(buf, starts, window)
        least = np.full(int(klass.max()) + 1, NO_ID, np.int64)
        np.minimum.at(least, klass, doc)
        earlier = least[klass] < doc
        return [np.packbits(e).tobytes() for e in np.split(earlier, np.cumsum(counts)[:-1])]
    return answer


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` has the bytes that stay."""
    shards: Shards = write_shards(docs, id_col, text_col, shard_bytes)
    buckets = shards.buckets

    def count(s: Shard):
        x = _Parse(s, window, gram)
        yield from census_blobs(s.shard, x.trigger, x.row, buckets)[1]

    shared = exchange(shard_pass(shards, [], count, BLOBS), census_answer, "triggers")

    def parse(s: Shard):
        x = _Parse(s, window, gram)
        distinct = np.unique(x.trigger)
        x.keep(census_read(distinct, s.answers[0], buckets)[np.searchsorted(distinct, x.trigger)])
        return x, *x.entries()

    def send_phrases(s: Shard):
        x, h, _, first = parse(s)
        e = np.empty(len(first), _PHRASE)
        e["trigger"], e["phrase"], e["doc"] = x.trigger[first], h[first], x.doc[first]
        yield from blobs(s.shard, bucket_of(e["trigger"], buckets), buckets, lambda c: e[c].tobytes())

    settled = exchange(shard_pass(shards, [shared], send_phrases, BLOBS), lambda p: _parse_answer(p, hot), "phrases")

    def open_phrases(s: Shard):
        x, h, entry, first = parse(s)
        code = _answers(bucket_of(x.trigger[first], buckets), buckets, s.answers[1])
        return x, entry, first, code, _Open(x, h, entry, first, code, buckets)

    def send_dictionary(s: Shard):
        o = open_phrases(s)[-1]
        yield from blobs(s.shard, o.bucket, buckets, _pack(o, s.buf, window))

    suffixes = exchange(shard_pass(shards, [shared, settled], send_dictionary, BLOBS), _dictionary_answer(window), "dictionary")

    def remove(s: Shard):
        x, entry, first, code, o = open_phrases(s)
        size = len(s.buf)
        flags = np.zeros(size, bool)
        # Windows of the dictionary's entries, as answered.
        cut = np.searchsorted(o.bucket, np.arange(buckets + 1))
        for b, bits in s.answers[2].items():
            at, n = o.at[cut[b]:cut[b + 1]], o.size[cut[b]:cut[b + 1]]
            where = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            flags[where] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(where)).astype(bool)
        # Other phrases of an entry: all windows if a smaller document has it, else as the entry's own.
        lead = first[entry] if len(entry) else entry
        gone = (code[entry] == SETTLED) | (x.doc > x.doc[lead])
        d = np.zeros(size + 1, np.int32)
        np.add.at(d, x.at[gone], 1)
        np.add.at(d, x.at[gone] + x.n[gone], -1)
        copies = np.flatnonzero(~gone & (lead != np.arange(len(lead))) & (code[entry] >= OPEN))
        for i in copies.tolist():
            flags[x.at[i]:x.at[i] + x.n[i]] |= flags[x.at[lead[i]]:x.at[lead[i]] + x.n[lead[i]]]
        flags |= np.cumsum(d[:-1]) > 0
        removed = tk.cover(flags, size, window) if size else flags
        c = np.concatenate([[0], np.cumsum(removed)])
        kept_off = s.off - c[s.off]
        kept = s.buf[~removed].tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(s.ids, pa.int64(), mask=s.ids == NO_ID), pa.array(np.diff(s.off), pa.int64()),
             pa.array(c[s.off[1:]] - c[s.off[:-1]], pa.int64()),
             pa.array(tk.runs(removed, s.off) if size else np.zeros(len(s.ids), np.int64), pa.int64()),
             pa.array([kept[a:b] for a, b in zip(kept_off[:-1].tolist(), kept_off[1:].tolist(), strict=True)], pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return shard_pass(shards, [shared, settled, suffixes], remove,
                      "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
