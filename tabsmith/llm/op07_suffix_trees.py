"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix here starts at a word and is cut at ``window`` words; a node of the
suffix tree at that depth with leaves in two documents is a repeat.  The tree is
never built whole:

1. Leaves that can't end in such a node are dropped.  Every window has a trigger
   (the smallest hash of its k-word grams), equal windows have equal triggers,
   and a trigger that one document alone holds proves the windows above it unique.
2. Vertical partitioning: suffixes are split by variable-length prefixes.  A
   census counts them by cells of their first four words, and of their first
   eight; a cell of more than ``group_suffixes`` is split by the longer prefix, and
   that again by the whole window, so that every group fits a task.  Suffixes of
   equal words are one leaf a shard, with its smallest document.
3. Each group's subtree: suffixes sorted by their edges (words 1-4, 5-8, the rest)
   with the depth they share with their neighbour; nodes at full depth are the deep
   internal nodes, their smallest document decides.  Runs of neighbouring flagged
   windows of a document are the maximal repeats, and their words are removed.

Edges are compared as hashes (32 + 32 + 64 bits beside the bucket).

Defined results: null or empty texts have no words; documents of fewer words than
the window keep all; rows that share an id never remove each other's words; a null id
counts as larger than every other; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import materialize
from . import textkit as tk
from .shards import (BLOBS, NO_ID, SHARD_BYTES, Shard, Shards, blobs, bucket_of, census_answer, census_blobs, census_read,
                     exchange, shard_pass, write_shards)

WINDOW = 13
GRAM = 5
PREFIX = (4, 8)               # words of the first two prefix lengths
GROUP_SUFFIXES = 1_000_000    # suffixes that one group may hold
_WORD = tk.space_words()


class _Suffixes:
    """Words, suffix starts and edges of one shard."""

    def __init__(self, s: Shard, window: int, gram: int):
        self.start, self.end, self.woff = tk.words(s.buf, s.off, _WORD)
        self.words = tk.span_hashes(s.buf, self.start, self.end, tk.BYTE_SYMBOL)
        self.valid = tk.valid_starts(self.woff, window)
        self.trigger = tk.triggers(self.words, window, gram)
        self.window = window
        self.ids = s.ids

    def doc_id(self, at: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.woff, at, "right") - 1]

    def census(self) -> tuple[np.ndarray, np.ndarray]:
        """Triggers (a run of windows with the same one counts once) and their documents."""
        head = self.valid.copy()
        head[1:] &= ~(self.valid[:-1] & (self.trigger[1:] == self.trigger[:-1]))
        at = np.flatnonzero(head)
        return self.trigger[at], np.searchsorted(self.woff, at, "right") - 1

    def edges(self, shared: np.ndarray, distinct: np.ndarray):
        """Starts of suffixes with a shared trigger; their prefixes' and windows' hashes."""
        at = np.flatnonzero(self.valid)
        at = at[shared[np.searchsorted(distinct, self.trigger[at])]]
        near = [tk.rolling(self.words, n)[at] if len(at) else np.zeros(0, np.uint64) for n in (*PREFIX, self.window)]
        return at, near


def _leaves(x: _Suffixes, shared, distinct, buckets: int, split: tuple[np.ndarray, np.ndarray]):
    """One leaf for suffixes of equal words: bucket by variable-length prefix, edges, smallest document."""
    at, (e0, e1, whole) = x.edges(shared, distinct)
    deep0 = split[0][bucket_of(e0, len(split[0]))]
    deep1 = deep0 & split[1][bucket_of(e1, len(split[1]))]
    bucket = bucket_of(np.where(deep1, whole, np.where(deep0, e1, e0)), buckets)
    ids = x.doc_id(at)
    order = np.lexsort((ids, whole, bucket))
    w, b = whole[order], bucket[order]
    head = np.ones(len(order), bool)
    head[1:] = (w[1:] != w[:-1]) | (b[1:] != b[:-1])
    first = order[head]
    leaf = np.empty(len(order), np.int64)
    leaf[order] = np.cumsum(head) - 1
    return at, ids, leaf, bucket[first], e0[first].astype(np.uint32), e1[first].astype(np.uint32), whole[first], ids[first]


_LEAF = np.dtype([("e0", np.uint32), ("e1", np.uint32), ("whole", np.uint64), ("doc", np.int64)])


def _subtree(payloads: list[bytes]) -> list[bytes]:
    """Builds a group's subtree; answers each leaf whether a smaller document ends in its deepest node."""
    parts = [np.frombuffer(p, _LEAF) for p in payloads]
    leaf = np.concatenate(parts)
    order = np.lexsort((leaf["doc"], leaf["whole"], leaf["e1"], leaf["e0"]))
    s = leaf[order]
    # Depth shared with the neighbour above, in edges: 3 is a node at full depth.
    shared = np.zeros(len(s), np.int8)
    same = np.ones(max(0, len(s) - 1), bool)
    for edge in ("e0", "e1", "whole"):
        same &= s[edge][1:] == s[edge][:-1]
        shared[1:] += same
    node = np.flatnonzero(shared < len(_LEAF) - 1)
    smallest = np.repeat(s["doc"][node], np.diff(np.concatenate([node, [len(s)]])))
    earlier = np.empty(len(s), bool)
    earlier[order] = smallest < s["doc"]
    out, i = [], 0
    for p in parts:
        out.append(np.packbits(earlier[i:i + len(p)]).tobytes())
        i += len(p)
    return out


def _flags(x: _Suffixes, shared, distinct, buckets: int, split, answers: dict[int, bytes]) -> np.ndarray:
    """Windows that also start in a smaller document."""
    at, ids, leaf, bucket, _, _, _, doc = _leaves(x, shared, distinct, buckets, split)
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    earlier = np.zeros(len(bucket), bool)
    for b, bits in answers.items():
        earlier[cut[b]:cut[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=cut[b + 1] - cut[b])
    out = np.zeros(len(x.valid), bool)
    out[at] = earlier[leaf] | (doc[leaf] < ids)
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     gram: int = GRAM, group_suffixes: int = GROUP_SUFFIXES,
                     shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, repeats, kept): maximal repeats as word spans, and the
    kept words joined by one space (bytes)."""
    shards: Shards = write_shards(docs, id_col, text_col, shard_bytes)
    buckets = shards.buckets
    cells = 8 * buckets

    def count(s: Shard):
        x = _Suffixes(s, window, gram)
        trig, doc = x.census()
        for b in census_blobs(s.shard, trig, doc, buckets)[1]:
            yield b.append_column("n0", pa.nulls(b.num_rows, pa.int64())).append_column("n1", pa.nulls(b.num_rows, pa.int64()))
        at = np.flatnonzero(x.valid)
        n0, n1 = (np.bincount(bucket_of(tk.rolling(x.words, n)[at], cells), minlength=cells) if len(at) else np.zeros(cells, int) for n in PREFIX)
        some = np.flatnonzero(n0 + n1)
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(some, pa.int32()), "shard": pa.nulls(len(some), pa.int64()), "payload": pa.nulls(len(some), pa.binary()),
            "n0": pa.array(n0[some], pa.int64()), "n1": pa.array(n1[some], pa.int64())})

    first = materialize(shard_pass(shards, [], count, f"{BLOBS}, n0 long, n1 long"), "prefixes")
    heavy = (first.filter("shard is null").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
             .filter((F.col("n0") > group_suffixes) | (F.col("n1") > group_suffixes)).collect())  # cells at most
    split = np.zeros(cells, bool), np.zeros(cells, bool)
    for r in heavy:
        split[0][r.bucket], split[1][r.bucket] = r.n0 > group_suffixes, r.n1 > group_suffixes
    shared = exchange(first.filter("shard is not null").select("bucket", "shard", "payload"), census_answer, "triggers")

    def read(s: Shard):
        x = _Suffixes(s, window, gram)
        distinct = np.unique(x.census()[0])
        return x, census_read(distinct, s.answers[0], buckets), distinct

    def send(s: Shard):
        x, got, distinct = read(s)
        _, _, _, bucket, e0, e1, whole, doc = _leaves(x, got, distinct, buckets, split)
        leaf = np.empty(len(bucket), _LEAF)
        leaf["e0"], leaf["e1"], leaf["whole"], leaf["doc"] = e0, e1, whole, doc
        yield from blobs(s.shard, bucket, buckets, lambda c: leaf[c].tobytes())

    nodes = exchange(shard_pass(shards, [shared], send, BLOBS), _subtree, "subtrees")

    def remove(s: Shard):
        x, got, distinct = read(s)
        n = len(x.start)
        gone = tk.cover(_flags(x, got, distinct, buckets, split, s.answers[1]), n, window) if n else np.zeros(0, bool)
        c = np.concatenate([[0], np.cumsum(gone)])
        raw = s.buf.tobytes()
        kept, spans = [], []
        for a, b in zip(x.woff[:-1].tolist(), x.woff[1:].tolist(), strict=True):
            if c[a] == c[b]:
                stay = range(a, b)
                spans.append([])
            else:
                stay = (np.flatnonzero(~gone[a:b]) + a).tolist()
                edge = np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))
                spans.append([{"first": f, "last": t - 1} for f, t in
                              zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)])
            kept.append((x.start[stay], x.end[stay]) if len(stay) else ())
        texts = [b" ".join([raw[i:j] for i, j in zip(k[0].tolist(), k[1].tolist(), strict=True)]) if k else b"" for k in kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array(s.ids, pa.int64(), mask=s.ids == NO_ID), pa.array(np.diff(x.woff), pa.int64()),
             pa.array(c[x.woff[1:]] - c[x.woff[:-1]], pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(texts, pa.binary())],
            names=["doc_id", "n_words", "n_removed", "repeats", "kept"])

    return shard_pass(shards, [shared, nodes], remove,
                      "doc_id long, n_words long, n_removed long, repeats array<struct<first:long,last:long>>, kept binary")
