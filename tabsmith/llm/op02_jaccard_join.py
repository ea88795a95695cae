"""Jaccard join of shingle sets: size-aware heavy-light join.

Sets of equal shingles are one class.  A shingle that one document alone holds can't
be shared, so a class links only if ``similarity`` of its shingles are held elsewhere
(counted over all documents by the fingerprint exchange); other classes need no search.

* Light classes (size up to a boundary) enumerate fixed-size subsets: two sets of s and
  t shingles link when they share a subset of ``need(s, t)`` shingles, so every set
  emits its subsets of the sizes that its partners need.  Sets under one subset link
  with the smallest of them, which joins all that link there.
* Heavy classes scan inverted lists.  The global order puts shingles that one document
  holds first, then the others by hash; two sets that link share one of their first
  ``n - ceil(similarity n) + 1`` shingles.  First every class is compared with one hub of
  its lists (linear), which settles groups of near copies; then lists are scanned
  for pairs that are still in different components, by size, position and parity
  bounds.  Candidates are verified on the whole sets.
* The boundary minimises (subsets emitted up to it + postings scanned beyond it), from
  counts by size.

All pairs within a group are never emitted where a chain of links joins it; the result
is the component of every document, and no link between different sets is lost.

Defined results: without words or text a set is empty and links with nothing; with
fewer words than a shingle the whole sequence is the only one; rows that share an id are
one node; a null id has no component and links with nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import materialize
from . import textkit as tk
from .graph import components
from .shards import (BLOBS, NO_ID, SHARD_BYTES, Shard, Shards, census_answer, census_blobs, census_read, exchange,
                     shard_pass, write_shards)

SHINGLE = 4
SIMILARITY = (17, 20)   # 0.85 as a fraction: 100 * intersection >= 85 * union
SEARCHED_SIZES = 48     # boundaries that the cost rule weighs: 0 to this
PARITY = 8              # longs of parity bits: sets differ in at least as many shingles as parities
_WORD = tk.space_words()


def need(s: int, t: int, sim: tuple[int, int] = SIMILARITY) -> int:
    """Shingles that sets of ``s`` and ``t`` must share to link."""
    return -(-sim[0] * (s + t) // (sim[0] + sim[1]))


def partners(s: int, sim: tuple[int, int] = SIMILARITY) -> range:
    return range(-(-sim[0] * s // sim[1]), sim[1] * s // sim[0] + 1)


def subset_sizes(s: int, largest: int, sim: tuple[int, int] = SIMILARITY) -> list[int]:
    return sorted({need(s, t, sim) for t in partners(s, sim) if t <= largest and need(s, t, sim) <= s})


def prefix(n: int, sim: tuple[int, int] = SIMILARITY) -> int:
    return n - -(-sim[0] * n // sim[1]) + 1


class _Sets:
    """Distinct shingles of each document of a shard, sorted within the document."""

    def __init__(self, s: Shard, shingle: int):
        low = tk.LOWER[s.buf]
        start, end, woff = tk.words(low, s.off, _WORD)
        h = tk.span_hashes(low, start, end, tk.BYTE_SYMBOL)
        at = np.flatnonzero(tk.valid_starts(woff, shingle))
        token = tk.rolling(h, shingle)[at] if len(at) else np.zeros(0, np.uint64)
        row = np.searchsorted(woff, at, "right") - 1
        count = np.diff(woff)
        short = np.flatnonzero((count > 0) & (count < shingle))
        whole = tk.span_hashes(h, woff[short], woff[short + 1])
        token, row = np.concatenate([token, whole]), np.concatenate([row, short])
        order = np.lexsort((token, row))
        token, row = token[order], row[order]
        head = np.ones(len(token), bool)
        head[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
        self.token, self.row = token[head], row[head]
        self.off = np.searchsorted(self.row, np.arange(len(s.ids) + 1))


def _parity(token: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 64 * PARITY bins."""
    slot = (tk.mix64(token) >> np.uint64(40)).astype(np.int64) % (64 * PARITY)
    return np.packbits(np.bincount(slot, minlength=64 * PARITY).astype(np.uint8) & 1).view(np.int64)


def _signatures(cols: dict[str, list], boundary: int, sim: tuple[int, int]):
    """Rows (key, size, pos, rep, n): subsets of light sets (size > 0), prefix postings of heavy ones (size 0)."""
    out: list[tuple[np.ndarray, ...]] = []
    for rep, n, own, data in zip(cols["rep"], cols["n"], cols["own"], cols["tokens"], strict=True):
        token = np.frombuffer(data, np.uint64)
        if n <= boundary:
            total = token.sum(dtype=np.uint64)
            for size in subset_sizes(n, boundary, sim):
                gone = n - size
                if gone:
                    pick = np.array(list(combinations(range(n), gone)))
                    key = total - token[pick].sum(axis=1, dtype=np.uint64)
                else:
                    key = np.array([total])
                key = tk.mix64(key + np.uint64(size * tk.MULT & ((1 << 64) - 1)))
                out.append((key, np.full(len(key), size), np.zeros(len(key), int), rep, n))
        if n >= partners(boundary + 1, sim)[0]:
            key = token[own:prefix(n, sim)]
            out.append((key, np.zeros(len(key), int), np.arange(own, own + len(key)), rep, n))
    if out:
        k = [len(x[0]) for x in out]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([x[0] for x in out]).view(np.int64)), pa.array(np.concatenate([x[1] for x in out]), pa.int32()),
             pa.array(np.concatenate([x[2] for x in out]), pa.int32()), pa.array(np.repeat([x[3] for x in out], k), pa.int64()),
             pa.array(np.repeat([x[4] for x in out], k), pa.int32())], names=["key", "size", "pos", "rep", "n"])


def _emit(sets: DataFrame, boundary: int, sim: tuple[int, int]) -> DataFrame:
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                yield from _signatures(b.slice(i, 2000).to_pydict(), boundary, sim)
    return sets.select("rep", "n", "own", "tokens").mapInArrow(run, "key long, size int, pos int, rep long, n int")


def _verify(pairs: DataFrame, sets: DataFrame, sim: tuple[int, int]) -> DataFrame:
    """Links (a, b) among ``pairs``, on the whole sets."""
    one = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))

    def run(batches):
        for b in batches:
            a, c = b.column("a").to_pylist(), b.column("b").to_pylist()
            ok = []
            for x, y in zip(b.column("ta"), b.column("tb"), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = np.sort(np.concatenate([u, v]))
                ok.append(int((both[1:] == both[:-1]).sum()) >= need(len(u), len(v), sim))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(a, ok, strict=True) if k], pa.int64()),
                                              pa.array([x for x, k in zip(c, ok, strict=True) if k], pa.int64())], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def boundary_by_cost(sets: DataFrame, sim: tuple[int, int], most: int = SEARCHED_SIZES) -> int:
    """Largest light size: subsets emitted up to it against postings scanned beyond it."""
    small = sets.filter(F.col("n") <= most)
    counts = {r.n: r.c for r in small.groupBy("n").agg(F.count("*").alias("c")).collect()}  # most rows at most
    posts = _emit(small, 0, sim).filter("size = 0")
    lists = posts.groupBy("key").agg(F.count("*").alias("c"))
    scans = {r.n: r.s for r in posts.join(lists, "key").groupBy("n").agg(F.sum("c").alias("s")).collect()}

    def cost(edge: int) -> int:
        light = sum(c * sum(comb(n, o) for o in subset_sizes(n, edge, sim)) for n, c in counts.items() if n <= edge)
        return light + sum(s for n, s in scans.items() if n > edge)

    return min(range(most + 1), key=cost)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 similarity: tuple[int, int] = SIMILARITY, boundary: int | None = None,
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every document; class_id is the
    smallest id with the same set."""
    sim = similarity
    shards: Shards = write_shards(docs, id_col, text_col, shard_bytes)
    buckets = shards.buckets

    def count(s: Shard):
        x = _Sets(s, shingle)
        yield from census_blobs(s.shard, x.token, x.row, buckets)[1]

    shared = exchange(shard_pass(shards, [], count, BLOBS), census_answer, "shingles")

    def describe(s: Shard):
        x = _Sets(s, shingle)
        u, at = np.unique(x.token, return_inverse=True)
        held = census_read(u, s.answers[0], buckets)[at]
        n = np.diff(x.off)
        classes, own, tokens, parity, seen = [], [], [], [], set()
        for d, (a, b) in enumerate(zip(x.off[:-1].tolist(), x.off[1:].tolist(), strict=True)):
            name = hashlib.blake2b(x.token[a:b].tobytes(), digest_size=16).digest() if b > a and s.ids[d] != NO_ID else None
            both = held[a:b]
            alone = int(b - a - both.sum())
            search = name is not None and name not in seen and sim[1] * (b - a - alone) >= sim[0] * (b - a)
            if search:
                seen.add(name)
            classes.append(name)
            own.append(alone)
            tokens.append(np.concatenate([x.token[a:b][~both], x.token[a:b][both]]).tobytes() if search else None)
            parity.append(_parity(x.token[a:b]).tolist() if search else None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(s.ids, pa.int64(), mask=s.ids == NO_ID), pa.array(n, pa.int32()), pa.array(classes, pa.binary()),
             pa.array(own, pa.int32()), pa.array(parity, pa.list_(pa.int64())), pa.array(tokens, pa.binary())],
            names=["doc_id", "n", "class", "own", "parity", "tokens"])

    described = materialize(shard_pass(shards, [shared], describe, 
                                       "doc_id long, n int, class binary, own int, parity array<long>, tokens binary"), "sets")
    reps = described.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"))
    searched = described.filter("tokens is not null").select(
        "class", "n", "own", *[F.col("parity")[i].alias(f"p{i}") for i in range(PARITY)], "tokens").dropDuplicates(["class"])
    sets = materialize(searched.join(reps, "class").drop("class"), "classes")
    # An id that stands in several classes joins them.
    several = described.filter("doc_id is not null").select("doc_id", F.xxhash64("class").alias("h")).groupBy("doc_id").agg(
        F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("doc_id")
    same = described.select("doc_id", "class").join(several, "doc_id").join(reps, "class").select(
        F.col("rep").alias("a"), F.col("doc_id").alias("b")).filter("a <> b").distinct()
    if boundary is None:
        boundary = boundary_by_cost(sets, sim)
    keys = materialize(_emit(sets, boundary, sim), "keys")

    # Light: all sets under one subset link with the smallest of them.
    light = keys.filter("size > 0")
    hubs = light.groupBy("key", "size").agg(F.min(F.struct("n", "rep")).alias("hub"), F.count("*").alias("c")).filter("c > 1")
    links = light.join(hubs, ["key", "size"]).filter(
        (F.col("n") + F.col("hub.n")) * sim[0] <= F.col("size") * (sim[0] + sim[1])).select(
        F.col("rep").alias("a"), F.col("hub.rep").alias("b")).filter("a <> b").distinct()

    # Heavy, first: every class against the hub that it shares most lists with, among like sizes.
    heavy = keys.filter("size = 0").drop("size")
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(sim[1] / sim[0])))
    listed = heavy.withColumn("band", band)
    lists = listed.groupBy("key", "band").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).filter("c > 1")
    best = (listed.join(lists.drop("c"), ["key", "band"]).filter("rep <> hub").groupBy("rep", "hub").agg(F.count("*").alias("c"))
            .groupBy("rep").agg(F.max_by("hub", "c").alias("hub")))
    first = materialize(_verify(best.toDF("a", "b"), sets, sim).unionByName(links).unionByName(same), "links")
    label = components(first)

    # Then: pairs that still are in different components, by the first shared posting's bounds.
    known = heavy.join(label.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    parity = [f"p{i}" for i in range(PARITY)]
    open_ = materialize(known.join(mixed, "key").join(sets.select("rep", *parity), "rep"), "open")
    x, y = open_.alias("x"), open_.alias("y")
    least = F.ceil((F.col("x.n") + F.col("y.n")) * sim[0] / float(sim[0] + sim[1]) - 1e-9)
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    differ = sum((F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in parity), F.lit(0))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component"))
                   & (F.col("x.n") * sim[0] <= F.col("y.n") * sim[1]) & (F.col("y.n") * sim[0] <= F.col("x.n") * sim[1])
                   & (room >= least) & (differ <= F.col("x.n") + F.col("y.n") - 2 * least)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    rest = _verify(materialize(pairs, "pairs"), sets, sim)
    label = components(materialize(rest.unionByName(first), "links"))

    out = described.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class").join(reps, "class", "left")
    out = out.join(label.toDF("node", "component_id"), F.coalesce("rep", "doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"),
                      F.coalesce("component_id", "rep", "doc_id").alias("component_id"))
