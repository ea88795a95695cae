"""Benchmark decontamination with training suffix arrays.

Each task builds the suffix array of its documents: word positions ordered by
the words that follow (13 at most, the window), documents end-marked.  Every
test suffix is binary-searched in every shard's array, which gives its longest
verbatim match and all places of it.  The test side is sent to the tasks in
blocks of bounded size, one pass each, so a benchmark of any size works; the
documents are never shuffled.

Before sorting, positions are dropped whose first words start no test suffix
of the block (they can't be found by any search), which leaves the searches'
results as they are.

Defined results: null or empty texts have no words; an item or document without
words matches nothing; repeated item texts count as items each; equal rows are
judged each on its own; null ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import materialize
from . import textkit as tk
from .shards import Shard, from_batch

WINDOW = 13
SLICE_BYTES = 2 << 20     # documents of one suffix array (one longer document is a slice of its own)
BLOCK_BYTES = 16 << 20    # benchmark text sent to the tasks at a time
_WORD = tk.plain_words()


@dataclass
class TestBlock:
    """Distinct test windows of a block: word hashes (n, window; 0 beyond the end), lengths, and the items of each."""
    grid: np.ndarray
    length: np.ndarray
    items: list[list[str]]
    window: int


def _word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = tk.LOWER[buf]
    start, end, woff = tk.words(low, off, _WORD)
    h = tk.span_hashes(low, start, end, tk.BYTE_SYMBOL)
    h[h == 0] = 1  # 0 marks the end of a document
    return h, woff


def test_block(rows: list[tuple], window: int = WINDOW) -> TestBlock:
    """Windows of the items ``rows`` (id, text): ``window`` words each, or a shorter item whole."""
    found: dict[bytes, tuple[int, list[str]]] = {}
    for item, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        h, _ = _word_hashes(raw, np.array([0, len(raw)]))
        n = min(len(h), window)
        for i in range(len(h) - n + 1 if n else 0):
            key = h[i:i + n].tobytes().ljust(8 * window, b"\0")
            names = found.setdefault(key, (n, []))[1]
            if not names or names[-1] != str(item):
                names.append(str(item))
    grid = np.frombuffer(b"".join(found), np.uint64).reshape(-1, window)
    return TestBlock(grid, np.array([n for n, _ in found.values()], np.int64), [x for _, x in found.values()], window)


def _compare(words: np.ndarray, at: np.ndarray, grid: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sign of (training suffix at ``at``, cut to the test length) against the test suffix; and words in common."""
    take = words[at[:, None] + np.arange(grid.shape[1])]
    beyond = np.arange(grid.shape[1]) >= length[:, None]
    differ = (take != grid) & ~beyond
    first = np.where(differ.any(1), differ.argmax(1), length)
    col = np.minimum(first, grid.shape[1] - 1)
    row = np.arange(len(at))
    sign = np.where(first >= length, 0, np.where(take[row, col] < grid[row, col], -1, 1))
    return np.stack([sign, first])


def suffix_array(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` in the order of ``words[p:p + depth]``: groups that tie are
    sorted by the next word until none ties or the depth is reached."""
    order = at[np.argsort(words[at], kind="stable")]
    group = np.zeros(len(order), np.int64)
    for d in range(depth):
        key = words[order + d]
        if d:
            tied = np.zeros(len(order), bool)
            same = group[1:] == group[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            idx = np.flatnonzero(tied)
            if not len(idx):
                break
            sub = np.lexsort((key[idx], group[idx]))
            order[idx] = order[idx[sub]]
            key = words[order + d]
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new)
    return order


def search(words: np.ndarray, sa: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every test window: first and one-past-last place in ``sa``, and the longest match in words."""
    def bound(last: bool):
        lo, hi = np.zeros(len(block.grid), np.int64), np.full(len(block.grid), len(sa), np.int64)
        while (open_ := lo < hi).any():
            i = np.flatnonzero(open_)
            mid = (lo[i] + hi[i]) // 2
            sign = _compare(words, sa[mid], block.grid[i], block.length[i])[0]
            right = (sign <= 0) if last else (sign < 0)
            lo[i] = np.where(right, mid + 1, lo[i])
            hi[i] = np.where(right, hi[i], mid)
        return lo

    first, last = bound(False), bound(True)
    longest = np.zeros(len(block.grid), np.int64)
    for near in (first - 1, first):  # the longest match is next to where the suffix would stand
        i = np.flatnonzero((near >= 0) & (near < len(sa)))
        longest[i] = np.maximum(longest[i], _compare(words, sa[near[i]], block.grid[i], block.length[i])[1])
    return first, last, longest


class Matcher:
    """Finds a block's test suffixes in slices of documents."""

    def __init__(self, block: TestBlock):
        self.block = block
        whole = block.length >= 3
        self.firsts = np.unique(block.grid[~whole, 0])       # short windows: by their first word
        self.lead = np.zeros(1 << 22, bool)                  # others: by their first three words
        if whole.any():
            self.lead[self._slot(tk.rolling(block.grid[whole][:, :3].ravel(), 3)[::3])] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(42)).astype(np.int64)

    def matches(self, s: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word offsets of the documents, and per occurrence: word position, test window, words."""
        block, w = self.block, self.block.window
        h, woff = _word_hashes(s.buf, s.off)
        none = np.zeros(0, np.int64)
        if not len(h) or not len(block.grid):
            return woff, none, none, none
        # One 0 after each document's words: a suffix ends there.
        doc = np.searchsorted(woff, np.arange(len(h)), "right") - 1
        words = np.zeros(len(h) + len(s.ids) + w, np.uint64)
        place = np.arange(len(h)) + doc
        words[place] = h
        lead = tk.rolling(words, 3)
        keep = self.lead[self._slot(lead[place])]
        if len(self.firsts):
            keep |= np.isin(h, self.firsts)
        at = place[keep]
        if not len(at):
            return woff, none, none, none
        sa = suffix_array(words, at, w)
        first, last, _ = search(words, sa, block)
        n = last - first
        hit = np.flatnonzero(n)
        if not len(hit):
            return woff, none, none, none
        which = np.repeat(hit, n[hit])
        pos = sa[np.concatenate([np.arange(first[i], last[i]) for i in hit])]
        at_word = np.searchsorted(place, pos)
        return woff, at_word, which, block.length[which]


def _slices(s: Shard, slice_bytes: int) -> Iterator[Shard]:
    i = 0
    while i < len(s.ids):
        j = max(i + 1, int(np.searchsorted(s.off, s.off[i] + slice_bytes, "right")) - 1)
        yield Shard(-1, s.ids[i:j], s.buf[s.off[i]:s.off[j]], s.off[i:j + 1] - s.off[i], s.nulls[i:j])
        i = j


def _judge(matcher: Matcher, s: Shard, before: list[list] | None, items_before: list[list] | None):
    """Per document: words, hit spans (merged, word positions), items."""
    woff, at, which, length = matcher.matches(s)
    spans: list[list[list[int]]] = [list(x or []) for x in before] if before else [[] for _ in s.ids]
    items: list[set[str]] = [set(x or []) for x in items_before] if items_before else [set() for _ in s.ids]
    doc = np.searchsorted(woff, at, "right") - 1
    for d in np.unique(doc):
        own = doc == d
        for i in np.unique(which[own]):
            items[d].update(matcher.block.items[i])
        n = int(woff[d + 1] - woff[d])
        mark = np.zeros(n + 1, np.int64)
        np.add.at(mark, at[own] - woff[d], 1)
        np.add.at(mark, at[own] - woff[d] + length[own], -1)
        for x in spans[d]:
            mark[x["first"]] += 1
            mark[x["last"] + 1] -= 1
        edge = np.diff(np.concatenate([[0], (np.cumsum(mark) > 0).astype(np.int8), [0]]))
        spans[d] = [{"first": int(a), "last": int(b) - 1} for a, b in
                    zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    return np.diff(woff), spans, [sorted(x) for x in items]


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SCHEMA = "n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                 keep: list[str] | None = None, slice_bytes: int = SLICE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) for every document: word spans covered by test
    windows (first and last word) and the items whose windows occur.  With ``keep``, those
    columns of ``docs`` go along."""
    spark = docs.sparkSession
    carry = [c for c in keep or [] if c != id_col]
    names = [f"_c{i}" for i in range(len(carry))]
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"),
                      *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)])
    kinds = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["doc_id", "_text", *names])
    rows = benchmark.select(F.col(item_col), F.col(item_text_col).cast("string")).toLocalIterator()
    block: list[tuple] = []
    size = 0

    def one_pass(df: DataFrame, block: list[tuple]) -> DataFrame:
        sent = spark.sparkContext.broadcast(test_block(block, window))
        more = "spans" in df.columns

        def run(batches):
            matcher = Matcher(sent.value)
            for b in batches:
                whole = from_batch(b.column(0), b.column(1))
                i = 0
                for s in _slices(whole, slice_bytes):
                    j = i + len(s.ids)
                    old = [b.column(b.schema.names.index(c)).slice(i, j - i).to_pylist() for c in ("spans", "items")] if more else [None, None]
                    n, spans, items = _judge(matcher, s, *old)
                    cols = [b.column(k).slice(i, j - i) for k in range(2 + len(names))]
                    yield pa.RecordBatch.from_arrays(
                        [*cols, pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                        names=["doc_id", "_text", *names, "n_words", "spans", "items"])
                    i = j
            tk.release()

        return df.mapInArrow(run, f"{schema}, {_SCHEMA}")

    for item, text in rows:
        if block and size + len(text or "") > block_bytes:
            out = materialize(one_pass(out, block), "matches")
            block, size = [], 0
        block.append((item, text))
        size += len(text or "")
    out = one_pass(out, block)
    back = [F.col(n).alias(c) for c, n in zip(carry, names, strict=True)]
    return out.select("doc_id", *back, "n_words", "spans", "items")


def hit_words() -> F.Column:
    """Number of words in ``spans``."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows of which a twentieth or more of the words lies in test windows."""
    # A clash with the operator's own column names is avoided by nesting the row.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = find_matches(row, benchmark, "id", "text", keep=["row"])
    return found.filter(~contaminated(hit_words(), F.col("n_words"))).select("row.*")
