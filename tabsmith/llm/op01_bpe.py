"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are cut by the vocabulary's pattern; the encoding of a piece depends on
the piece alone.  Each task therefore gathers the distinct pieces of its texts
and replays the merges on that small corpus once: an inverted index maps the pairs
(by the rank of their merge, ranks in rising blocks) to the positions that hold them,
merges are applied in rank order, in all words at once and left to right, and only the
pairs that touch a merged position are looked up again.  Encoded pieces are remembered across
batches up to a bound; beyond it the memory is emptied, results don't change.
No shuffle: memory is that of one slice of texts plus the bounded memory.

Defined results: a null or empty text has no tokens; every text is encoded as
ordinary text (no special tokens); repeated rows give repeated rows; other
columns are not read, so their names can't clash.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import release

SLICE_BYTES = 2 << 20      # texts handled at a time (one longer text is a slice of its own)
REMEMBERED = 600_000       # distinct pieces that a task remembers
LONG_PIECE = 1000          # longer pieces are not remembered
ID_BITS = 20               # of a token id, so that a pair is one number
FIRST_BLOCK = 7            # the first block holds 2^(FIRST_BLOCK + 1) ranks, each further one twice as many
MAX_VOCABULARY = 64 << 20  # bytes of a rank file that may be sent to all tasks


class Vocabulary:
    """Ranks of a tiktoken rank file, read once on the driver and sent with the tasks."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            raw = f.read(MAX_VOCABULARY + 1)
        if len(raw) > MAX_VOCABULARY:
            raise ValueError(f"rank file over {MAX_VOCABULARY} bytes")
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.pattern = pattern


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class MergeReplay:
    """Encodes distinct pieces; lives in one Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.by_text = {str(v): k for k, v in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        two = np.full((256, 256), -1, np.int64)
        for t, r in ranks.items():
            if len(t) == 2:
                two[t[0], t[1]] = r
        self.two = two
        size = max(ranks.values()) + 1
        if size > 1 << ID_BITS:
            raise ValueError(f"a vocabulary of more than {1 << ID_BITS} ids")
        pairs = sorted((ranks[t[:i]] << ID_BITS | ranks[t[i:]], r) for t, r in ranks.items()
                       for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pair_keys, self.pair_ranks = np.array(pairs or [(-1, -1)], np.int64).T.copy()
        halves = np.stack([self.pair_keys >> ID_BITS, self.pair_keys & ((1 << ID_BITS) - 1)])
        self.alone = np.zeros(size, bool)         # tokens that make a pair of smaller rank: that one may go before the next of theirs
        self.alone[halves[halves > self.pair_ranks]] = True
        self.block_of = np.maximum(np.log2(np.arange(size) + 1).astype(np.int64) - FIRST_BLOCK, 0)
        self.blocks = int(self.block_of[-1]) + 1
        self.known: dict[str, str] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each two tokens, -1 where there is none."""
        key = left << ID_BITS | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def replay(self, pieces: list[bytes]) -> list[str]:
        """Token ids of each piece (decimal, comma-joined): merges in rank order over all pieces at once.

        The index holds, for each block of ranks, the positions whose pair has such a rank.  Blocks come in
        rank order; in a block every word merges its smallest rank, left to right, until none of the block
        is left.  Pairs beside a merge are looked up again and go to the index of their block."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        size, count = len(raw), np.array([len(p) for p in pieces])
        ends = np.cumsum(count)
        word = np.repeat(np.arange(len(pieces)), count)
        tok = self.byte_id[raw]
        pair = np.full(size, -1, np.int64)       # rank of the pair that starts at a position
        pair[:-1] = self.two[raw[:-1], raw[1:]]
        pair[ends - 1] = -1
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        dead = np.zeros(size, bool)
        index: list[list[np.ndarray]] = [[] for _ in range(self.blocks)]

        def put(at: np.ndarray, least: int) -> None:
            at = at[pair[at] >= 0]
            block = self.block_of[pair[at]]
            for k in np.unique(block[block >= least]).tolist():
                index[k].append(at[block == k])

        put(np.arange(size), 0)
        for k in range(self.blocks):
            at = _distinct(np.concatenate([np.zeros(0, np.int64), *index[k]]))
            at = at[(pair[at] >= 0) & (self.block_of[pair[at]] == k)]
            while len(at):
                rank, own = pair[at], word[at]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(at))))
                hit = rank == least
                p, r = at[hit], rank[hit]
                place = np.arange(len(p))        # of overlapping pairs every second one, from the left
                run = np.concatenate([[True], after[p[:-1]] != p[1:]])
                keep = (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0
                keep &= ~self.alone[r] | np.concatenate([[True], word[p[1:]] != word[p[:-1]]])
                p, r = p[keep], r[keep]
                q = after[p]
                tok[p], pair[q], dead[q] = r, -1, True
                a = after[q]
                after[p] = a
                inner = a >= 0
                before[a[inner]] = p[inner]
                pair[p] = -1
                pair[p[inner]] = self._rank(r[inner], tok[a[inner]])
                b = before[p]
                inner = b >= 0
                b = b[inner]
                pair[b] = self._rank(tok[b], r[inner])
                put(np.concatenate([p, b]), k + 1)
                at = np.concatenate([at, b])
                at = at[pair[at] >= 0]
                at = _distinct(at[self.block_of[pair[at]] <= k])
        alive = np.flatnonzero(~dead)
        ids = list(map(str, tok[alive].tolist()))
        cut = np.searchsorted(alive, ends).tolist()
        return [",".join(ids[i:j]) for i, j in zip([0, *cut[:-1]], cut, strict=True)]

    def encode(self, texts: list[str]) -> list[str]:
        """Ids of each text as decimal numbers joined by commas."""
        cut = [self.find(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, ranks = self.known, self.ranks
        fresh = [p for p in set().union(*cut) if p not in known]
        rest, own = [], dict.fromkeys(())
        for p in fresh:
            b = p.encode()
            r = ranks.get(b)
            if r is not None:
                known[p] = str(r)
            else:
                rest.append((p, b))
        if rest:
            for (p, _), ids in zip(rest, self.replay([b for _, b in rest]), strict=True):
                known[p] = ids
                if len(p) > LONG_PIECE:
                    own[p] = None
        out = [",".join([known[p] for p in c]) for c in cut]
        for p in own:
            del known[p]
        return out

    def decode(self, ids: str) -> bytes:
        return b"".join([self.by_text[i] for i in ids.split(",")]) if ids else b""


_WORKER: dict[int, MergeReplay] = {}


def _worker(token: int, vocabulary) -> MergeReplay:
    if token not in _WORKER:
        _WORKER.clear()
        _WORKER[token] = MergeReplay(vocabulary.value.ranks, vocabulary.value.pattern)
    return _WORKER[token]


def _slices(text: list[str | None]) -> Iterator[tuple[int, int]]:
    i = size = 0
    for j, t in enumerate(text):
        size += len(t or "")
        if size > SLICE_BYTES:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(text):
        yield i, len(text)


def _map(docs: DataFrame, vocabulary: Vocabulary, steps: str, id_col: str, in_col: str, schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    token = sent._jbroadcast.id()

    def run(batches):
        bpe = _worker(token, sent)
        gc.disable()  # many small lists, no cycles: passes over the remembered pieces only cost time
        try:
            for b in batches:
                given = b.column(1).to_pylist()
                for i, j in _slices(given):
                    part = [t or "" for t in given[i:j]]
                    cols = [b.column(0).slice(i, j - i)]
                    ids = bpe.encode(part) if "e" in steps else part
                    if "e" in steps:
                        cols += [pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()), pa.array(ids, pa.string())]
                    if "d" in steps:
                        cols.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in schema.split(", ")])
        finally:
            bpe.known = {}
            gc.enable()
            release()

    return docs.select(F.col(id_col).cast("long"), F.col(in_col).cast("string")).mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as decimal numbers joined by commas."""
    return _map(docs, vocabulary, "e", id_col, text_col, "doc_id long, n_tokens long, ids string")


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the bytes that the ids stand for."""
    return _map(encoded, vocabulary, "d", id_col, ids_col, "doc_id long, decoded binary")


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both in one pass: (doc_id, n_tokens, ids, decoded)."""
    return _map(docs, vocabulary, "ed", id_col, text_col, "doc_id long, n_tokens long, ids string, decoded binary")
