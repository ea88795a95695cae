"""Cross-tokenizer alignment by galloping intersection of token ends.

Two tokenizers cut the same bytes (a blank and the text).  The ends of a document's
tokens are two rising lists of byte offsets; the list with fewer ends drives the
search: each of its ends starts in the longer list at the place that its rank
suggests, leaps 1, 2, 4, ... entries until the end is bracketed, and finishes by binary
search.  Common ends cut both lists into groups; the difference of two neighbouring
common ranks says how many tokens of either side a group holds, so a group is a range
of token numbers on both sides.  All searches of a slice of texts run in lockstep, as
the offsets of successive documents are stacked.

A token of A and one of B that end together are *linked*.  ``count_links`` counts
every linked id pair over the corpus and rates the documents by those counts.

On Spark: ``align`` is one map without a shuffle.  ``count_links`` writes its rows once
under the shared checkpoint folder, pre-aggregates the pairs of each task, sums them by
pair, and rates the written rows.  Pairs with the highest counts, at most ``SENT_PAIRS``
of them, go to all tasks; rarer pairs, if there are any, are joined by shuffling, where
no key is hot.

Defined results: a null or empty text has no tokens, nor has one whose tokens don't
give back its bytes on both sides (the second vocabulary writes a blank for U+2581): all
numbers are 0 and ``groups`` is ''.  Strings of special tokens are ordinary text.  Repeated
rows count as often as they stand.  An empty table gives an empty table.  Only the id and
the text are read, so other columns can't clash.  Memory: one slice of texts, or one
longer text, with its tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.ordering import materialize
from .textkit import release

SLICE_CHARS = 1 << 20         # texts handled at a time (one longer text is a slice of its own)
COUNTED = 1 << 20             # pairs that a task holds before it passes their counts on
SENT_PAIRS = 500_000          # pairs (17 bytes each) that may be sent to all tasks
MAX_VOCABULARY = 64 << 20     # bytes of a vocabulary file that may be sent to all tasks
SPACE_MARK = "▁"         # fixed: stands for a blank in pieces

#: Fixed: the pattern that cuts texts before byte-level merges (the "ByteLevel" splitter of the file format).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY + 1)
    if len(raw) > MAX_VOCABULARY:
        raise ValueError(f"vocabulary file over {MAX_VOCABULARY} bytes")
    return raw


def byte_letters() -> dict[str, int]:
    """Letter -> byte of the byte-level alphabet: printable bytes are their own letter, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class ByteLevel:
    """A byte-level BPE vocabulary from a tokenizers JSON file.

    Where the merges stand in the order of the ids they make (as in the public files),
    a rank encoder gives the file's own ids several times faster; else the file's
    library encodes.  A test holds both against each other on every code point.
    """

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        self.tokens = [b""] * (max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", ()))]) + 1)
        for t in spec.get("added_tokens", ()):
            self.tokens[t["id"]] = t["content"].encode()
        for text, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in text)
        pre = spec.get("pre_tokenizer") or {}
        made = [vocab.get("".join(m) if not isinstance(m, str) else m.replace(" ", "", 1)) for m in model["merges"]]
        plain = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                 and spec.get("normalizer") is None and None not in made and made == sorted(set(made)))
        if plain:
            import tiktoken
            ranks = {self.tokens[i]: i for i in vocab.values()}
            self.encode = tiktoken.Encoding("aligned", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks,
                                            special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer
            own = Tokenizer.from_str(raw.decode())
            own.encode_special_tokens = True
            self.encode = lambda text: own.encode(text, add_special_tokens=False).ids

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [self.encode(" " + t) for t in texts]


class Pieces:
    """A piece vocabulary (sentencepiece model file); its encoder puts the leading blank itself."""

    def __init__(self, raw: bytes):
        import sentencepiece
        self.own = sentencepiece.SentencePieceProcessor(model_proto=raw)
        own, n = self.own, self.own.get_piece_size()
        self.tokens = [bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i)
                       else own.id_to_piece(i).replace(SPACE_MARK, " ").encode() for i in range(n)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


class Side:
    """A tokenizer with its tokens' bytes as one table."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.size = np.array([len(t) for t in tokenizer.tokens], np.int64)
        self.off = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokenizer.tokens), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        found = self.tokenizer.ids(texts)
        count = np.array([len(x) for x in found], np.int64)
        ids = np.fromiter((i for x in found for i in x), np.int64, int(count.sum()))
        return ids, count

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.off[ids] - end + size, size) + np.arange(int(size.sum()))]


def gallop(table: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each key its first place in the sorted ``table`` with an entry that isn't smaller,
    searched from ``start`` by doubling leaps and then by halving."""
    n = len(table)
    start = np.clip(start, 0, max(n - 1, 0))
    below = table[start] < key
    low = np.where(below, start, -1)          # table[low] < key, or -1
    high = np.where(below, n, start)          # table[high] >= key, or n
    at, leap = np.arange(len(key)), 1
    while len(at):
        up, from_ = below[at], start[at]
        probe = np.where(up, np.minimum(from_ + leap, n), np.maximum(from_ - leap, -1))
        inside = (probe >= 0) & (probe < n)
        less = np.where(inside, table[np.clip(probe, 0, n - 1)] < key[at], probe < 0)
        low[at[less]], high[at[~less]] = probe[less], probe[~less]
        at, leap = at[(up == less) & inside], 2 * leap
    at = np.flatnonzero(high - low > 1)
    while len(at):
        mid = (low[at] + high[at]) >> 1
        less = table[mid] < key[at]
        low[at[less]], high[at[~less]] = mid[less], mid[~less]
        at = at[high[at] - low[at] > 1]
    return high


def common_ends(end_a: np.ndarray, count_a: np.ndarray, end_b: np.ndarray, count_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of the ends that both have; ends are stacked over the documents."""
    found = []
    doc = np.arange(len(count_a))
    for drives, (few, n_few), (many, n_many) in ((count_a <= count_b, (end_a, count_a), (end_b, count_b)),
                                                 (count_a > count_b, (end_b, count_b), (end_a, count_a))):
        owner = np.repeat(doc, np.where(drives, n_few, 0))
        place = np.flatnonzero(np.repeat(drives, n_few))
        first, first_many = np.cumsum(n_few) - n_few, np.cumsum(n_many) - n_many
        rank = place - first[owner]
        key = few[place]
        to = gallop(many, key, first_many[owner] + rank * n_many[owner] // np.maximum(n_few[owner], 1)) if len(key) else place
        hit = (to < len(many)) & (many[np.minimum(to, len(many) - 1)] == key) if len(many) else np.zeros(len(key), bool)
        found.append((place[hit], to[hit]))
    (a1, b1), (b2, a2) = found
    return np.sort(np.concatenate([a1, a2])), np.sort(np.concatenate([b1, b2]))


class Aligner:
    """Both sides with the texts of their ids; lives in one Python worker."""

    def __init__(self, a, b):
        self.a, self.b = Side(a), Side(b)
        na, nb = len(self.a.size), len(self.b.size)
        self.na, self.nb = na, nb
        # decimal ids with what follows them: inside A, end of A, inside B, end of B
        self.text = np.array([f"{i}{c}" for n, c in ((na, ","), (na, "|"), (nb, ","), (nb, ";")) for i in range(n)], object)

    def align(self, given: list[str | None]) -> dict[str, list | np.ndarray]:
        """Columns n_a, n_b, n_groups, n_links, groups, links for a slice of texts."""
        n = len(given)
        live = np.array([i for i, t in enumerate(given) if t], np.int64)
        texts = [given[i] for i in live.tolist()]
        ids_a, count_a = self.a.encode(texts)
        ids_b, count_b = self.b.encode(texts)
        raw = [b" " + t.encode() for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        whole = np.ones(len(texts), bool)
        for side, ids, count in ((self.a, ids_a, count_a), (self.b, ids_b, count_b)):
            whole &= np.bincount(np.repeat(np.arange(len(texts)), count), side.size[ids], len(texts)).astype(np.int64) == size
        for side, ids, count in ((self.a, ids_a, count_a), (self.b, ids_b, count_b)):  # lengths agree: compare the bytes
            want = np.frombuffer(b"".join([r for r, w in zip(raw, whole.tolist(), strict=True) if w]), np.uint8)
            wrong = np.flatnonzero(side.bytes_of(ids[np.repeat(whole, count)]) != want)
            if len(wrong):
                kept = np.flatnonzero(whole)
                whole[kept[np.unique(np.searchsorted(np.cumsum(size[kept]), wrong, "right"))]] = False
        ids_a, ids_b = ids_a[np.repeat(whole, count_a)], ids_b[np.repeat(whole, count_b)]
        live, count_a, count_b = live[whole], count_a[whole], count_b[whole]
        at_a, at_b = common_ends(np.cumsum(self.a.size[ids_a]), count_a, np.cumsum(self.b.size[ids_b]), count_b)
        groups = np.diff(np.searchsorted(at_a, np.concatenate([[0], np.cumsum(count_a)])))
        out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        out["n_a"][live], out["n_b"][live], out["n_groups"][live] = count_a, count_b, groups
        out["n_links"][live] = groups       # tokens aren't empty, so one token of each side ends at a common end
        text, links = [""] * n, [b""] * n
        linked = (ids_a[at_a] << 32) | ids_b[at_b]
        cut = np.concatenate([[0], np.cumsum(groups)])
        written = self._written(ids_a, ids_b, at_a, at_b)
        ends = np.concatenate([[0], np.cumsum(count_a + count_b)]).tolist()
        for k, i in enumerate(live.tolist()):
            text[i] = "".join(written[ends[k]:ends[k + 1]])[:-1]
            links[i] = linked[cut[k]:cut[k + 1]].tobytes()
        return out | {"groups": text, "links": links}

    def _written(self, ids_a, ids_b, at_a, at_b) -> list[str]:
        """All tokens as text in the order of the groups, A before B in each."""
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[at_a], last_b[at_b] = True, True
        before_a, before_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b   # groups that end before a token
        first_b = np.concatenate([[0], at_b + 1])
        end_a = np.concatenate([at_a + 1, [len(ids_a)]])
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + first_b[before_a]] = ids_a + self.na * last_a
        order[np.arange(len(ids_b)) + end_a[before_b]] = 2 * self.na + ids_b + self.nb * last_b
        return self.text[order].tolist()


def _slices(text: list[str | None]) -> Iterator[tuple[int, int]]:
    i = size = 0
    for j, t in enumerate(text):
        size += len(t or "")
        if size > SLICE_CHARS:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(text):
        yield i, len(text)


_WORKER: dict[int, Aligner] = {}
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary"


def align(docs: DataFrame, byte_level_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``)
    and links (8 bytes each, little-endian: A's id << 32 | B's id)."""
    sent = docs.sparkSession.sparkContext.broadcast((read_file(byte_level_file), read_file(piece_file)))
    token = sent._jbroadcast.id()

    def run(batches):
        if token not in _WORKER:
            _WORKER.clear()
            a, b = sent.value
            _WORKER[token] = Aligner(ByteLevel(a), Pieces(b))
        aligner = _WORKER[token]
        try:
            for batch in batches:
                text = batch.column(1).to_pylist()
                for i, j in _slices(text):
                    got = aligner.align(text[i:j])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, j - i), *(pa.array(got[k]) for k in ("n_a", "n_b", "n_groups", "n_links")),
                         pa.array(got["groups"], pa.string()), pa.array(got["links"], pa.binary())],
                        names=[f.split()[0] for f in ALIGNED.split(", ")])
        finally:
            release()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, ALIGNED)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All links of a batch, and how many each row has."""
    rows = [x or b"" for x in column.to_pylist()]
    return np.frombuffer(b"".join(rows), np.int64), np.array([len(x) // 8 for x in rows], np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n): how many links of the corpus hold each id pair linked."""
    def count(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def passed():
            return pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["pair", "n"])

        for batch in batches:
            code, n = np.unique(_codes(batch.column(0))[0], return_counts=True)
            both = np.concatenate([held[0], code])
            code, back = np.unique(both, return_inverse=True)
            total = np.zeros(len(code), np.int64)
            np.add.at(total, back, np.concatenate([held[1], n]))
            held = (code, total)
            if len(code) > COUNTED:
                yield passed()
                held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield passed()

    found = aligned.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return found.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b"), "n")


def _pair() -> Column:
    return F.shiftleft("a", 32).bitwiseOR(F.col("b"))


def frequent_from(pairs: DataFrame, most: int) -> int:
    """The smallest power of two for which at most ``most`` pairs have as high a count."""
    size = {r["k"]: r["c"] for r in pairs.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("c")).collect()}
    k, total = 63, 0
    while k >= 0 and total + size.get(k, 0) <= most:
        total += size.get(k, 0)
        k -= 1
    return 1 << (k + 1)


def _rate(code: np.ndarray, count: np.ndarray, known, rated, best) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the sum of its links' counts and its number of best links, over the known pairs; and which links aren't known."""
    at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
    hit = known[at] == code if len(known) else np.zeros(len(code), bool)
    ends = np.cumsum(count)

    def sums(v):
        c = np.concatenate([[0], np.cumsum(v)])
        return c[ends] - c[ends - count]

    if not len(known):
        return sums(np.zeros(len(code), np.int64)), sums(np.zeros(len(code), np.int64)), ~hit
    return sums(np.where(hit, rated[at], 0)), sums(hit & best[at]), ~hit


def count_links(aligned: DataFrame, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """The rows of ``aligned`` (columns doc_id, n_links, links and any others) with, in place of links,
    count_sum (counts of their links' pairs, summed) and n_best (links whose count is the highest of their B id)."""
    spark = aligned.sparkSession
    keep = [c for c in aligned.columns if c != "links"]
    rows = materialize(aligned.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"),
                                      "links"), "aligned")
    pairs = materialize(pair_counts(rows), "pairs")
    top = pairs.groupBy("b").agg(F.max("n").alias("most"))      # one row per id of the vocabulary at most
    rated = materialize(pairs.join(F.broadcast(top), "b").select(_pair().alias("pair"), "n", (F.col("n") == F.col("most")).alias("best")), "rated")
    cut = frequent_from(rated, sent_pairs)
    often = rated.filter(F.col("n") >= cut).toArrow()
    order = np.argsort(often["pair"].to_numpy())
    sent = spark.sparkContext.broadcast((often["pair"].to_numpy()[order], often["n"].to_numpy()[order],
                                         often["best"].to_numpy(zero_copy_only=False).astype(bool)[order]))

    def rate(batches):
        for batch in batches:
            code, count = _codes(batch.column(1))
            total, best, _ = _rate(code, count, *sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(best.astype(np.int64))],
                                             names=["row", "count_sum", "n_best"])

    def rest(batches):
        for batch in batches:
            code, count = _codes(batch.column(1))
            _, _, left = _rate(code, count, *sent.value)
            owner = np.repeat(np.asarray(batch.column(0)), count)[left]
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(code[left])], names=["row", "pair"])

    if cut <= 1:     # every pair was sent: one pass, rows carried along
        schema = StructType([rows.schema["kept"], StructField("count_sum", LongType()), StructField("n_best", LongType())])

        def rate_kept(batches):
            for batch in batches:
                code, count = _codes(batch.column(2))
                total, best, _ = _rate(code, count, *sent.value)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(total), pa.array(best.astype(np.int64))],
                                                 names=["kept", "count_sum", "n_best"])

        return rows.mapInArrow(rate_kept, schema).select("kept.*", "count_sum", "n_best")
    left = (rows.select("row", "links").mapInArrow(rest, "row long, pair long").groupBy("row", "pair").agg(F.count("*").alias("c"))
            .join(rated.filter(F.col("n") < cut), "pair").groupBy("row")
            .agg(F.sum(F.col("c") * F.col("n")).alias("count_sum"), F.sum(F.col("c") * F.col("best").cast("long")).alias("n_best")))
    total = (rows.select("row", "links").mapInArrow(rate, "row long, count_sum long, n_best long").unionByName(left).groupBy("row")
             .agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best")))
    return rows.select("row", "kept").join(total, "row").select("kept.*", "count_sum", "n_best")


def groups_sha256() -> Column:
    return F.when(F.col("n_groups") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
