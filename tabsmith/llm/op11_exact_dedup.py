"""Exact deduplication against a minimal perfect hash over the digests of earlier texts.

A ``History`` holds the distinct texts seen so far as a table of buckets.  A bucket has
a bounded number of digests; a minimal perfect hash gives each of them a slot of its
own, without storing keys: on every level a digest alone in its place of a bit array
stays there, the others go on to the next level, and the number of set bits before a
place is the slot.  A slot holds the full digest, the winner's locator (its document id)
and how often the text has occurred.

New texts are looked up: a digest that isn't a member still reaches some slot (or none),
so the slot's full digest is compared byte by byte.  Members are repeats of the slot's
winner; nonmembers are grouped among themselves and can be added as a further
generation.  Finally texts are compared with the winner's text, byte by byte: should
two different texts share a digest, the rows of that digest are grouped by their texts.

On Spark: rows are pre-aggregated by digest before they meet (a text that fills a third
of the table arrives as one row per task), digests are dealt evenly over buckets whose
number grows with the rows, a bucket is built or searched in one task.  Verdicts return
by a join on the digest; the most frequent digests (at most ``HEAVY`` of them) go to all
tasks, so no key of the shuffled rest is hot.  Tables are written under the shared
checkpoint folder, so a lost executor repeats one step.

Defined results: a null text counts as empty, empty texts are equal.  Of equal texts the
smallest id stays; rows with that id are kept, also when it stands more than once.  A
null id is never smaller than another; rows of a text whose ids are all null stay
(``keep_id`` is null).  An empty table gives an empty table.  Only id and text are read,
so other columns can't clash; ``drop_repeats`` returns the columns that it was given.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import materialize
from .textkit import mix64

BUCKET = 16_384        # digests that a bucket holds on average
SPREAD = 2             # bit array: places per digest on each level
LEVELS = 48            # then what is left (equal hash words, never seen) is kept as a list
HEAVY = 10_000         # digests whose verdicts are sent to all tasks, at most
SENT_ROWS = 200_000    # repeated digests (60 bytes each) that may be sent to all tasks; more are joined by shuffling
BATCHES = 2            # parts of a table, by rising id, that are looked up one after another
DIGEST = 32            # bytes
U = np.uint64


def normalised(text: Column) -> Column:
    """Every run of blanks, tabs, line ends (fixed class) as one blank; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column, size: int = DIGEST) -> Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, size)


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each digest (n x size bytes), mixed."""
    n, size = digests.shape
    raw = np.zeros((n, 16), np.uint8)
    raw[:, :min(size, 16)] = digests[:, :16]
    two = raw.view(U)
    return mix64(two[:, 0] + U(0x9E37)), mix64(two[:, 1] ^ U(0x79B9)) | U(1)


def _places(one: np.ndarray, two: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(one + U(level) * two) % U(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """Minimal perfect hash: ``sizes`` of the levels' bit arrays, their bits in a row, and digests left over."""

    sizes: np.ndarray
    bits: np.ndarray
    rest: np.ndarray

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        left = np.arange(len(digests))
        one, two = _words(digests)
        sizes, bits = [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = SPREAD * len(left)
            at = _places(one[left], two[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate([*bits, np.zeros(0, bool)]), digests[left])

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of every member; some slot or -1 for other digests."""
        out = np.full(len(digests), -1, np.int64)
        one, two = _words(digests)
        rank = np.cumsum(self.bits) - 1
        left, base = np.arange(len(digests)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = base + _places(one[left], two[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = rank[at[hit]]
            left, base = left[~hit], base + size
        if len(self.rest) and len(left):
            n = int(self.bits.sum())
            known = {d.tobytes(): n + i for i, d in enumerate(self.rest)}
            out[left] = [known.get(digests[i].tobytes(), -1) for i in left]
        return out


def _matrix(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


INDEX = "bucket long, sizes binary, bits binary, rest binary, digests binary, winners binary, has_winner binary, counts binary"


def _build(size: int):
    def build(table: pa.Table) -> pa.Table:
        digests = _matrix(table["digest"], size)
        mph = PerfectHash.build(digests)
        slot = mph.slots(digests)
        by_slot = np.empty(len(slot), np.int64)
        by_slot[slot] = np.arange(len(slot))
        ids = table["doc_id"].combine_chunks()
        winner = np.asarray(ids.fill_null(0))[by_slot]
        known = np.asarray(ids.is_valid())[by_slot]
        row = {"bucket": table["bucket"][0].as_py(), "sizes": mph.sizes.tobytes(), "bits": np.packbits(mph.bits).tobytes(),
               "rest": mph.rest.tobytes(), "digests": digests[by_slot].tobytes(), "winners": winner.astype(np.int64).tobytes(),
               "has_winner": known.tobytes(), "counts": np.asarray(table["n"])[by_slot].astype(np.int64).tobytes()}
        return pa.table({k: pa.array([v], pa.int64() if k == "bucket" else pa.binary()) for k, v in row.items()})

    return build


FOUND = "digest binary, doc_id long, n long, member boolean, winner long, before long"


def _search(size: int):
    def search(new: pa.Table, index: pa.Table) -> pa.Table:
        m = new.num_rows
        member, winner, before = np.zeros(m, bool), np.zeros(m, np.int64), np.zeros(m, np.int64)
        has = np.zeros(m, bool)
        if m and index.num_rows:
            row = index.to_pylist()[0]
            sizes = np.frombuffer(row["sizes"], np.int64)
            bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
            mph = PerfectHash(sizes, bits, np.frombuffer(row["rest"], np.uint8).reshape(-1, size))
            held = np.frombuffer(row["digests"], np.uint8).reshape(-1, size)
            digests = _matrix(new["digest"], size)
            slot = mph.slots(digests)
            member = (slot >= 0) & (held[slot] == digests).all(1)     # the full digest decides, byte by byte
            at = slot[member]
            winner[member] = np.frombuffer(row["winners"], np.int64)[at]
            has[member] = np.frombuffer(row["has_winner"], bool)[at]
            before[member] = np.frombuffer(row["counts"], np.int64)[at]
        return pa.table({"digest": new["digest"], "doc_id": new["doc_id"], "n": new["n"], "member": pa.array(member),
                         "winner": pa.array(winner, mask=~has), "before": pa.array(before)})

    return search


@dataclass
class History:
    """Generations of bucket tables.  Digests of a generation don't occur in an earlier one."""

    spark: SparkSession
    buckets: int
    size: int = DIGEST
    generations: list[DataFrame] = field(default_factory=list)

    def _dealt(self, digests: DataFrame) -> DataFrame:
        return digests.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(self.buckets)))

    def add(self, digests: DataFrame) -> None:
        """One more generation from distinct ``digests`` (digest, doc_id of the winner, n)."""
        built = self._dealt(digests).groupBy("bucket").applyInArrow(_build(self.size), INDEX)
        self.generations.append(materialize(built, "history"))

    def lookup(self, digests: DataFrame) -> DataFrame:
        """(digest, doc_id, n, member, winner, before) for distinct ``digests`` (digest, doc_id, n)."""
        left, found = (digests if self.generations else materialize(digests, "first")), []
        for index in self.generations:
            met = self._dealt(left).groupBy("bucket").cogroup(index.groupBy("bucket"))
            got = materialize(met.applyInArrow(_search(self.size), FOUND), "lookup")
            found.append(got.filter("member"))
            left = got.filter("not member").select("digest", "doc_id", "n")
        out = left.select("digest", "doc_id", "n", F.lit(False).alias("member"), F.lit(None).cast("long").alias("winner"), F.lit(0).cast("long").alias("before"))
        for part in found:
            out = out.unionByName(part)
        return out


def grouped(rows: DataFrame) -> DataFrame:
    """Distinct digests with their smallest id and number, pre-aggregated in every task."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def _joined(rows: DataFrame, verdicts: DataFrame, on: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``verdicts`` (one row per ``on``, column n); the most frequent keys don't shuffle.

    The frequent keys cover more than ``total / HEAVY`` rows each, so there are at most HEAVY of them."""
    often = max(1, total // HEAVY)
    heavy, light = verdicts.filter(F.col("n") > often), verdicts.filter(F.col("n") <= often)
    first = rows.join(F.broadcast(heavy), on)
    rest = rows.join(F.broadcast(heavy.select(on)), on, "left_anti").join(light, on, "left")
    return first.unionByName(rest)


def verdicts(rows: DataFrame, size: int, batches: int = BATCHES) -> DataFrame:
    """(digest, keep_id, n) of every digest that occurs more than once in ``rows`` (digest, doc_id).

    The rows come in ``batches`` by rising id; each batch is looked up in the history of those before."""
    spark = rows.sparkSession
    total = rows.count()
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    history = History(spark, max(parallel, -(-total // BUCKET)), size)
    at = [k / batches for k in range(1, batches)]
    cuts = sorted({int(c) for c in rows.stat.approxQuantile("doc_id", at, 0.01)}) if at and total else []
    part = F.lit(0)
    for c in cuts:
        part = part + F.coalesce(F.col("doc_id") > c, F.lit(True)).cast("int")     # null ids come last
    rows = rows.withColumn("part", part)
    seen = []
    for k in range(len(cuts) + 1):
        found = history.lookup(grouped(rows.filter(F.col("part") == k)))
        history.add(found.filter("not member").select("digest", "doc_id", "n"))
        seen.append(found.select("digest", F.when(F.col("member"), F.col("winner")).otherwise(F.col("doc_id")).alias("keep_id"), "n"))
    out = seen[0]
    for more in seen[1:]:
        out = out.unionByName(more)
    return materialize(out.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")).filter("n > 1"), "verdicts")


def _same_digest_other_text(texts: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """Digests that stand for more than one text: rows are compared with the winner's text, byte by byte."""
    few = repeated.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    named = repeated.select("digest", "keep_id", F.ceil(F.col("n") / F.lit(max(1, total // HEAVY))).cast("int").alias("parts"))
    rows = texts.join(F.broadcast(named) if few else named, "digest")
    winner = rows.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "parts").agg(F.min("text").alias("won"))
    spread = winner.select("digest", "won", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))   # a hot text meets its copies in parts
    salted = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.col("parts").cast("long")).cast("int"))
    met = salted.join(spread.hint("merge"), ["digest", "part"], "left")
    return met.filter(~F.col("text").eqNullSafe(F.col("won"))).select("digest").distinct()


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, digest_bytes: int = DIGEST) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (of the normalised text).

    ``digest_bytes`` under 32 is for tests: digests then collide and the texts decide."""
    text = normalised(F.col(text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", digest(F.col("text"), digest_bytes).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(texts.select("doc_id", "digest"), "digests")
    total = rows.count()
    repeated = verdicts(rows, digest_bytes, batches)
    wrong = materialize(_same_digest_other_text(texts, repeated, total), "collisions")
    out = _joined(rows, repeated, "digest", total)
    if not wrong.isEmpty():
        by_text = texts.join(wrong, "digest").select("doc_id", "digest", "text")
        again = by_text.groupBy("text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
        out = out.join(wrong, "digest", "left_anti").unionByName(
            _joined(by_text, again, "text", total).select(*out.columns))
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), "digest")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = find_repeats(docs, id_col, text_col)
    gone = found.filter("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("digest").alias("_gone_digest")).distinct()
    of = digest(normalised(F.col(text_col)))
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_gone_id")) & (of == F.col("_gone_digest")), "left_anti")
