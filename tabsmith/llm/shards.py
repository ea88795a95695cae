"""Text shards and the fingerprint exchange.

Finding what repeats across all documents needs every task's fingerprints to
meet, but not the texts.  ``write_shards`` packs documents into rows of a few
MB (compressed, one table bucketed by shard id in the shared folder).  A pass
over it maps each shard to blobs ``(bucket, shard, payload)``: packed arrays of
the fingerprints that fall into a bucket, each once a shard (so a fingerprint
that a third of all rows holds counts once a shard, not once a row).  All blobs
of a bucket meet in one reducer of bounded size (the number of buckets grows
with the input), which answers each blob with a payload of its own.  Answers go
back to the shard by a join on the bucketed table, which is not shuffled.

Shards are rows of a written table, so a lost executor's pass is repeated on
the same shards, and answers refer to fixed positions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import materialize
from ..session import scratch_path
from .textkit import release, texts

SHARD_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max  # a null id: larger than every other
BLOBS = "bucket int, shard long, payload binary"


@dataclass
class Shard:
    """Documents of one shard: ids, one byte buffer, offsets, null mask; ``answers`` by pass and bucket."""
    shard: int
    ids: np.ndarray
    buf: np.ndarray
    off: np.ndarray
    nulls: np.ndarray
    answers: list[dict[int, bytes]] = field(default_factory=list)

    @property
    def doc_of(self) -> Callable[[np.ndarray], np.ndarray]:
        return lambda at, off=self.off: np.searchsorted(off, at, "right") - 1


def from_batch(ids: pa.Array, text: pa.Array) -> Shard:
    buf, off, nulls = texts(text)
    key = np.array(ids.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False), np.int64)
    return Shard(-1, key, buf, off, nulls)


def _pack(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    zip_ = zstandard.ZstdCompressor(1)
    for b in batches:
        s = from_batch(b.column(0), b.column(1))
        i = 0
        while i < len(s.ids):
            j = max(i + 1, int(np.searchsorted(s.off, s.off[i] + shard_bytes, "right")) - 1)
            lens = np.where(s.nulls[i:j], -1, s.off[i + 1:j + 1] - s.off[i:j])
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([(part << 32) | seq], pa.int64()),
                "ids": pa.array([s.ids[i:j].tobytes()], pa.binary()),
                "lens": pa.array([lens.astype(np.int64).tobytes()], pa.binary()),
                "n_bytes": pa.array([int(s.off[j] - s.off[i])], pa.int64()),
                "data": pa.array([zip_.compress(s.buf[s.off[i]:s.off[j]].tobytes())], pa.binary())})
            i, seq = j, seq + 1
    release()


@dataclass
class Shards:
    """The written shard table, its number of shards, and the number of buckets of an exchange."""
    table: DataFrame
    count: int
    buckets: int


def write_shards(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int = SHARD_BYTES) -> Shards:
    """Pack ``docs`` (id, text) into the shard table; tasks write their own buckets, no shuffle."""
    spark: SparkSession = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    parts = max(1, src.rdd.getNumPartitions())
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "shards")
    name = "shards_" + path.rsplit("-", 1)[-1]
    (src.mapInArrow(lambda batches: _pack(batches, shard_bytes), "shard long, ids binary, lens binary, n_bytes long, data binary")
        .write.format("parquet").option("path", path).option("compression", "none")
        .bucketBy(max(2 * parts, shuffles), "shard").saveAsTable(name))
    table = spark.table(name)
    n = table.count()
    return Shards(table, n, max(4 * shuffles, 2 * n))


def unpack(row: dict) -> Shard:
    lens = np.frombuffer(row["lens"], np.int64)
    data = zstandard.ZstdDecompressor().decompress(row["data"]) if row["n_bytes"] else b""
    off = np.concatenate([[0], np.cumsum(np.maximum(lens, 0))])
    return Shard(row["shard"], np.frombuffer(row["ids"], np.int64), np.frombuffer(data, np.uint8), off, lens < 0)


def shard_pass(shards: Shards, answers: list[DataFrame], fn: Callable[[Shard], Iterator[pa.RecordBatch] | list],
               schema: str) -> DataFrame:
    """Run ``fn`` on every shard, with the answers of earlier exchanges joined to it."""
    df, passes = shards.table, range(len(answers))
    for i, a in enumerate(answers):
        got = a.groupBy("shard").agg(F.collect_list(F.struct("bucket", "payload")).alias(f"_a{i}"))
        df = df.join(got, "shard", "left")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = {name: b.column(j)[k].as_py() for j, name in enumerate(b.schema.names)}
                s = unpack(row)
                s.answers = [{x["bucket"]: x["payload"] for x in row[f"_a{i}"] or []} for i in passes]
                yield from fn(s)
                s = row = None
        release()

    return df.mapInArrow(run, schema)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the high half of a hash; the low half tells fingerprints of a bucket apart."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def blobs(shard: int, bucket: np.ndarray, buckets: int, pack: Callable[[slice], bytes]) -> Iterator[pa.RecordBatch]:
    """Blobs of entries sorted by ``bucket``; ``pack(slice)`` gives a bucket's payload."""
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    full = np.flatnonzero(cut[1:] > cut[:-1])
    if len(full):
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(full, pa.int32()), "shard": pa.array(np.full(len(full), shard), pa.int64()),
            "payload": pa.array([pack(slice(cut[b], cut[b + 1])) for b in full], pa.binary())})


def exchange(sent: DataFrame, answer: Callable[[list[bytes]], list[bytes]], name: str) -> DataFrame:
    """All blobs of a bucket meet; ``answer`` maps their payloads to as many answers.  Written once."""

    def reduce(t: pa.Table) -> pa.Table:
        out = answer(t.column("payload").to_pylist())
        return pa.table({"bucket": t.column("bucket"), "shard": t.column("shard"),
                         "payload": pa.array(out, pa.binary())})

    return materialize(sent.groupBy("bucket").applyInArrow(reduce, BLOBS), name)


def census_blobs(shard: int, prints: np.ndarray, doc: np.ndarray, buckets: int):
    """Blobs that ask which fingerprints occur in another document: each distinct
    fingerprint once, as 32 bits within its bucket, after a bitmap of those that two
    documents of this shard hold."""
    o = np.argsort(prints, kind="stable")
    p, d = prints[o], doc[o]
    head = np.concatenate([[True], p[1:] != p[:-1]]) if len(p) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    many = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at) if len(at) else head
    u = p[at]
    low = u.astype(np.uint32)

    def pack(s: slice) -> bytes:
        return low[s].tobytes() + np.packbits(many[s]).tobytes()

    return u, blobs(shard, bucket_of(u, buckets), buckets, pack)


def census_answer(payloads: list[bytes]) -> list[bytes]:
    """Bitmap over a blob's fingerprints: occurs in two documents (of one shard or of two)."""
    counts = [len(x) * 8 // 33 for x in payloads]  # 32 bits and one flag each
    low = np.concatenate([np.frombuffer(x, np.uint32, c) for x, c in zip(payloads, counts, strict=True)])
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=4 * c), count=c)
                           for x, c in zip(payloads, counts, strict=True)]).astype(bool)
    o = np.argsort(low, kind="stable")
    p = low[o]
    head = np.concatenate([[True], p[1:] != p[:-1]])
    at = np.flatnonzero(head)
    n = np.diff(np.concatenate([at, [len(p)]]))
    group_many = np.logical_or.reduceat(many[o], at) | (n > 1)
    shared = np.empty(len(p), bool)
    shared[o] = np.repeat(group_many, n)
    out, i = [], 0
    for c in counts:
        out.append(np.packbits(shared[i:i + c]).tobytes())
        i += c
    return out


def census_read(u: np.ndarray, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    """Shared flags of the distinct fingerprints ``u`` (sorted) from the answers."""
    cut = np.searchsorted(bucket_of(u, buckets), np.arange(buckets + 1))
    out = np.zeros(len(u), bool)
    for b, x in answers.items():
        out[cut[b]:cut[b + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=cut[b + 1] - cut[b])
    return out
