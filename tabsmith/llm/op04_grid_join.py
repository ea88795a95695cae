"""Embedding near-dedup: epsilon grid order join.

On unit vectors cosine >= c means a distance of at most eps = sqrt(2 - 2c).
Vectors are sorted by label and by their grid cells (width eps) on the leading
principal dimensions; the order is cut into blocks, each with the bounds of its
vectors on those dimensions.  Two sequences are joined recursively: sequences
whose bounds are farther apart than eps are skipped, long ones are halved, short ones
compared in double precision.  Blocks meet only when their first grid cells
are neighbours.

Equal vectors of a label are one class, so copies are never compared with each
other.  A task returns per vector the number of links and per pair of sequences a
spanning set of edges, never all pairs.  The principal dimensions only steer
skipping; they come from sums over all vectors (dimensions squared numbers).

Defined results: vectors that are null, zero or hold null or non-finite components,
vectors without a label and rows with a null id link with nothing (n_links 0); vectors
of different lengths don't link; a null id has no component and is not kept; rows
that share an id are vectors each, in one component; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import materialize
from .graph import components

COSINE = 0.93
GRID_DIMS = 8      # principal dimensions of grid and bounds
BLOCK = 1024       # vectors of a block
LEAF = 256         # sequences up to this length are compared
_MARGIN = 1e-9     # bounds are widened by this, for rounding


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def principal_axes(classes: DataFrame, dims: int) -> np.ndarray:
    """Leading axes (length, dims) of the unit vectors of one length, from summed products."""
    def partial(batches):
        total = None
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b.column(0)))
                part = u.T @ u
                total = part if total is None else total + part
        if total is not None:
            v = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], names=["i", "v"])

    rows = classes.select("vector").mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    n = int(round(len(rows) ** 0.5))
    m = np.zeros(n * n)
    for r in rows:
        m[r.i] = r.v
    return np.linalg.eigh(m.reshape(n, n))[1][:, ::-1][:, :dims]


def _connected(links: np.ndarray) -> list[tuple[tuple[str, int], tuple[str, int]]]:
    """Edges that join what the boolean matrix ``links`` joins (rows and columns are two sets)."""
    r, c = links.any(1).nonzero()[0], links.any(0).nonzero()[0]
    sub = links[np.ix_(r, c)]
    left = np.arange(len(r))
    while True:
        right = np.where(sub, left[:, None], len(r)).min(0)
        new = np.minimum(left, np.where(sub, right[None, :], len(r)).min(1))
        new = new[new]
        if (new == left).all():
            break
        left = new
    right = np.where(sub, left[:, None], len(r)).min(0)
    # A star for each group: from its first row to its other rows and its columns.
    return ([(("r", int(r[left[i]])), ("r", int(r[i]))) for i in range(len(r)) if left[i] != i]
            + [(("r", int(r[right[j]])), ("c", int(c[j]))) for j in range(len(c))])


class _Join:
    """Recursive join of two blocks' sequences (or of one with itself)."""

    def __init__(self, a: dict, b: dict, same: bool, cosine: float):
        self.a, self.b, self.same, self.cosine = a, b, same, cosine
        self.eps2 = 2 - 2 * cosine + _MARGIN
        self.n_a, self.n_b = np.zeros(len(a["id"]), np.int64), np.zeros(len(b["id"]), np.int64)
        self.edges: set[tuple[int, int]] = set()

    def far(self, i, j, k, m) -> bool:
        p, q = self.a["grid"][i:j], self.b["grid"][k:m]
        gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)) - _MARGIN)
        return float((gap * gap).sum()) > self.eps2

    def run(self, i: int, j: int, k: int, m: int) -> None:
        if self.same and m <= i:  # each pair once: the left one stands earlier
            return
        if self.far(i, j, k, m):
            return
        if j - i <= LEAF and m - k <= LEAF:
            self.compare(i, j, k, m)
        elif j - i >= m - k:
            h = (i + j) // 2
            self.run(i, h, k, m)
            self.run(h, j, k, m)
        else:
            h = (k + m) // 2
            self.run(i, j, k, h)
            self.run(i, j, h, m)

    def compare(self, i, j, k, m) -> None:
        links = self.a["unit"][i:j] @ self.b["unit"][k:m].T >= self.cosine
        if self.same:
            links &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
        if not links.any():
            return
        self.n_a[i:j] += links @ self.b["copies"][k:m]
        self.n_b[k:m] += links.T @ self.a["copies"][i:j]
        ids = {"r": self.a["id"][i:j], "c": self.b["id"][k:m]}
        for (s, x), (t, y) in _connected(links):
            self.edges.add((int(ids[s][x]), int(ids[t][y])))


PACKED = ("ids", "keys", "copies", "grid", "unit")


def _block(row_id, row_key, row_copies, row_grid, row_unit) -> dict:
    ids = np.frombuffer(row_id, np.int64)
    return {"id": ids, "key": np.frombuffer(row_key, np.int64), "copies": np.frombuffer(row_copies, np.int64),
            "grid": np.frombuffer(row_grid, np.float64).reshape(len(ids), -1),
            "unit": np.frombuffer(row_unit, np.float64).reshape(len(ids), -1)}


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    cosine: float = COSINE, grid_dims: int = GRID_DIMS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, class_id, component_id, kept) for every row."""
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 - 2 * cosine))
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & (norm > 0)
    # Two 64-bit hashes name a class: label and vector.
    k1, k2 = (F.when(F.coalesce(usable, F.lit(False)), F.xxhash64(F.lit(i), "label", "vector")) for i in (1, 2))
    rows = materialize(rows.select("vec_id", "label", "vector", k1.alias("k1"), k2.alias("k2")), "vectors")
    classes = materialize(
        rows.filter("k1 is not null").groupBy("k1", "k2").agg(
            F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")),
        "classes")

    edges, counts = [], []
    for n in sorted(r.n for r in classes.select(F.size("vector").alias("n")).distinct().collect()):  # lengths: a few
        own = classes.filter(F.size("vector") == n)
        blocks = materialize(_blocks(own, principal_axes(own, grid_dims), eps, block), "blocks")
        found = materialize(_joined(blocks, cosine), "links")
        edges.append(found.filter("edge").select(F.col("x").alias("a"), F.col("y").alias("b")))
        counts.append(found.filter("not edge").select(F.col("x").alias("k1"), F.col("y").alias("n")))
    if edges:
        # An id that stands in several classes joins them.
        several = rows.filter("vec_id is not null").select("vec_id", F.xxhash64("k1", "k2").alias("h")).groupBy("vec_id").agg(
            F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("vec_id")
        edges.append(rows.select("vec_id", "k1", "k2").join(several, "vec_id").join(classes.select("k1", "k2", "id"), ["k1", "k2"])
                     .select(F.col("id").alias("a"), F.col("vec_id").alias("b")).filter("a <> b").distinct())
        label = components(_union(edges))
        links = _union(counts).groupBy("k1").agg(F.sum("n").alias("n"))
    else:
        label = spark.createDataFrame([], "node long, component long")
        links = spark.createDataFrame([], "k1 long, n long")
    info = classes.select("k1", "k2", "id", "copies")
    info = info.join(links, "k1", "left")
    out = rows.select("vec_id", "k1", "k2").join(info, ["k1", "k2"], "left")
    out = out.join(label.toDF("node", "component"), F.coalesce("id", "vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "id", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("id", "vec_id").alias("class_id"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _blocks(classes: DataFrame, axes: np.ndarray, eps: float, size: int) -> DataFrame:
    """Blocks of the grid order: label, bounds of the cells of the first two dimensions, packed vectors."""
    dims = axes.shape[1]

    def place(batches):
        for b in batches:
            if b.num_rows:
                g = _unit(_matrix(b.column(4))) @ axes
                cell = np.floor(g / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k) for k in range(5)), pa.array(g.tolist(), pa.list_(pa.float64())), pa.array(cell.tolist(), pa.list_(pa.int32()))],
                    names=["id", "k1", "copies", "label", "vector", "grid", "cell"])

    placed = classes.select("id", "k1", "copies", "label", "vector").mapInArrow(
        place, "id long, k1 long, copies long, label string, vector array<double>, grid array<double>, cell array<int>")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["label", *[F.col("cell")[i] for i in range(dims)], "k1"]
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches):
        held: list[pa.RecordBatch] = []

        def emit(t: pa.Table):
            ids, keys, copies = (t.column(c).to_numpy().astype(np.int64) for c in ("id", "k1", "copies"))
            unit = _unit(_matrix(t.column("vector").combine_chunks()))
            grid = _matrix(t.column("grid").combine_chunks())
            cell = np.floor(grid / eps)
            return pa.RecordBatch.from_pylist([{
                "name": int(keys[0]), "label": t.column("label")[0].as_py(),
                "lo0": int(cell[:, 0].min()), "hi0": int(cell[:, 0].max()),
                "lo": grid.min(0).tolist(), "hi": grid.max(0).tolist(),
                "ids": ids.tobytes(), "keys": keys.tobytes(), "copies": copies.tobytes(),
                "grid": grid.tobytes(), "unit": unit.tobytes()}], schema=schema)

        schema = pa.schema([("name", pa.int64()), ("label", pa.string()), ("lo0", pa.int32()), ("hi0", pa.int32()),
                            ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("keys", pa.binary()),
                            ("copies", pa.binary()), ("grid", pa.binary()), ("unit", pa.binary())])
        rows = 0
        for b in batches:
            labels = b.column(3).to_pylist()
            i = 0
            for j in range(1, b.num_rows + 1):
                new_label = j < b.num_rows and labels[j] != labels[j - 1]
                first_differs = held and i == 0 and j == 1 and held[0].column(3)[0].as_py() != labels[0]
                if first_differs:
                    yield emit(pa.Table.from_batches(held))
                    held, rows = [], 0
                if new_label or rows + (j - i) >= size:
                    held.append(b.slice(i, j - i))
                    yield emit(pa.Table.from_batches(held))
                    held, rows, i = [], 0, j
            if i < b.num_rows:
                held.append(b.slice(i))
                rows += b.num_rows - i
        if held:
            yield emit(pa.Table.from_batches(held))

    return ordered.mapInArrow(cut, "name long, label string, lo0 int, hi0 int, lo array<double>, hi array<double>, "
                                   "ids binary, keys binary, copies binary, grid binary, unit binary")


def _joined(blocks: DataFrame, cosine: float) -> DataFrame:
    """Links counts (x: class, y: links) and edges (x, y) of all pairs of blocks that aren't provably distant."""
    eps2 = 2 - 2 * cosine + _MARGIN
    meta = blocks.select("name", "label", "lo0", "hi0", "lo", "hi")
    x = meta.select(*[F.col(c).alias(f"x_{c}") for c in meta.columns], F.explode(F.sequence(F.col("lo0") - 1, F.col("hi0") + 1)).alias("c"))
    y = meta.select(*[F.col(c).alias(f"y_{c}") for c in meta.columns], F.explode(F.sequence("lo0", "hi0")).alias("c"))
    gap = lambda i: F.greatest(F.lit(0.0), F.col("x_lo")[i] - F.col("y_hi")[i] - _MARGIN, F.col("y_lo")[i] - F.col("x_hi")[i] - _MARGIN)
    distance = F.aggregate(F.sequence(F.lit(0), F.size("x_lo") - 1), F.lit(0.0), lambda s, i: s + gap(i) * gap(i))
    near = x.join(y, (F.col("x_label") == F.col("y_label")) & (x["c"] == y["c"]) & (F.col("x_name") <= F.col("y_name"))).filter(
        distance <= eps2).select("x_name", "y_name").distinct()
    packed = lambda p: blocks.select(F.col("name").alias(f"{p}_name"), *[F.col(c).alias(f"{p}_{c}") for c in PACKED])
    pairs = near.join(packed("x"), "x_name").join(packed("y"), "y_name").select(
        "x_name", "y_name", *[f"{p}_{c}" for p in "xy" for c in PACKED])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(i)[k].as_py() for i in range(2 + 2 * len(PACKED))]
                j = _Join(_block(*row[2:2 + len(PACKED)]), _block(*row[2 + len(PACKED):]), row[0] == row[1], cosine)
                j.run(0, len(j.a["id"]), 0, len(j.b["id"]))
                e = np.array(sorted(j.edges), np.int64).reshape(-1, 2)
                a, b = np.flatnonzero(j.n_a), np.flatnonzero(j.n_b)
                ids = np.concatenate([e[:, 0], j.a["key"][a], j.b["key"][b]])
                val = np.concatenate([e[:, 1], j.n_a[a], j.n_b[b]])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(val, pa.int64()),
                                                  pa.array(np.arange(len(ids)) < len(e))], names=["x", "y", "edge"])

    return pairs.mapInArrow(run, "x long, y long, edge boolean")
