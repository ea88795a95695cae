"""Embedding whitening: distributed covariance, eigenvectors refined from float32 to high precision.

Entries become integers (``floor(1024 * c) + 100000`` by default), so the sums and the
products of centred entries are exact while they stay under 2^53.  Tasks add up
matrices: counts and sums first, then the products of entries centred on the rounded
mean; the remainder of the mean is taken off exactly.

The covariance (d x d, no matter how many rows) is solved on the driver.  Its float32
eigenvectors are corrected by the iteration of Ogita and Aishima: with R = I - X'X and
S = X'AX in extended precision, new eigenvalues are S_ii / (1 - R_ii) and X becomes
X + XE, E_ij = (S_ij + l_j R_ij) / (l_j - l_i).  Eigenvalues nearer to each other than
the error bound form clusters; there E only makes the vectors orthogonal and a solve of
the small matrix X_J' (A - m I) X_J, shifted by the cluster's mean m, tells them apart.
The error falls quadratically, so few rounds suffice.

On Spark: four maps over the vectors (lengths, sums, products, output with one more
aggregate for the identity error).  A task passes on d rows of d numbers; these are
summed in two steps, so no task reads one row of every other task.

Defined results: vectors that are null, empty, or hold null or non-finite entries or
entries whose integer has 53 bits or more, are dropped; so are vectors of another length than
the commonest (the shorter one on a tie).  Repeated rows count as often as they stand, a null id is kept.
No remaining vector: an empty table.  A component without variance (eigenvalue at most
1e-12 of the trace) has null ``whitened`` and doesn't count for ``identity_error``, which
is null if there is none; without any variance ``explained`` is null.  ``deviation`` is
null where it doesn't fit a long.  Only id and vector are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000   # fixed by the contract: x = floor(SCALE * c) + SHIFT
COMPONENTS = 8
ROUNDS = 12                    # a guard; three or four suffice
NO_VARIANCE = 1e-12
FAN_IN = 64                    # first step of the sums: tasks are dealt to so many partial sums
BLOCK_ROWS = 4096              # rows multiplied at a time
LARGEST = float(1 << 52)
HIGH = np.longdouble


# --- eigenvectors ---------------------------------------------------------------------------

def clusters(values: np.ndarray, bound: float) -> list[np.ndarray]:
    """Runs of places whose sorted ``values`` follow each other at most ``bound`` apart (two or more)."""
    order = np.argsort(values)
    cut = np.flatnonzero(np.diff(values[order]) > bound) + 1
    return [run for run in np.split(order, cut) if len(run) > 1]


def refine(a: np.ndarray, x: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of the symmetric ``a`` from approximate vectors ``x``, in extended precision."""
    a, x = a.astype(HIGH), x.astype(HIGH)
    n = len(a)
    norm = np.sqrt((a * a).sum())
    for _ in range(rounds):
        r = np.eye(n, dtype=HIGH) - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2            # else rounding, divided by a small gap, spoils the angles
        value = np.diag(s) / (1 - np.diag(r))
        bound = 2 * (np.sqrt(((s - np.diag(value)) ** 2).sum()) + norm * np.sqrt((r * r).sum()))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > bound
        e = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        for j in clusters(value, bound):
            mean = value[j].mean()
            small = x[:, j].T @ (a @ x[:, j] - mean * x[:, j])
            size = np.abs(small).max()
            if size > 0:
                turn = np.linalg.eigh((small / size).astype(np.float64))[1].astype(HIGH)
                turn = turn @ (1.5 * np.eye(len(j)) - turn.T @ turn / 2)   # orthogonal to extended precision
                x[:, j] = x[:, j] @ turn
        if bound <= 64 * n * np.finfo(HIGH).eps * norm:
            break
    x = x + x @ (np.eye(n, dtype=HIGH) - x.T @ x) / 2      # rounding over the smallest gaps, squared
    s = x.T @ (a @ x)
    return np.diag(s) / np.diag(x.T @ x), x


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the symmetric ``a``."""
    scale = np.abs(a).max()
    if not scale > 0:
        return np.zeros(len(a)), np.eye(len(a))
    value, x = refine(a / scale, np.linalg.eigh((a / scale).astype(np.float32))[1])
    order = np.argsort(-value, kind="stable")
    x = x[:, order]
    x = x / np.sqrt((x * x).sum(0))
    lead = np.abs(x).argmax(0)
    return value[order] * scale, x * np.sign(x[lead, np.arange(len(lead))])


# --- vectors --------------------------------------------------------------------------------

@dataclass
class Fit:
    """What the fit list gives: n, exact sums, centre (rounded mean), mean minus centre, eigenvalues, vectors, trace."""

    dims: int
    n: int
    sums: list[int]
    centre: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _read(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer entries (as float64, exact) of the valid vectors of a batch, and which rows these are."""
    valid = np.asarray(vectors.is_valid())
    length = np.where(valid, np.asarray(vectors.value_lengths().fill_null(0)), 0)
    rows = np.flatnonzero(valid & (length == dims))
    flat = vectors.take(pa.array(rows)).flatten()
    c = np.asarray(flat.fill_null(np.nan), np.float64).reshape(-1, dims)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(c * SCALE) + SHIFT
        ok = (np.abs(x) < LARGEST).all(1)     # false for NaN and infinity, too
    return x[ok], rows[ok]


def _added(frame: DataFrame, names: list[str]) -> DataFrame:
    """Sums of array columns by ``i``, in two steps; entries beyond 2^53 are added in halves by the caller."""
    def add(keys):
        def run(table: pa.Table) -> pa.Table:
            out = {k: pa.array(table[k].to_pylist()[:1], pa.int64()) for k in keys}
            for name in names:
                column = table[name].combine_chunks()
                total = column.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1).sum(0)
                out[name] = pa.array([total], column.type)
            return pa.table(out)
        return run

    kinds = [f"{n} {frame.schema[n].dataType.simpleString()}" for n in names]
    part = frame.groupBy("i", "part").applyInArrow(add(["i", "part"]), ", ".join(["i long", "part long", *kinds]))
    return part.groupBy("i").applyInArrow(add(["i"]), ", ".join(["i long", *kinds]))


def _length(vectors: DataFrame) -> int:
    counts = vectors.filter("v is not null and size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c"))
    best = counts.orderBy(F.desc("c"), "d").limit(1).collect()
    return best[0]["d"] if best else 0


def _sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of valid vectors and the exact sums of their entries (high and low halves are added apart)."""
    def run(batches):
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for b in batches:
            x = _read(b.column(1), dims)[0].astype(np.int64)
            n += len(x)
            high += (x >> 26).sum(0)
            low += (x & ((1 << 26) - 1)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([[n, *high.tolist(), *low.tolist()]], pa.list_(pa.int64()))], names=["v"])

    parts = vectors.mapInArrow(run, "v array<long>").select(F.lit(0).cast("long").alias("i"), F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).cast("long").alias("part"), "v")
    got = _added(parts, ["v"]).collect()
    v = got[0]["v"] if got else [0] * (1 + 2 * dims)
    return v[0], [(h << 26) + lo for h, lo in zip(v[1:1 + dims], v[1 + dims:], strict=True)]


def _products(vectors: DataFrame, dims: int, centre: np.ndarray) -> np.ndarray:
    """Sum of the outer products of the centred entries."""
    def run(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            y = _read(b.column(1), dims)[0] - centre
            for k in range(0, len(y), BLOCK_ROWS):
                part = y[k:k + BLOCK_ROWS]
                total += part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    parts = vectors.mapInArrow(run, "i long, v array<double>").select("i", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).cast("long").alias("part"), "v")
    out = np.zeros((dims, dims))
    for r in _added(parts, ["v"]).toLocalIterator():
        out[r["i"]] = r["v"]
    return out


def _narrow(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Fit | None:
    """The eigenvectors of the covariance of all valid vectors; None without any."""
    narrow = _narrow(vectors, id_col, vector_col)
    dims = _length(narrow)
    n, sums = _sums(narrow, dims) if dims else (0, [])
    if not n:
        return None
    whole = [(2 * s + n) // (2 * n) for s in sums]
    centre = np.array(whole, np.float64)
    rest = np.array([s - n * w for s, w in zip(sums, whole, strict=True)], HIGH) / n
    cov = _products(narrow, dims, centre).astype(HIGH) / n - rest[:, None] * rest[None, :]
    values, x = eigen((cov + cov.T) / 2)
    return Fit(dims, n, sums, centre, rest.astype(np.float64), values.astype(np.float64), x.astype(np.float64), float(np.trace(cov)))


def _deviation(y: np.ndarray, n: int, rest: np.ndarray) -> pa.Array:
    """Sum of (n * x - S)^2 for each row, exact, from entries centred on the rounded mean; rest = S - n * centre."""
    rough = ((n * y - rest) ** 2).sum(1) if len(y) else np.zeros(0)
    out, mask = np.zeros(len(y), np.int64), rough > 9.3e18
    fast = rough < 9.0e18          # each term and each sum then fits a long
    q = n * y[fast].astype(np.int64) - rest.astype(np.int64)
    out[fast] = (q * q).sum(1)
    for k in np.flatnonzero(~fast & ~mask).tolist():
        total = sum((n * int(e) - int(s)) ** 2 for e, s in zip(y[k], rest, strict=True))
        mask[k], out[k] = total >= 1 << 63, total if total < 1 << 63 else 0
    return pa.array(out, mask=mask)


def _whitener(f: Fit, components: int) -> tuple[int, np.ndarray]:
    """Number of components, and the matrix that projects and divides by sqrt(eigenvalue); NaN without variance."""
    k = min(components, f.dims)
    e = f.values[:k]
    with np.errstate(divide="ignore", invalid="ignore"):
        return k, np.where(e > NO_VARIANCE * f.trace, f.vectors[:, :k] / np.sqrt(e), np.nan)


def identity_error(narrow: DataFrame, f: Fit, components: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, measured over all of them."""
    k, w = _whitener(f, components)
    w = w[:, ~np.isnan(w).any(0)]
    k = w.shape[1]
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((k + 1, k))
        for b in batches:
            z = ((_read(b.column(1), f.dims)[0] - f.centre) - f.rest) @ w
            total[:k] += z.T @ z
            total[k] += z.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(1, np.int64)), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["i", "v"])

    parts = narrow.mapInArrow(run, "i long, v array<double>").select("i", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).cast("long").alias("part"), "v")
    total = np.array(_added(parts, ["v"]).collect()[0]["v"]).reshape(k + 1, k)
    mean = total[k] / f.n
    return float(np.abs(total[:k] / f.n - mean[:, None] * mean[None, :] - np.eye(k)).max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per valid vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    f = fit(vectors, id_col, vector_col)
    if f is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    narrow = _narrow(vectors, id_col, vector_col)
    error = identity_error(narrow, f, components)
    k, w = _whitener(f, components)
    explained = f.values[:k] / f.trace if f.trace > 0 else np.full(k, np.nan)
    left = np.array([float(s - f.n * int(c)) for s, c in zip(f.sums, f.centre, strict=True)])

    def run(batches):
        for b in batches:
            x, rows = _read(b.column(1), f.dims)
            m = len(rows)
            y = x - f.centre
            z = ((y - f.rest) @ w).ravel()
            part = np.tile(explained, m)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, f.n)), _deviation(y, f.n, left).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(z, mask=np.isnan(z)), pa.array(part, mask=np.isnan(part)),
                pa.array([error] * (m * k), pa.float64())], names=[c.split()[0] for c in OUT.split(", ")])

    return narrow.mapInArrow(run, OUT)
