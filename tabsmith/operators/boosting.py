"""Second-order histogram boosting (M5, M7, M8) with softmax, logistic or squared loss.

The feature table is turned once into a table of blocks under the shared checkpoint folder: binned
columns, label, weight and margins of some thousand rows per row.  Rows with the same bins (and class)
take the same way through every tree, so where they are many they are added up first to one weighted row
per cell (``_cells``, exact; not with sampled rows); a table of few columns then has at most as many rows as
its bins have combinations, and one of many stays as it is.  A pass over the blocks routes the
rows through the trees grown so far and sums gradients and hessians by (tree, node, feature, bin) for
all classes at once.  Sums of up to ``DIRECT`` bytes from all tasks are added on the driver; larger ones
are added tree-wise (two steps of ``applyInArrow`` beyond ``FAN_IN`` tasks) and only the best split of each
node comes back to the driver, which holds trees, never rows.
Margins are rewritten every ``KEEP`` rounds, so a pass routes rows through at most ``KEEP`` finished
trees and a lost executor re-reads its blocks.
A table of at most ``FEW_ROWS`` rows or cells is one task in every pass, however many rows its cells stand for.  There
a job per pass buys nothing, so one job grows all rounds by the same steps (``TaskGrowth``) and returns the trees.

Growth "level" splits all nodes of a level in one pass.  Growth "leaf" is best-first: a priority queue
of leaves by gain, replayed on the driver; a pass fetches all nodes that the replay would reach, so a
tree of 31 leaves takes about as many passes as it is deep and equals one-leaf-at-a-time growth.

Options: gradient-based sampling keeps the rows with the largest gradients (an exact global
threshold from a fine histogram) and re-weights a drawn share of the others; sparse columns that are
never non-zero together share one column of bins (exact: no conflicts are allowed), while splits
stay those of the single features.

Defined results: rows without a label (or with a class beyond ``n_classes``) and rows of weight 0 or less aren't trained on;
NaN counts as smaller than every number; a constant feature is never split; no rows or one class give a
model without splits; equal gains go to the smaller feature, then the smaller bin; equal scores to
the smaller class.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, HasStepSize, HasWeightCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.ordering import materialize

KEEP = 8                # finished rounds that a pass routes rows through before margins are rewritten
BLOCK_ROWS = 16_384     # rows of a block
FAN_IN = 64             # tasks whose sums meet in one step
CHUNK = 8_192           # histogram cells that travel in one row
CELLS = 8 << 20         # histogram cells (24 bytes) that a task holds; more nodes take further passes
SCORED = 8_192          # rows scored at a time
JOINT = 1 << 12         # cells of columns that are added up together
KNOWN = 1 << 20         # scores that a task keeps
SUMMARY = 2_048         # points of a column's summary
MAX_BINS = 256
DIRECT = 48 << 20       # bytes of sums from all tasks of a pass that the driver adds itself
DIRECT_SPLITS = 20_000  # (node, feature) pairs of a pass that it searches itself
FEW_ROWS = 2 * BLOCK_ROWS      # rows or cells that make one task in any case: with at most CHUNK bins it grows all rounds in one job
CELLS_FROM = FEW_ROWS + 1      # rows from which equal ones are added up,
CELL_SHARE = 0.25       # if that leaves at most this part of them
CELL_CODES = 1 << 50    # combinations of bins that a cell's number may tell apart
HELD = 1 << 18          # rows that a task adds up at a time
MASK_ROWS = 2_048       # rows from which nodes are found by words of 64 ends,
MASK_NODES = 15         # or by masks in trees of at most so many nodes
DE_BRUIJN = np.uint64(0x03F79D71B4CB0A89)      # its products with the powers of 2 differ in their upper 6 bits
ALL_ENDS = np.uint64(0xFFFFFFFFFFFFFFFF)
MAX_BUNDLED = 2_048     # sparse columns considered for sharing (their co-occurrence is a square matrix)
SPARSE = 0.3            # a column may share if at most this part of its values isn't 0


# ---------------------------------------------------------------- trees
@dataclass
class Tree:
    """Flattened binary tree: feature -1 marks a leaf; a row goes right if its value is over ``threshold``."""

    feature: list = field(default_factory=lambda: [-1])
    bin: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])
    cover: list = field(default_factory=lambda: [0.0])
    depth: list = field(default_factory=lambda: [0])

    def child(self, parent: int) -> int:
        for name, v in (("feature", -1), ("bin", 0), ("left", -1), ("right", -1), ("value", 0.0), ("gain", 0.0), ("cover", 0.0),
                        ("depth", self.depth[parent] + 1)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def arrays(self, bins: Bins) -> dict[str, np.ndarray]:
        """The tree over binned columns: a row goes right if low <= bin < high.  A leaf's children (left, right by turns
        in ``kids``) are the leaf itself, so that all rows take ``steps`` steps."""
        f, b = np.array(self.feature), np.array(self.bin)
        g, inner = np.maximum(f, 0), f >= 0
        return {"column": np.where(inner, bins.column[g], 0).astype(np.int32), "low": np.where(inner, bins.offset[g] + b, 0).astype(np.int16),
                "high": np.where(inner, bins.offset[g] + bins.count[g] - 1, 0).astype(np.int16), "kids": _kids(f, self.left, self.right),
                "steps": int(max(self.depth)), "value": np.array(self.value), "shared": bins.shared, "width": bins.width}


def _kids(feature, left, right) -> np.ndarray:
    here = np.arange(len(feature))
    return np.stack([np.where(feature >= 0, left, here), np.where(feature >= 0, right, here)], 1).astype(np.int32).reshape(-1)


def route_codes(columns: np.ndarray, width: np.ndarray) -> list[np.ndarray] | None:
    """What ``route`` reads of many rows, to be shared by the trees that they take; None for few rows."""
    return joint_codes(columns, width, joint_columns(width, 1)) if columns.shape[1] >= MASK_ROWS else None


def route(columns: np.ndarray, tree: dict[str, np.ndarray], codes: list[np.ndarray] | None = None) -> np.ndarray:
    """Leaf (or open node) of each row of binned ``columns`` (columns x rows); ``codes``: their ``route_codes``."""
    n, steps = columns.shape[1], tree["steps"]
    if n >= MASK_ROWS and len(tree["column"]) <= MASK_NODES:
        return _by_masks(columns, tree)
    if codes is None and n >= MASK_ROWS:
        codes = route_codes(columns, tree["width"])
    if codes is None:
        node = np.zeros(n, np.int32)
    else:
        node, steps = _by_words(codes, tree)
    if not steps:
        return node
    at, flat = np.arange(n, dtype=np.int32 if columns.size < 1 << 31 else np.int64), columns.reshape(-1)
    start = tree["column"].astype(at.dtype) * at.dtype.type(n)
    for _ in range(steps):
        v = flat.take(start.take(node) + at)
        goes = v >= tree["low"].take(node)
        if tree["shared"]:           # else the bins from ``low`` on are the column's last ones
            goes &= v < tree["high"].take(node)
        node = tree["kids"].take(2 * node + goes)
    return node


def _by_masks(columns: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """As ``route``, from the last node up: a node's leaf is the right or the left child's, by a byte mask of all rows."""
    kids, found = tree["kids"].tolist(), [np.uint8(i) for i in range(len(tree["column"]))]
    column, low, high = tree["column"].tolist(), tree["low"].tolist(), tree["high"].tolist()
    for i in range(len(found) - 1, -1, -1):
        left, right = kids[2 * i], kids[2 * i + 1]
        if left == i:
            continue
        v = columns[column[i]]
        goes = v >= low[i]
        if tree["shared"]:
            goes &= v < high[i]
        a, b = found[left], found[right]
        found[left] = found[right] = None
        found[i] = a ^ ((a ^ b) & np.negative(goes.view(np.uint8)))
    return found[0] if isinstance(found[0], np.ndarray) else np.full(columns.shape[1], found[0])


def _by_words(codes: list[np.ndarray], tree: dict) -> tuple[np.ndarray, int]:
    """The node of each row in the tree's upper part, and the steps that remain from there.  The ends of that part stand in a word
    from left to right; going right at a node rules out the ends on its left, so that the first end left open is the row's."""
    if "words" not in tree:
        tree["words"] = _words(tree)
    words, node, steps = tree["words"]
    open_ = None
    for code, word in zip(codes, words, strict=True):
        if word is not None:
            left = word.take(code)
            open_ = left if open_ is None else np.bitwise_and(open_, left, out=open_)
    if open_ is None:
        return np.zeros(len(codes[0]), np.int32), steps
    open_ &= np.negative(open_)                  # the lowest bit
    open_ *= DE_BRUIJN
    open_ >>= np.uint64(58)
    return node.take(open_.view(np.int64)), steps


def _words(tree: dict) -> tuple[list[np.ndarray | None], np.ndarray, int]:
    """(per group of columns the ends that each combination of bins leaves open, or None; node of an end by its bit's number; steps below)."""
    kids, column, width = tree["kids"].tolist(), tree["column"].tolist(), tree["width"]
    levels = tree["steps"] if sum(kids[2 * i] == i for i in range(len(column))) <= 64 else 6
    ends: list[int] = []
    word = {}
    todo = [(0, 0, -1)]
    while todo:
        node, depth, first = todo.pop()
        if first < 0:
            if kids[2 * node] == node or depth == levels:
                ends.append(node)
            else:                                # the left part, then this node with the number of ends before it, the right part
                todo += [(kids[2 * node + 1], depth + 1, -1), (node, depth, len(ends)), (kids[2 * node], depth + 1, -1)]
            continue
        c, bins = column[node], np.arange(width[column[node]])
        goes = bins >= tree["low"][node]
        if tree["shared"]:
            goes &= bins < tree["high"][node]
        word.setdefault(c, np.full(len(bins), ALL_ENDS))[goes] &= ~np.uint64(((1 << len(ends) - first) - 1) << first)
    out = []
    for members in joint_columns(width, 1):
        have = None
        if any(c in word for c in members):
            have = np.full(1, ALL_ENDS)
            for c in members:
                have = (have[:, None] & word.get(c, np.full(int(width[c]), ALL_ENDS))).reshape(-1)
        out.append(have)
    place = np.zeros(64, np.int32)
    for i, node in enumerate(ends):
        place[(((1 << i) * int(DE_BRUIJN)) & int(ALL_ENDS)) >> 58] = node
    return out, place, tree["steps"] - levels


def stepped(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A flattened tree over values, in the form that ``route_values`` walks."""
    feature = np.asarray(tree["feature"])
    left, right = np.asarray(tree["left"]), np.asarray(tree["right"])
    steps, level = 0, np.zeros(1, np.int64)
    while len(level := level[feature[level] >= 0]):
        steps, level = steps + 1, np.concatenate([left[level], right[level]])
    return {"column": np.maximum(feature, 0).astype(np.int64), "threshold": np.asarray(tree["threshold"], np.float64),
            "kids": _kids(feature, left, right), "steps": steps, "value": tree.get("value")}


def route_values(x: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """Leaf of each row of ``x`` (features x rows, contiguous), for a tree from ``stepped``; NaN goes left."""
    n = x.shape[1]
    node, at, flat, start = np.zeros(n, np.int32), np.arange(n), x.reshape(-1), tree["column"] * n
    for _ in range(tree["steps"]):
        goes = flat.take(start.take(node) + at) > tree["threshold"].take(node)
        node = tree["kids"].take(2 * node + goes)
    return node


# ---------------------------------------------------------------- bins
@dataclass
class Bins:
    """Cut points of each feature, and the column of bins that it lives in.  Bin j of a feature (0: up to its first
    cut) stands as j in a column of its own; in a shared one bins from 1 on stand from ``offset + 1`` and 0 means 0 for all."""

    edges: list[np.ndarray]
    column: np.ndarray
    offset: np.ndarray      # physical bin of the feature's bin 1
    count: np.ndarray       # physical bins of the feature, plus 1
    width: np.ndarray       # physical bins of each column
    shared: bool = False    # whether a column holds more than one feature

    @classmethod
    def build(cls, edges: list[np.ndarray], groups: list[list[int]]) -> Bins:
        d = len(edges)
        column, offset, count, width = (np.zeros(d, np.int64) for _ in range(4))
        wide = []
        for c, members in enumerate(groups):
            at = 1
            for f in members:
                column[f], offset[f], count[f] = c, at, len(edges[f]) + 1
                at += len(edges[f])
            wide.append(at)
        return cls(edges, column, offset, count, np.array(wide, np.int64), any(len(m) > 1 for m in groups))

    def binned(self, x: np.ndarray) -> np.ndarray:
        """uint8 columns (columns x rows)."""
        out = np.zeros((len(self.width), len(x)), np.uint8)
        for f, e in enumerate(self.edges):
            if len(e):
                b = np.searchsorted(e, x[:, f], side="left")
                b[np.isnan(x[:, f])] = 0
                hit = b > 0
                out[self.column[f], hit] = b[hit] + self.offset[f] - 1
        return out


def _compressed(value: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their counts; beyond ``most`` neighbours are merged into their largest value."""
    v, back = np.unique(value, return_inverse=True)
    c = np.bincount(back, count, len(v)).astype(np.int64)
    if len(v) > most:
        cell = np.minimum((np.cumsum(c) - 1) * most // c.sum(), most - 1)
        last = np.flatnonzero(np.diff(cell, append=cell[-1] + 1))
        c = np.add.reduceat(c, np.concatenate([[0], last[:-1] + 1]))
        v = v[last]
    return v, c


def cut_points(value: np.ndarray, count: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values so that bins hold about equally many rows; every value its own bin if there are few."""
    if len(value) < 2:
        return np.zeros(0)
    with np.errstate(invalid="ignore"):
        mid = (value[:-1] + value[1:]) / 2
    mid = np.where(mid < value[1:], mid, value[:-1])
    if len(value) <= bins:
        return mid
    cell = (np.cumsum(count) * bins - 1) // count.sum()
    return mid[np.flatnonzero(np.diff(cell) > 0)][: bins - 1]


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _salted(frame: DataFrame) -> DataFrame:
    return frame.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))


def column_summaries(x: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per feature its values and counts (at most SUMMARY points), merged tree-wise; ``x`` has one array column."""
    schema = "feature long, value array<double>, n array<long>"

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v for v, _ in held.values()], pa.list_(pa.float64())),
                                           pa.array([c for _, c in held.values()], pa.list_(pa.int64()))], names=["feature", "value", "n"])

    def summarise(batches):
        held: dict[int, tuple] = {}
        for b in batches:
            m = _matrix(b.column(0))
            for f in range(m.shape[1]):
                v = np.where(np.isnan(m[:, f]), -np.inf, m[:, f])
                old = held.get(f, (np.zeros(0), np.zeros(0, np.int64)))
                held[f] = _compressed(np.concatenate([old[0], v]), np.concatenate([old[1], np.ones(len(v), np.int64)]), 4 * SUMMARY)
        yield rows(held)

    def merge(table: pa.Table) -> pa.Table:
        v, c = _compressed(np.concatenate([np.asarray(a) for a in table["value"].to_pylist()]),
                           np.concatenate([np.asarray(a, np.int64) for a in table["n"].to_pylist()]), SUMMARY)
        return pa.Table.from_batches([rows({table["feature"][0].as_py(): (v, c)})])

    part = _salted(x.mapInArrow(summarise, schema)).groupBy("feature", "part").applyInArrow(merge, schema)
    return {r["feature"]: (np.array(r["value"]), np.array(r["n"], np.int64))
            for r in part.groupBy("feature").applyInArrow(merge, schema).toLocalIterator()}


def exclusive_groups(x: DataFrame, edges: list[np.ndarray], summary: dict) -> list[list[int]]:
    """Columns of bins: sparse features that are never non-zero in the same row share one, greedily, the fullest first."""
    d = len(edges)
    share = {}
    for f, (v, c) in summary.items():
        if len(v) > 1 and v[0] == 0 and len(edges[f]) < MAX_BINS // 2 and c[1:].sum() <= SPARSE * c.sum():
            share[f] = int(c[1:].sum())
    chosen = sorted(sorted(share, key=lambda f: -share[f])[:MAX_BUNDLED])
    if len(chosen) < 2:
        return [[f] for f in range(d)]

    def together(batches):
        total = np.zeros((len(chosen), len(chosen)))
        for b in batches:
            m = _matrix(b.column(0))
            if len(m):
                on = (m[:, chosen] != 0).astype(np.float32)
                total += on.T @ on
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(chosen))), pa.array(list(total > 0), pa.list_(pa.bool_()))], names=["i", "met"])

    def either(table: pa.Table) -> pa.Table:
        met = np.array(table["met"].to_pylist(), bool).any(0)
        return pa.table({"i": pa.array([table["i"][0].as_py()], pa.int64()), "met": pa.array([met], pa.list_(pa.bool_()))})

    schema = "i long, met array<boolean>"
    part = _salted(x.mapInArrow(together, schema)).groupBy("i", "part").applyInArrow(either, schema)
    met = {r["i"]: np.array(r["met"], bool) for r in part.groupBy("i").applyInArrow(either, schema).toLocalIterator()}
    bundles: list[tuple[list[int], int]] = []
    for i in sorted(range(len(chosen)), key=lambda i: (-share[chosen[i]], chosen[i])):
        need = len(edges[chosen[i]])
        for k, (members, size) in enumerate(bundles):
            if size + need < MAX_BINS and not met[i][members].any():
                bundles[k] = (members + [i], size + need)
                break
        else:
            bundles.append(([i], need))
    shared = [[chosen[i] for i in members] for members, _ in bundles]
    return [[f] for f in range(d) if f not in set(chosen)] + shared


# ---------------------------------------------------------------- losses
def gradients(loss: str, margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives, one row per tree of a round; ``margin`` is (trees, rows)."""
    if loss == "squared":
        return w * (margin - y), np.broadcast_to(w, margin.shape)
    if loss == "logistic":
        p = 1 / (1 + np.exp(-margin))
        return w * (p - y), w * np.maximum(p * (1 - p), 1e-16)
    p = softmax(margin)
    return w * (p - (np.arange(len(margin))[:, None] == y)), w * np.maximum(p * (1 - p), 1e-16)


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(0))
    return e / e.sum(0)


# ---------------------------------------------------------------- passes over the blocks
@dataclass
class Round:
    """What a pass needs: trees to add to the margins, the round's open trees, sampling."""

    loss: str
    done: list[list[dict]]                 # finished rounds since the margins were written: trees over binned columns
    trees: list[dict] = field(default_factory=list)
    wanted: list[np.ndarray] = field(default_factory=list)   # per tree: node -> place among the wanted ones, or -1
    number: int = 0
    seed: int = 0
    subsample: float = 1.0
    top: float | None = None               # rows with a larger absolute gradient are kept,
    rest: float = 0.0                      # of the others this share, weighted by ``boost``
    boost: float = 1.0


@dataclass
class Block:
    id: int
    columns: np.ndarray
    y: np.ndarray
    w: np.ndarray
    count: np.ndarray       # rows of the table that a row stands for
    margin: np.ndarray
    codes: list[np.ndarray] | None = None   # ``route_codes`` of the columns


BLOCKS = "block long, columns binary, y binary, w binary, count binary, margin binary"


def _block_batch(number: int, columns: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (columns, *rest)]],
                                      names=[f.split()[0] for f in BLOCKS.split(", ")])


def _blocks(batches, r: Round, n_columns: int, with_margin=True):
    for b in batches:
        for row in b.to_pylist():
            y = np.frombuffer(row["y"])
            block = Block(row["block"], np.frombuffer(row["columns"], np.uint8).reshape(n_columns, len(y)), y, np.frombuffer(row["w"]),
                          np.frombuffer(row["count"]), np.frombuffer(row["margin"]).reshape(-1, len(y)))
            if r.done:
                block.margin, block.codes = block.margin.copy(), route_codes(block.columns, r.done[0][0]["width"])
                for trees in r.done:
                    for k, t in enumerate(trees):
                        block.margin[k] += t["value"].take(route(block.columns, t, block.codes))
            yield block


def _sampled(block: Block, r: Round, g: np.ndarray) -> np.ndarray | None:
    """Weight of each row in this round: None for all 1."""
    if r.subsample >= 1 and r.top is None:
        return None
    draw = np.random.default_rng([r.seed, r.number, block.id]).random(len(block.y))
    if r.top is None:
        return (draw < r.subsample).astype(np.float64)
    return np.where(np.abs(g).sum(0) > r.top, 1.0, np.where(draw < r.rest, r.boost, 0.0))


def joint_columns(width: np.ndarray, nodes: int) -> list[list[int]]:
    """Columns to add up together, by combinations of their bins: as many as leave ``JOINT`` cells of all nodes, the widest first.
    A row then counts once for several columns."""
    groups: list[tuple[list[int], int]] = []
    for c in sorted(range(len(width)), key=lambda c: (-width[c], c)):
        for i, (members, cells) in enumerate(groups):
            if cells * int(width[c]) * nodes <= JOINT:
                groups[i] = (members + [c], cells * int(width[c]))
                break
        else:
            groups.append(([c], int(width[c])))
    return [members for members, _ in groups]


def joint_cells(width: np.ndarray, groups: list[list[int]]) -> list[int]:
    return [int(np.prod(width[members])) for members in groups]


def joint_codes(columns: np.ndarray, width: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    """Per group of columns the number of each row's combination."""
    out = []
    for members in groups:
        code = columns[members[0]]
        for c in members[1:]:
            code = code * np.int32(width[c]) + columns[c] if code.dtype != np.uint8 else code.astype(np.int32) * np.int32(width[c]) + columns[c]
        out.append(code)
    return out


def apart(sums: list[np.ndarray], width: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """Sums (3, nodes, bins of all columns) from those (3, nodes * combinations) of the groups."""
    parts: list[np.ndarray] = [np.zeros(0)] * len(width)
    for members, total in zip(groups, sums, strict=True):
        total = total.reshape(3, -1, *width[members].tolist())
        for i, c in enumerate(members):
            parts[c] = total.sum(tuple(2 + j for j in range(len(members)) if j != i))
    return np.concatenate(parts, 2)


def _histograms(blocks, r: Round, width: np.ndarray) -> list[np.ndarray | None]:
    """Sums of g, h and rows (3, wanted nodes, bins) of each tree over ``blocks``; None for a tree without wanted nodes."""
    most = max((int(p.max()) + 1 for p in r.wanted if len(p)), default=0)
    ways = ([[c] for c in range(len(width))], joint_columns(width, max(most, 1)))       # blocks of few rows: each column by itself
    held: list[list | None] = [None, None]
    for block in blocks:
        g, h = gradients(r.loss, block.margin, block.y, block.w)
        s = _sampled(block, r, g)
        one = s is None and r.loss == "squared" and np.array_equal(block.w, block.count)      # then the sums of h are those of rows
        way = int(len(block.y) >= MASK_ROWS)
        groups, cells = ways[way], joint_cells(width, ways[way])
        if held[way] is None:
            held[way] = [[np.zeros((3, (int(p.max()) + 1) * n)) for n in cells] if len(p) and p.max() >= 0 else None for p in r.wanted]
        sums = held[way]
        joint = joint_codes(block.columns, width, groups)
        codes = route_codes(block.columns, width) if block.codes is None else block.codes
        for k, total in enumerate(sums):
            if total is None:
                continue
            at = r.wanted[k].take(route(block.columns, r.trees[k], codes))
            use = at >= 0 if s is None else (at >= 0) & (s > 0)
            mine, gk, hk, ck = joint, g[k], h[k], block.count
            if s is not None:
                gk, hk = gk * s, hk * s
            if not use.all():
                at, mine, gk, hk, ck = at[use], [c[use] for c in joint], gk[use], hk[use], ck[use]
            for code, n, part in zip(mine, cells, total, strict=True):
                cell = at * n
                cell += code
                for q, v in enumerate((gk, hk, ck)):
                    if q == 2 and one:
                        part[2] = part[1]
                    else:
                        part[q] += np.bincount(cell, v, part.shape[1])
    out = []
    for k, p in enumerate(r.wanted):
        found = [apart(sums[k], width, groups) for groups, sums in zip(ways, held, strict=True) if sums is not None] if len(p) and p.max() >= 0 else None
        out.append(sum(found) if found else None if found is None else np.zeros((3, int(p.max()) + 1, int(width.sum()))))
    return out


def _histogram_rows(r: Round, width: np.ndarray, chunks: list[np.ndarray], whole: bool = False):
    """Task body: one row per (tree, wanted node, chunk of columns) with its sums of g, h and rows; ``whole``: one per tree."""
    def run(batches):
        base = np.cumsum(width) - width
        for k, total in enumerate(_histograms(_blocks(batches, r, len(width)), r, width)):
            if total is None:
                continue
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total.tobytes()], pa.binary())], names=["tree", "sums"])
                continue
            nodes = np.flatnonzero(r.wanted[k] >= 0)
            for q, columns in enumerate(chunks):
                lo, hi = base[columns[0]], base[columns[-1]] + width[columns[-1]]
                cells = total[:, r.wanted[k][nodes], lo:hi].transpose(1, 0, 2).reshape(len(nodes), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(nodes), k)), pa.array(nodes), pa.array(np.full(len(nodes), q)), pa.array(list(cells), pa.list_(pa.float64()))],
                    names=["tree", "node", "chunk", "sums"])
    return run


SUMS = "tree long, node long, chunk long, sums array<double>"
BEST = "tree long, node long, feature long, bin long, gain double, gl double, hl double, cl double, g double, h double, c double"


def _total(table: pa.Table) -> np.ndarray:
    column = table["sums"].combine_chunks()
    return column.flatten().to_numpy().reshape(len(table), -1).sum(0)


def _add(table: pa.Table) -> pa.Table:
    keys = {k: pa.array([table[k][0].as_py()], pa.int64()) for k in ("tree", "node", "chunk")}
    return pa.table(keys | {"sums": pa.array([_total(table)], pa.list_(pa.float64()))})


def best_split(total: np.ndarray, bins: Bins, features: np.ndarray, base: np.ndarray, allowed: np.ndarray, l2: float,
               least_h: float, least_rows: float) -> tuple:
    """(feature, bin, gain, gl, hl, cl, g, h, c) from the sums (3, cells) of one node; feature -1 without a valid split."""
    first = features[0]
    lo = base[bins.column[first]]
    g, h, c = total[:, lo:lo + bins.width[bins.column[first]]].sum(1)
    best = (-1, 0, 0.0, 0.0, 0.0, 0.0, g, h, c)
    parent = g * g / (h + l2) if h + l2 > 0 else 0.0
    for f in features:
        n = bins.count[f] - 1
        if not n or not allowed[f]:
            continue
        at = base[bins.column[f]] + bins.offset[f]
        right = np.cumsum(total[:, at:at + n][:, ::-1], axis=1)[:, ::-1]      # split at bin t: bins t+1.. go right
        left = np.array([[g], [h], [c]]) - right
        ok = (left[1] >= least_h) & (right[1] >= least_h) & (left[2] >= least_rows) & (right[2] >= least_rows) & (left[1] + l2 > 0) & (right[1] + l2 > 0)
        if not ok.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - parent, -np.inf)
        t = int(gain.argmax())
        if gain[t] > best[2] + 1e-12 * abs(parent):
            best = (int(f), t, float(gain[t]), *(float(x) for x in left[:, t]), g, h, c)
    return best


def best_splits(total: np.ndarray, bins: Bins, allowed: np.ndarray, l2: float, least_h: float, least_rows: float) -> list[tuple]:
    """``best_split`` of many nodes at once, from their sums (3, nodes, cells) over all columns."""
    base = np.cumsum(bins.width) - bins.width
    g, h, c = total[:, :, :bins.width[0]].sum(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        parent = np.where(h + l2 > 0, g * g / (h + l2), 0.0)
    m = np.arange(len(g))
    feature, cut, gain, left3 = np.full(len(g), -1), np.zeros(len(g), np.int64), np.zeros(len(g)), np.zeros((3, len(g)))
    for f in np.flatnonzero(allowed & (bins.count > 1)):
        n = bins.count[f] - 1
        at = base[bins.column[f]] + bins.offset[f]
        right = np.cumsum(total[:, :, at:at + n][:, :, ::-1], axis=2)[:, :, ::-1]
        left = np.stack([g, h, c])[:, :, None] - right
        ok = (left[1] >= least_h) & (right[1] >= least_h) & (left[2] >= least_rows) & (right[2] >= least_rows) & (left[1] + l2 > 0) & (right[1] + l2 > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            found = np.where(ok, left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - parent[:, None], -np.inf)
        t = found.argmax(1)
        better = found[m, t] > gain + 1e-12 * np.abs(parent)
        feature[better], cut[better], gain[better] = f, t[better], found[m, t][better]
        left3[:, better] = left[:, m, t][:, better]
    return [(int(feature[i]), int(cut[i]), float(gain[i]), *(float(v) for v in left3[:, i]), float(g[i]), float(h[i]), float(c[i])) for i in range(len(g))]


def _split_rows(bins: Bins, chunks: list[np.ndarray], allowed: np.ndarray, l2: float, least_h: float, least_rows: float):
    def run(table: pa.Table) -> pa.Table:
        columns = chunks[table["chunk"][0].as_py()]
        width = bins.width[columns]
        base = np.zeros(len(bins.width), np.int64)
        base[columns] = np.cumsum(width) - width
        features = np.flatnonzero(np.isin(bins.column, columns))
        found = best_split(_total(table).reshape(3, -1), bins, features, base, allowed, l2, least_h, least_rows)
        row = [table["tree"][0].as_py(), table["node"][0].as_py(), *found]
        return pa.table({f.split()[0]: pa.array([v], pa.int64() if f.endswith("long") else pa.float64())
                         for f, v in zip(BEST.split(", "), row, strict=True)})
    return run


# ---------------------------------------------------------------- blocks of rows or cells
def _columns(m: np.ndarray, bins: Bins) -> np.ndarray:
    return bins.binned(m if m.shape[1] else np.zeros((len(m), len(bins.edges))))


def _row_blocks(rows: DataFrame, bins: Bins, start: np.ndarray) -> DataFrame:
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for k in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(k, BLOCK_ROWS)
                y = np.asarray(part.column(1), np.float64)
                yield _block_batch(number, _columns(_matrix(part.column(0)), bins), y, np.asarray(part.column(2), np.float64), np.ones(len(y)),
                                   np.repeat(start[:, None], len(y), 1))
                number += 1

    return rows.mapInArrow(run, BLOCKS)


def _radix(bins: Bins) -> np.ndarray | None:
    """What each column counts in a cell's number; None if there are too many combinations."""
    step, out = 1, []
    for w in bins.width.tolist():
        out.append(step)
        step *= w
        if step > CELL_CODES:
            return None
    return np.array(out, np.int64)


def _codes(columns: np.ndarray, radix: np.ndarray) -> np.ndarray:
    code = np.zeros(columns.shape[1], np.int64)
    for c, step in zip(columns, radix, strict=True):
        code += c.astype(np.int64) * step
    return code


CELL = "code long, y double, w double, wy double, n double"


def _added(code: np.ndarray, y: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (code, y) and their sums (quantities x rows)."""
    classes, kind = np.unique(y, return_inverse=True)
    if len(classes) > 1:
        order = np.lexsort((kind, code))
        new = np.concatenate([[True], (np.diff(code[order]) != 0) | (np.diff(kind[order]) != 0)])
        place = np.cumsum(new) - 1
        code, y, sums = code[order], y[order], sums[:, order]
        return code[new], y[new], np.stack([np.bincount(place, v) for v in sums])
    code, place = np.unique(code, return_inverse=True)
    return code, np.full(len(code), y[0]), np.stack([np.bincount(place, v, len(code)) for v in sums])


def _cells(rows: DataFrame, bins: Bins, mean: bool) -> DataFrame | None:
    """(code, y, w, n): rows of the same bins and the same label (``mean``: of any label, with the mean one) added up;
    None where that wouldn't leave clearly fewer rows."""
    radix, n = _radix(bins), rows.count()
    if radix is None or n < CELLS_FROM or not len(bins.width):
        return None
    most = int(radix[-1] * bins.width[-1])

    def codes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_codes(_columns(_matrix(b.column(0)), bins), radix))], names=["code"])

    if most > CELL_SHARE * n and rows.mapInArrow(codes, "code long").agg(F.approx_count_distinct("code")).first()[0] > CELL_SHARE * n:
        return None

    def add(batches):
        held, size = [], 0

        def together():
            return _added(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held], 1))

        def batch(code, y, sums):
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(y), *[pa.array(v) for v in sums]], names=[f.split()[0] for f in CELL.split(", ")])

        for b in batches:
            if not b.num_rows:
                continue
            y, w = np.asarray(b.column(1), np.float64), np.asarray(b.column(2), np.float64)
            held.append((_codes(_columns(_matrix(b.column(0)), bins), radix), np.zeros(len(y)) if mean else y, np.stack([w, w * y, np.ones(len(y))])))
            size += len(y)
            if size >= 2 * HELD:
                held = [together()]
                size = len(held[0][0])
                if size >= HELD:          # too many different ones to hold
                    yield batch(*held[0])
                    held, size = [], 0
        if held:
            yield batch(*together())

    cells = rows.mapInArrow(add, CELL).groupBy("code", "y").agg(*[F.sum(c).alias(c) for c in ("w", "wy", "n")])
    return cells.select("code", (F.col("wy") / F.col("w") if mean else F.col("y")).alias("y"), "w", "n")


def _cell_blocks(cells: DataFrame, bins: Bins, start: np.ndarray) -> DataFrame:
    radix = _radix(bins)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            code, y, w, n = (np.asarray(b.column(i)) for i in range(4))
            if len(code):
                columns = ((code[None, :] // radix[:, None]) % bins.width[:, None]).astype(np.uint8)
                yield _block_batch(number, columns, y, w, n, np.repeat(start[:, None], len(y), 1))
                number += 1

    return cells.mapInArrow(run, BLOCKS)


# ---------------------------------------------------------------- fitting
@dataclass
class Settings:
    loss: str
    n_trees: int            # trees of a round: classes, or 1
    rounds: int
    rate: float
    growth: str             # "level" or "leaf"
    depth: int
    leaves: int
    l2: float
    least_h: float
    least_rows: float
    bins: int
    subsample: float
    feature_share: float
    top_share: float        # gradient-based sampling: kept share (0: off) and drawn share
    other_share: float
    bundle: bool
    seed: int


def _gradient_cells(blocks, r: Round) -> np.ndarray:
    """Rows by the upper half of the float pattern of their summed absolute gradients."""
    total = np.zeros(1 << 16, np.int64)
    for block in blocks:
        g = np.abs(gradients(r.loss, block.margin, block.y, block.w)[0]).sum(0)
        total += np.bincount((g.astype(np.float32).view(np.uint32) >> 16).astype(np.int64), minlength=1 << 16)
    return total


class Growth:
    """Rounds and trees from the sums of passes.  The subclass has the rows: it makes a pass (``_pass``), adds finished
    rounds to the margins (``_rewrite``) and finds the threshold of gradient-based sampling (``_gradient_threshold``)."""

    @property
    def keep(self) -> int:
        return KEEP

    def __init__(self, s: Settings, bins: Bins):
        self.s, self.bins, self.d = s, bins, len(bins.edges)
        self.done: list[list[dict]] = []
        self.trees: list[list[Tree]] = []

    def _round(self, r: Round, wanted: dict[int, list[int]], trees: list[Tree]) -> None:
        r.trees = [t.arrays(self.bins) for t in trees]
        r.wanted = []
        for k, t in enumerate(trees):
            place = np.full(len(t.feature), -1, np.int64)
            place[wanted.get(k, [])] = np.arange(len(wanted.get(k, [])))
            r.wanted.append(place)

    def _found(self, total: dict[int, np.ndarray], wanted: dict[int, list[int]], allowed: np.ndarray) -> dict[tuple[int, int], tuple]:
        s = self.s
        return {(k, node): found for k, sums in total.items()
                for node, found in zip(wanted[k], best_splits(sums, self.bins, allowed, s.l2, s.least_h, s.least_rows), strict=True)}

    def _threshold(self, counts: list[tuple[int, int]]) -> float:
        """The sum of absolute gradients that the kept share exceeds, from (cell, rows), the largest cell first."""
        left, seen = self.s.top_share * sum(n for _, n in counts), 0
        for cell, n in counts:
            seen += n
            if seen >= left:
                return float(np.array([cell << 16], np.uint32).view(np.float32)[0])
        return 0.0

    def _splits(self, r: Round, wanted: dict[int, list[int]], trees: list[Tree], allowed: np.ndarray) -> dict[tuple[int, int], tuple]:
        """Best split of each wanted (tree, node), in passes whose sums fit a task."""
        nodes = [(k, n) for k, some in wanted.items() for n in some]
        most, best = max(1, CELLS // int(self.bins.width.sum())), {}
        for i in range(0, len(nodes), most):
            part: dict[int, list[int]] = {}
            for k, n in nodes[i:i + most]:
                part.setdefault(k, []).append(n)
            best |= self._pass(r, part, trees, allowed)
        return best

    def _expand(self, t: Tree, node: int, found: tuple) -> list[int]:
        """Make ``node`` an inner one; its children."""
        feature, b, gain, gl, hl, cl, g, h, c = found
        t.feature[node], t.bin[node], t.gain[node] = feature, b, gain
        if t.left[node] < 0:
            t.left[node], t.right[node] = t.child(node), t.child(node)
        for child, (gg, hh, cc) in ((t.left[node], (gl, hl, cl)), (t.right[node], (g - gl, h - hl, c - cl))):
            t.value[child], t.cover[child] = self._value(gg, hh), cc
        return [t.left[node], t.right[node]]

    def _value(self, g: float, h: float) -> float:
        return -g / (h + self.s.l2) * self.s.rate if h + self.s.l2 > 0 else 0.0

    def grow(self, r: Round, allowed: np.ndarray) -> list[Tree]:
        s = self.s
        trees = [Tree() for _ in range(s.n_trees)]
        known: dict[tuple[int, int], tuple] = {}
        wanted = {k: [0] for k in range(s.n_trees)}
        chosen: list[list[int]] = [[] for _ in trees]
        while wanted:
            known |= self._splits(r, wanted, trees, allowed)
            for k, t in enumerate(trees):
                if 0 in wanted.get(k, ()) and (k, 0) in known:
                    t.value[0], t.cover[0] = self._value(*known[k, 0][6:8]), known[k, 0][8]
            wanted = {}
            for k, t in enumerate(trees):
                chosen[k], missing = self._replay(k, t, known)
                if missing:
                    wanted[k] = missing
        return [_pruned(t, set(c)) for t, c in zip(trees, chosen, strict=True)]

    def _replay(self, k: int, t: Tree, known: dict) -> tuple[list[int], list[int]]:
        """Grow tree ``k`` from the splits known so far, best gain first; (split nodes in order, nodes whose split is needed)."""
        s = self.s
        by_level = s.growth == "level"
        queue = [(t.depth[0] if by_level else -known[k, 0][2], 0)] if (k, 0) in known and known[k, 0][0] >= 0 else []
        order, missing = [], []
        while queue and (by_level or len(order) + 1 < s.leaves):
            _, node = heapq.heappop(queue)
            order.append(node)
            for child in self._expand(t, node, known[k, node]):
                if t.depth[child] >= s.depth or t.cover[child] < 2 * s.least_rows:
                    continue
                found = known.get((k, child))
                if found is None:
                    missing.append(child)
                elif found[0] >= 0:
                    heapq.heappush(queue, (t.depth[child] if by_level else -found[2], child))
        if len(order) + 1 >= s.leaves and not by_level:
            missing = [m for m in missing if self._could_matter(k, m, order, t, known)]
        return order, missing

    @staticmethod
    def _could_matter(k: int, node: int, order: list[int], t: Tree, known: dict) -> bool:
        """A node without a known split matters unless it became a leaf with the last split of a full tree."""
        return node not in (t.left[order[-1]], t.right[order[-1]])

    def run(self) -> list[list[Tree]]:
        s = self.s
        rng = np.random.default_rng(s.seed)
        for number in range(s.rounds if self.d else 0):
            r = Round(s.loss, self.done, number=number, seed=s.seed, subsample=s.subsample)
            if s.top_share > 0 and number >= 1 / s.rate:       # the first rounds see all rows
                r.top, r.rest = self._gradient_threshold(r), s.other_share / (1 - s.top_share)
                r.boost = 1 / r.rest
            allowed = np.ones(self.d, bool)
            if s.feature_share < 1:
                allowed[rng.permutation(self.d)[max(1, round(self.d * s.feature_share)):]] = False
            trees = self.grow(r, allowed)
            self.trees.append(trees)
            if all(len(t.feature) == 1 for t in trees) and s.subsample >= 1 and s.feature_share >= 1:
                break
            self.done.append([t.arrays(self.bins) for t in trees])
            if len(self.done) >= self.keep:
                self._rewrite()
        return self.trees


class TaskGrowth(Growth):
    """Grows the trees on the blocks that one task holds."""

    keep = 1

    def __init__(self, s: Settings, bins: Bins, blocks: list[Block]):
        super().__init__(s, bins)
        self.blocks = blocks
        for b in blocks:
            b.margin = b.margin.copy()

    def _rewrite(self) -> None:
        for b in self.blocks:
            for trees in self.done:
                for k, t in enumerate(trees):
                    b.margin[k] += t["value"][route(b.columns, t)]
        self.done = []

    def _gradient_threshold(self, r: Round) -> float:
        total = _gradient_cells(self.blocks, r)
        return self._threshold([(int(c), int(total[c])) for c in np.flatnonzero(total)[::-1]])

    def _pass(self, r: Round, wanted: dict[int, list[int]], trees: list[Tree], allowed: np.ndarray) -> dict[tuple[int, int], tuple]:
        self._round(r, wanted, trees)
        sums = _histograms(self.blocks, r, self.bins.width)
        return self._found({k: total for k, total in enumerate(sums) if total is not None}, wanted, allowed)


GROWN = "round long, tree long, node long, feature long, bin long, left long, right long, value double, gain double, cover double, depth long"


def _grown(s: Settings, bins: Bins):
    """Task body: all rounds on the task's blocks, one row per node."""
    def run(batches):
        trees = TaskGrowth(s, bins, list(_blocks(batches, Round(s.loss, []), len(bins.width)))).run()
        names = [c.split() for c in GROWN.split(", ")]
        for i, group in enumerate(trees):
            rows = [(i, k, n, *(getattr(t, c)[n] for c, _ in names[3:])) for k, t in enumerate(group) for n in range(len(t.feature))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64() if kind == "long" else pa.float64())
                                              for j, (_, kind) in enumerate(names)], names=[c for c, _ in names])
    return run


class Fitting(Growth):
    """Grows the trees; rows stay in the blocks."""

    def __init__(self, rows: DataFrame, s: Settings, start: np.ndarray):
        """``rows``: x array<double>, y double, w double."""
        self.spark = rows.sparkSession
        summary = column_summaries(rows.select("x"))
        d = 1 + max(summary, default=-1)
        edges = [cut_points(*summary[f], min(s.bins, MAX_BINS - 1)) if f in summary else np.zeros(0) for f in range(d)]
        groups = exclusive_groups(rows.select("x"), edges, summary) if s.bundle else [[f] for f in range(d)]
        super().__init__(s, Bins.build(edges, groups))
        cell = np.cumsum(self.bins.width)
        self.chunks = [c for c in np.split(np.arange(len(cell)), np.flatnonzero(np.diff((cell - 1) // CHUNK)) + 1) if len(c)]
        self.blocks: DataFrame | None = None
        cells = _cells(rows, self.bins, s.loss == "squared") if s.subsample >= 1 and s.top_share == 0 else None
        self._read(_row_blocks(rows, self.bins, start) if cells is None else _cell_blocks(cells, self.bins, start))

    def _read(self, blocks: DataFrame) -> None:
        """Write the blocks and keep them in memory as far as it reaches: one task per two blocks at least,
        so that a small table doesn't cost a stage of tiny tasks in each of hundreds of passes."""
        written = materialize(blocks, "boost-blocks")
        n, rows = written.agg(F.count(F.lit(1)), F.sum(F.octet_length("y"))).first()
        self.rows = (rows or 0) // 8
        few = 1 if self._fits_a_task() else max(1, min(written.rdd.getNumPartitions(), -(-n // 2)))
        if self.blocks is not None:
            self.blocks.unpersist()
        self.blocks = written.coalesce(few).persist(StorageLevel.MEMORY_AND_DISK)
        self.tasks = few

    def _rewrite(self) -> None:
        r, n_columns = Round(self.s.loss, self.done), len(self.bins.width)

        def run(batches):
            for block in _blocks(batches, r, n_columns):
                yield _block_batch(block.id, block.columns, block.y, block.w, block.count, block.margin)

        self._read(self.blocks.mapInArrow(run, self.blocks.schema))
        self.done = []

    def _gradient_threshold(self, r: Round) -> float:
        """Sum of absolute gradients that the kept share exceeds: from a histogram of 2^16 cells over their float pattern."""
        n_columns = len(self.bins.width)

        def run(batches):
            total = _gradient_cells(_blocks(batches, r, n_columns), r)
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

        got = self.blocks.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy(F.desc("cell")).collect()
        return self._threshold([(x["cell"], x["n"]) for x in got])

    def _pass(self, r: Round, wanted: dict[int, list[int]], trees: list[Tree], allowed: np.ndarray) -> dict[tuple[int, int], tuple]:
        s = self.s
        self._round(r, wanted, trees)
        n, width = sum(len(v) for v in wanted.values()), int(self.bins.width.sum())
        if self.tasks * n * width * 24 <= DIRECT and n * self.d <= DIRECT_SPLITS:
            total: dict[int, np.ndarray] = {}
            for x in self.blocks.mapInArrow(_histogram_rows(r, self.bins.width, self.chunks, True), "tree long, sums binary").collect():
                part = np.frombuffer(x["sums"]).reshape(3, -1, width)
                total[x["tree"]] = total[x["tree"]] + part if x["tree"] in total else part
            return self._found(total, wanted, allowed)
        sums = self.blocks.mapInArrow(_histogram_rows(r, self.bins.width, self.chunks), SUMS)
        if self.tasks > FAN_IN:
            sums = _salted(sums).groupBy("tree", "node", "chunk", "part").applyInArrow(_add, SUMS)
        found = sums.groupBy("tree", "node", "chunk").applyInArrow(
            _split_rows(self.bins, self.chunks, allowed, s.l2, s.least_h, s.least_rows), BEST).collect()
        best: dict[tuple[int, int], tuple] = {}
        for x in sorted(found, key=lambda x: (x["gain"], -x["feature"])):
            best[x["tree"], x["node"]] = tuple(x)[2:]
        return best

    def run(self) -> list[list[Tree]]:
        if self._fits_a_task():
            self.trees = self._grown_in_a_task()
        else:
            super().run()
        self.blocks.unpersist()
        return self.trees

    def _fits_a_task(self) -> bool:
        return 0 < self.rows <= FEW_ROWS and int(self.bins.width.sum()) <= CHUNK

    def _grown_in_a_task(self) -> list[list[Tree]]:
        trees: list[list[Tree]] = []
        for x in sorted(self.blocks.mapInArrow(_grown(self.s, self.bins), GROWN).collect(), key=lambda x: tuple(x)[:3]):
            if x["round"] == len(trees):
                trees.append([Tree() for _ in range(self.s.n_trees)])
            t = trees[x["round"]][x["tree"]]
            for name in ("feature", "bin", "left", "right", "value", "gain", "cover", "depth"):
                column = getattr(t, name)
                if x["node"] == len(column):
                    column.append(x[name])
                else:
                    column[x["node"]] = x[name]
        return trees


def _pruned(t: Tree, inner: set[int]) -> Tree:
    """The tree with only the nodes of ``inner`` split, renumbered from the root."""
    out, todo = Tree(), [(0, 0)]
    while todo:
        old, new = todo.pop()
        out.value[new], out.cover[new] = t.value[old], t.cover[old]
        if old in inner:
            out.feature[new], out.bin[new], out.gain[new] = t.feature[old], t.bin[old], t.gain[old]
            out.left[new] = out.child(new)
            out.right[new] = out.child(new)
            todo += [(t.left[old], out.left[new]), (t.right[old], out.right[new])]
    return out


# ---------------------------------------------------------------- Spark ML estimator and model
class _Names(HasFeaturesCol, HasLabelCol, HasWeightCol):
    pass


def training_rows(est, df: DataFrame, n_classes: int | None = None) -> DataFrame:
    """x array<double>, y double, w double of the rows to train on, written once, over as many files as there are tasks for them."""
    weight = F.col(est.getWeightCol()).cast("double") if est.isDefined("weightCol") and est.getWeightCol() else F.lit(1.0)
    x = F.col(est.getFeaturesCol())
    x = x.cast("array<double>") if isinstance(df.schema[est.getFeaturesCol()].dataType, ArrayType) else vector_to_array(x)
    rows = df.select(x.alias("x"), F.col(est.getLabelCol()).cast("double").alias("y"), weight.alias("w")).filter("y is not null and not isnan(y) and w > 0")
    if n_classes is not None:
        rows = rows.filter(F.col("y").between(0, n_classes - 1))
    rows = materialize(rows, "boost-rows")
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // BLOCK_ROWS) or 1)
    if rows.rdd.getNumPartitions() < tasks:      # few files that hold many rows
        rows = materialize(rows.repartition(tasks), "boost-rows")
    return rows


class HistogramBoosting(Estimator, _Names, HasMaxIter, HasStepSize, HasSeed):
    """``loss`` softmax, logistic or squared; ``growth`` level or leaf.  ``fit(df)`` -> BoostedTreesModel.

    Parameters share their names with Spark's trees where these have them, so grids fit both."""

    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree (0 or less: any)", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows drawn for a round", TypeConverters.toFloat)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "share of features drawn for a round", TypeConverters.toString)
    maxLeaves = Param(Params._dummy(), "maxLeaves", "leaves of a tree (leaf growth)", TypeConverters.toInt)
    regLambda = Param(Params._dummy(), "regLambda", "L2 penalty of leaf values", TypeConverters.toFloat)
    minHessian = Param(Params._dummy(), "minHessian", "least sum of second derivatives in a child", TypeConverters.toFloat)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows in a child", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    topShare = Param(Params._dummy(), "topShare", "share of rows kept for their gradients (0: no such sampling)", TypeConverters.toFloat)
    otherShare = Param(Params._dummy(), "otherShare", "share of rows drawn from the others", TypeConverters.toFloat)

    def __init__(self, loss: str = "softmax", nClasses: int = 2, growth: str = "level", bundle: bool = True, **params):
        super().__init__()
        self.loss, self.n_classes, self.growth, self.bundle = loss, nClasses, growth, bundle
        self._setDefault(maxIter=100, stepSize=0.1, maxDepth=6, subsamplingRate=1.0, featureSubsetStrategy="all", maxLeaves=31, regLambda=1.0,
                         minHessian=1e-3, minInstancesPerNode=1, maxBins=255, topShare=0.0, otherShare=0.1, seed=42)
        self._set(**params)

    def _settings(self) -> Settings:
        p = {k.name: v for k, v in self.extractParamMap().items()}
        share = str(p["featureSubsetStrategy"])
        return Settings(self.loss, self.n_classes if self.loss == "softmax" else 1, p["maxIter"], p["stepSize"], self.growth, p["maxDepth"] if p["maxDepth"] > 0 else 1 << 20,
                        p["maxLeaves"], p["regLambda"], p["minHessian"], p["minInstancesPerNode"], p["maxBins"], p["subsamplingRate"],
                        1.0 if share in ("all", "auto") else float(share), p["topShare"], p["otherShare"], self.bundle, p["seed"])

    def _fit(self, df: DataFrame) -> BoostedTreesModel:
        s = self._settings()
        rows = training_rows(self, df, None if s.loss == "squared" else self.n_classes)
        start = self._start(rows, s)
        fitting = Fitting(rows, s, start)
        trees = fitting.run()
        edges = fitting.bins.edges
        flat = [(i, k, n, t.feature[n], float(edges[t.feature[n]][t.bin[n]]) if t.feature[n] >= 0 else 0.0, t.left[n], t.right[n],
                 t.value[n], t.gain[n], t.cover[n]) for i, group in enumerate(trees) for k, t in enumerate(group) for n in range(len(t.feature))]
        model = BoostedTreesModel(pd.DataFrame(flat, columns=[c.split()[0] for c in NODES.split(", ")]), s.loss, self.n_classes, start.tolist(), fitting.d)
        return self._copyValues(model)

    def _start(self, rows: DataFrame, s: Settings) -> np.ndarray:
        """Margins before the first tree: the mean, the log-odds or the log-shares of the classes."""
        if s.loss == "squared":
            mean = rows.agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m")).first()["m"]
            return np.array([mean or 0.0])
        got = {int(r["y"]): r["w"] for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect()}    # one row per class
        share = np.array([got.get(k, 0.0) for k in range(self.n_classes)]) + 1e-12
        share = np.log(share / share.sum())
        return share if s.loss == "softmax" else np.array([share[1] - share[0]])


NODES = "round long, tree long, node long, feature long, threshold double, left long, right long, value double, gain double, cover double"


def thresholds(trees: list[tuple[int, dict]]) -> dict[int, np.ndarray]:
    """The thresholds of each feature that a split uses."""
    inner = [t["kids"][::2] != np.arange(len(t["column"])) for _, t in trees]
    column = np.concatenate([t["column"][i] for i, (_, t) in zip(inner, trees)] or [np.zeros(0, np.int64)])
    cut = np.concatenate([t["threshold"][i] for i, (_, t) in zip(inner, trees)] or [np.zeros(0)])
    return {int(f): np.unique(cut[column == f]) for f in np.unique(column)}


def _code_of(part: np.ndarray, cuts: dict[int, np.ndarray]) -> np.ndarray:
    """Which thresholds each row of ``part`` (features x rows) lies between, as one number."""
    code = np.zeros(part.shape[1], np.int64)
    for f, c in cuts.items():
        code = code * (len(c) + 1) + np.where(np.isnan(part[f]), 0, np.searchsorted(c, part[f], side="left"))
    return code


def _alike(part: np.ndarray, cuts: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows of ``part`` (features x rows) between the same thresholds take the same way through all trees: one of each
    kind, and the kind of each row; None if the thresholds have too many combinations to tell apart or most rows differ."""
    if float(np.prod([len(c) + 1.0 for c in cuts.values()])) > CELL_CODES:
        return None
    _, first, kind = np.unique(_code_of(part, cuts), return_index=True, return_inverse=True)
    return (first, kind) if 2 * len(first) <= len(kind) else None


def known_margins(trees: list[tuple[int, dict]], start: list[float], cuts: dict[int, np.ndarray]):
    """A function like ``margins`` of ``x`` only.  Where the thresholds have few combinations, it keeps the scores of those met
    before, so that a task with many rows scores each combination once."""
    kinds = float(np.prod([len(c) + 1.0 for c in cuts.values()]))
    if kinds * len(start) > KNOWN:
        return lambda x: margins(x, trees, start, cuts)
    met, score = np.zeros(int(kinds), bool), np.zeros((int(kinds), len(start)))

    def run(x: np.ndarray) -> np.ndarray:
        code = _code_of(x.T, cuts)
        new = np.flatnonzero(~met[code])
        if len(new):
            kind, first = np.unique(code[new], return_index=True)
            score[kind] = margins(x[new[first]], trees, start, cuts)
            met[kind] = True
        return score[code]
    return run


def margins(x: np.ndarray, trees: list[tuple[int, dict]], start: list[float], cuts: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Scores (rows x outputs) of "trees" (output, tree from ``stepped``) for the rows of ``x``; ``cuts``: their ``thresholds``."""
    out = np.empty((len(start), len(x)))
    cuts = thresholds(trees) if cuts is None else cuts
    for i in range(0, len(x), SCORED):
        part = np.ascontiguousarray(x[i:i + SCORED].T)
        if alike := _alike(part, cuts):
            part = np.ascontiguousarray(part[:, alike[0]])
        some = np.repeat(np.array(start, np.float64)[:, None], part.shape[1], 1)
        for k, t in trees:
            some[k] += t["value"].take(route_values(part, t))
        out[:, i:i + SCORED] = some[:, alike[1]] if alike else some
    return out.T


class BoostedTreesModel(Model, _Names):
    """Flattened trees; ``transform`` adds prediction (and probability, rawPrediction for classes)."""

    def __init__(self, nodes: pd.DataFrame | None = None, loss: str = "softmax", n_classes: int = 2, start: list[float] = (0.0,), n_features: int = 0):
        super().__init__()
        self.nodes, self.loss, self.numClasses, self.start, self.numFeatures = nodes, loss, n_classes, list(start), n_features

    def trees(self) -> list[tuple[int, dict[str, np.ndarray]]]:
        """(output, tree) in the order of the rounds."""
        out = []
        for (_, k), g in self.nodes.groupby(["round", "tree"], sort=True):
            g = g.sort_values("node")
            out.append((int(k), {c: g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value", "cover")}))
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, start, name = [(k, stepped(t)) for k, t in self.trees()], self.start, self.getFeaturesCol()
        cuts = thresholds(trees)

        @F.pandas_udf(ArrayType(DoubleType()))
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            scored = known_margins(trees, start, cuts)
            for col in parts:
                yield pd.Series(list(scored(np.vstack(col.to_numpy())) if len(col) else []))

        x = F.col(name) if isinstance(df.schema[name].dataType, ArrayType) else vector_to_array(name)
        out = df.withColumn("_margin", score(x))
        if self.loss == "squared":
            return out.withColumn("prediction", F.col("_margin")[0]).drop("_margin")
        if self.loss == "logistic":
            p = 1 / (1 + F.exp(-F.col("_margin")[0]))
            raw, share = F.array(-F.col("_margin")[0], F.col("_margin")[0]), F.array(1 - p, p)
        else:
            top = F.array_max("_margin")
            e = F.transform("_margin", lambda m: F.exp(m - top))
            total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
            raw, share = F.col("_margin"), F.transform(e, lambda v: v / total)
        best = F.array_position(raw, F.array_max(raw)) - 1
        return (out.withColumns({"rawPrediction": array_to_vector(raw), "probability": array_to_vector(share), "prediction": best.cast("double")})
                .drop("_margin"))

    @property
    def featureImportances(self):  # noqa: N802 - the name of Spark's tree models
        """Shares of the splits' gains by feature."""
        inner = self.nodes[self.nodes["feature"] >= 0]
        total = np.bincount(inner["feature"].to_numpy(np.int64), inner["gain"].to_numpy(), max(self.numFeatures, 1))
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def save(self, path: str, spark) -> None:
        spark.createDataFrame(self.nodes, NODES).write.mode("overwrite").parquet(f"{path}/trees")
        meta = {"loss": self.loss, "n_classes": self.numClasses, "start": self.start, "n_features": self.numFeatures, "features": self.getFeaturesCol()}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(path: str, spark) -> BoostedTreesModel:
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        nodes = spark.read.parquet(f"{path}/trees").toPandas()
        model = BoostedTreesModel(nodes, meta["loss"], meta["n_classes"], meta["start"], meta["n_features"])
        return model._set(featuresCol=meta["features"])
