"""Random forest regressor (M4) on binned blocks: all trees grow by a level in one pass.

Rows become blocks of binned columns once, as in ``boosting``.  A pass draws the bootstrap counts of each
tree (Poisson 1, from the seed, the block and the tree, so every pass draws the same), routes the drawn rows to
the tree's open nodes, and sums weights and labels by (tree, node, feature, bin).  The sums of one tree
meet in one group, which returns the best split of each node; only these reach the driver.  The number of
tasks is that of the cores, so what is shuffled grows with the trees and their nodes, never with the rows; trees
whose sums don't fit a task's share (``SUMS``) take further passes.

Where the bins have few combinations (``MOST_CELLS``, and clearly fewer than there are rows), one pass is enough: a tree's drawn rows are added
up by combination, and as rows of the same bins take the same way through a tree, all its levels follow from these sums.
One task grows a tree; the draws and the trees are those of the passes.

Defined results: splits lower the squared error most (equal ones: the smaller feature, then the smaller bin); a leaf
predicts the mean of its drawn rows; rows without a label or of weight 0 or less aren't trained on; NaN counts as
smaller than every number; no rows give a model that predicts 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasSeed
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import materialize
from .boosting import (_Names, NODES, Bins, BoostedTreesModel, Round, Tree, _blocks, _codes, _radix, _row_blocks, apart, best_splits, column_summaries,
                       cut_points, joint_cells, joint_codes, joint_columns, route, route_codes, training_rows)

SUMS = 8 << 20          # sums (24 bytes) that a task holds
HELD = 1 << 18          # rows that a task works on at a time
MOST_CELLS = 1 << 17    # combinations of bins by which drawn rows are added up,
CELL_ROWS = 2           # if each task has so many rows for one at least
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 12.0)])))
DRAWN = np.searchsorted(_POISSON, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)   # 16 random bits -> Poisson(1)
BEST = "tree long, node long, feature long, bin long, gain double, gl double, hl double, cl double, g double, h double, c double"
GROWN = "tree long, node long, feature long, bin long, left long, right long, value double, gain double, cover double, depth long"


def drawn(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often each row of a block is in the bootstrap sample of a tree."""
    rng = np.random.Generator(np.random.SFC64([seed, tree, block]))
    return DRAWN[np.frombuffer(rng.bytes(2 * n), np.uint16)]


def _sums(width: np.ndarray, trees: dict[int, dict], wanted: dict[int, np.ndarray], seed: int):
    """Task body: per tree the sums (weighted labels, weights, rows) of its wanted nodes."""
    def run(batches):
        groups = joint_columns(width, max(int(p.max()) + 1 for p in wanted.values()))
        cells = joint_cells(width, groups)
        total = {k: [np.zeros((3, (int(p.max()) + 1) * n)) for n in cells] for k, p in wanted.items()}

        def add(blocks, columns, y, w):
            codes, ways = joint_codes(columns, width, groups), route_codes(columns, width)
            finite = bool(np.isfinite(y).all() and np.isfinite(w).all())
            even = bool((w == 1).all())               # then the sums of weights are those of drawn rows
            for k, tree in trees.items():
                bag = np.concatenate([drawn(seed, k, b.id, len(b.y)) for b in blocks])
                if finite:             # rows that weren't drawn cost less than to leave them out
                    in_bag, place = None, wanted[k].take(route(columns, tree, ways))
                else:
                    in_bag = np.flatnonzero(bag)
                    place = wanted[k].take(route(columns[:, in_bag], tree))
                if (place < 0).any():
                    open_ = np.flatnonzero(place >= 0)
                    in_bag, place = open_ if in_bag is None else in_bag[open_], place[open_]
                if in_bag is None:
                    count, wk, yk, mine = bag.astype(np.float64), w, y, codes
                else:
                    count, wk, yk, mine = bag[in_bag].astype(np.float64), w[in_bag], y[in_bag], [c[in_bag] for c in codes]
                h = count if even else count * wk
                g = h * yk
                for code, n, part in zip(mine, cells, total[k], strict=True):
                    cell = place * n
                    cell += code
                    part[0] += np.bincount(cell, g, part.shape[1])
                    drawn_rows = np.bincount(cell, count, part.shape[1])
                    part[1] += drawn_rows if even else np.bincount(cell, h, part.shape[1])
                    part[2] += drawn_rows

        for held in _held(batches, len(width)):
            add(*held)
        for k, parts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([apart(parts, width, groups).tobytes()], pa.binary())], names=["tree", "sums"])
    return run


def _held(batches, n_columns: int):
    """Blocks together, ``HELD`` rows at a time: (blocks, columns, y, w)."""
    held, size = [], 0

    def together():
        return held, np.concatenate([b.columns for b in held], 1), np.concatenate([b.y for b in held]), np.concatenate([b.w for b in held])

    for block in _blocks(batches, Round("squared", []), n_columns):
        held.append(block)
        size += len(block.y)
        if size >= HELD:
            yield together()
            held, size = [], 0
    if held:
        yield together()


def _cell_sums(bins: Bins, radix: np.ndarray, trees: list[int], cells: int, seed: int):
    """Task body: per tree the sums (weighted labels, weights, rows) of its drawn rows by combination of bins."""
    def run(batches):
        total = {k: np.zeros((3, cells)) for k in trees}
        for blocks, columns, y, w in _held(batches, len(bins.width)):
            code, even = _codes(columns, radix), bool((w == 1).all())
            wy = y if even else w * y
            finite = bool(np.isfinite(wy).all())
            for k, sums in total.items():
                count = np.concatenate([drawn(seed, k, b.id, len(b.y)) for b in blocks]).astype(np.float64)
                rows = np.bincount(code, count, cells)
                sums[2] += rows
                sums[1] += rows if even else np.bincount(code, count * w, cells)
                if finite:
                    sums[0] += np.bincount(code, count * wy, cells)
                else:                 # 0 times infinite isn't a number
                    at = count > 0
                    sums[0] += np.bincount(code[at], (count * wy)[at], cells)
        for k, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([sums.tobytes()], pa.binary())], names=["tree", "sums"])
    return run


def _summed(table: pa.Table) -> np.ndarray:
    total = 0.0
    for part in table["sums"]:
        total = total + np.frombuffer(part.as_buffer())
    return total


def _grown(bins: Bins, radix: np.ndarray, p: dict):
    """The tree of the sums by combination of bins, one row per node."""
    names = [c.split() for c in GROWN.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        k, total = table["tree"][0].as_py(), _summed(table).reshape(3, -1)
        cell = np.flatnonzero(total[2])
        sums = total[:, cell]
        columns = ((cell // radix[:, None]) % bins.width[:, None]).astype(np.uint8)
        t, wanted, depth = Tree(), [0], 0
        while wanted:
            place = np.full(len(t.feature), -1, np.int64)
            place[wanted] = np.arange(len(wanted))
            at = place.take(route(columns, t.arrays(bins)))
            use = at >= 0
            part = []
            for c, w in enumerate(bins.width.tolist()):
                code = at[use] * w + columns[c, use]
                part.append(np.stack([np.bincount(code, v[use], len(wanted) * w) for v in sums]).reshape(3, -1, w))
            found = best_splits(np.concatenate(part, 2), bins, np.ones(len(bins.count), bool), 0.0, 0.0, p["minInstancesPerNode"])
            wanted = sorted(child for node, f in zip(wanted, found, strict=True) for child in _split(t, node, f, depth, p))
            depth += 1
        rows = [(k, n, *(getattr(t, c)[n] for c, _ in names[2:])) for n in range(len(t.feature))]
        return pa.table({name: pa.array([r[i] for r in rows], pa.int64() if kind == "long" else pa.float64()) for i, (name, kind) in enumerate(names)})
    return run


def _split(t: Tree, node: int, found: tuple, depth: int, p: dict) -> list[int]:
    """Make ``node`` an inner one if a split was found; its children that may be split further."""
    feature, b, gain, gl, hl, cl, g, h, c = found
    if depth == 0:
        t.value[0], t.cover[0] = g / h if h > 0 else 0.0, c
    if feature < 0 or depth >= p["maxDepth"]:
        return []
    t.feature[node], t.bin[node], t.gain[node] = feature, b, gain
    t.left[node], t.right[node] = t.child(node), t.child(node)
    later = []
    for child, gg, hh, cc in ((t.left[node], gl, hl, cl), (t.right[node], g - gl, h - hl, c - cl)):
        t.value[child], t.cover[child] = gg / hh if hh > 0 else t.value[node], cc
        if cc >= 2 * p["minInstancesPerNode"] and depth + 1 < p["maxDepth"]:
            later.append(child)
    return later


def _split_rows(bins: Bins, wanted: dict[int, np.ndarray], least_rows: float):
    names = [f.split() for f in BEST.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        k, total = table["tree"][0].as_py(), _summed(table).reshape(3, -1, int(bins.width.sum()))
        nodes = np.flatnonzero(wanted[k] >= 0)
        found = best_splits(total, bins, np.ones(len(bins.count), bool), 0.0, 0.0, least_rows)
        rows = [(k, int(node), *f) for node, f in zip(nodes, found, strict=True)]
        return pa.table({name: pa.array([r[i] for r in rows], pa.int64() if kind == "long" else pa.float64()) for i, (name, kind) in enumerate(names)})
    return run


class HistogramForestRegressor(Estimator, _Names, HasSeed):
    """``fit(df)`` -> BoostedTreesModel whose trees hold their share of the mean.  Parameters share their names with Spark's forest."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least drawn rows in a child", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(numTrees=100, maxDepth=10, minInstancesPerNode=1, maxBins=32, seed=42)
        self._set(**params)

    def _fit(self, df: DataFrame) -> BoostedTreesModel:
        p = {k.name: v for k, v in self.extractParamMap().items()}
        rows = training_rows(self, df)
        summary = column_summaries(rows.select("x"))
        d = 1 + max(summary, default=-1)
        edges = [cut_points(*summary[f], min(p["maxBins"], 255)) for f in range(d)]
        bins = Bins.build(edges, [[f] for f in range(d)])
        trees = [Tree() for _ in range(p["numTrees"])]
        if d:
            blocks = materialize(_row_blocks(rows, bins, np.zeros(1)), "forest-blocks")
            cores = df.sparkSession.sparkContext.defaultParallelism
            n, size = blocks.agg(F.count(F.lit(1)), F.sum(F.octet_length("y"))).first()
            files = blocks.rdd.getNumPartitions()
            # read in fewer parts than there are cores: blocks are dealt anew, which moves a few bytes per row once
            tasks = max(1, min(max(files, n // 2), cores))
            blocks = (blocks.repartition(tasks) if files < tasks else blocks.coalesce(tasks)).persist(StorageLevel.MEMORY_AND_DISK)
            radix = _radix(bins)
            cells = int(np.prod(bins.width)) if radix is not None else MOST_CELLS + 1
            try:
                if cells <= MOST_CELLS and CELL_ROWS * cells * tasks <= (size or 0) // 8:
                    self._grow_cells(blocks, bins, radix, cells, trees, p)
                else:
                    self._grow(blocks, bins, trees, p)
            finally:
                blocks.unpersist()
        for t in trees:
            t.value = [v / len(trees) for v in t.value]
        flat = [(0, k, n, t.feature[n], float(edges[t.feature[n]][t.bin[n]]) if t.feature[n] >= 0 else 0.0, t.left[n], t.right[n],
                 t.value[n], t.gain[n], t.cover[n]) for k, t in enumerate(trees) for n in range(len(t.feature))]
        # every tree is a round of its own: one output, their sum
        nodes = pd.DataFrame(flat, columns=[c.split()[0] for c in NODES.split(", ")])
        nodes["round"], nodes["tree"] = nodes["tree"], 0
        return self._copyValues(BoostedTreesModel(nodes, "squared", 2, [0.0], d))

    @staticmethod
    def _grow_cells(blocks: DataFrame, bins: Bins, radix: np.ndarray, cells: int, trees: list[Tree], p: dict) -> None:
        most = max(1, SUMS // cells)
        for i in range(0, len(trees), most):      # as many trees as fit, in one pass
            part = list(range(i, min(i + most, len(trees))))
            sums = blocks.mapInArrow(_cell_sums(bins, radix, part, cells, p["seed"] & 0xFFFFFFFF), "tree long, sums binary")
            for x in sorted(sums.groupBy("tree").applyInArrow(_grown(bins, radix, p), GROWN).collect(), key=lambda x: (x["tree"], x["node"])):
                t = trees[x["tree"]]
                if x["node"]:
                    t.child(0)
                for name in ("feature", "bin", "left", "right", "value", "gain", "cover", "depth"):
                    getattr(t, name)[x["node"]] = x[name]

    @staticmethod
    def _grow(blocks: DataFrame, bins: Bins, trees: list[Tree], p: dict) -> None:
        wanted, width, seed = {k: [0] for k in range(len(trees))}, int(bins.width.sum()), p["seed"] & 0xFFFFFFFF
        depth = 0
        while wanted:
            later: dict[int, list[int]] = {}
            todo = sorted(wanted)
            while todo:                       # as many trees as fit, in one pass
                part, size = {}, 0
                while todo and (not part or size + len(wanted[todo[0]]) * width <= SUMS):
                    k = todo.pop(0)
                    place = np.full(len(trees[k].feature), -1, np.int64)
                    place[wanted[k]] = np.arange(len(wanted[k]))
                    part[k], size = place, size + len(wanted[k]) * width
                arrays = {k: trees[k].arrays(bins) for k in part}
                sums = blocks.mapInArrow(_sums(bins.width, arrays, part, seed), "tree long, sums binary")
                found = sums.groupBy("tree").applyInArrow(_split_rows(bins, part, p["minInstancesPerNode"]), BEST)
                for x in sorted(found.collect(), key=lambda x: (x["tree"], x["node"])):
                    k, node, *split = x
                    if more := _split(trees[k], node, tuple(split), depth, p):
                        later.setdefault(k, []).extend(more)
            wanted, depth = {k: sorted(v) for k, v in later.items()}, depth + 1
