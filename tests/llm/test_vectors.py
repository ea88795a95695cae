"""Epsilon grid join against all pairs."""

import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))

from tabsmith.llm import op04_grid_join as op  # noqa: E402


def brute(rows, cosine=0.93):
    ok = []
    for k, (i, v, l) in enumerate(rows):
        good = i is not None and l is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
        if good and np.dot(v, v) > 0:
            ok.append((k, i, np.array(v, float) / np.sqrt(np.dot(v, v)), l))
    n = [0] * len(rows)
    root = {i: i for _, i, _, _ in ok}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (k, i, u, l) in enumerate(ok):
        for m, j, w, t in ok[:a]:
            if l == t and len(u) == len(w) and u @ w >= cosine:
                n[k] += 1
                n[m] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((str(i), n[k], str(find(i) if i in root else i), i is not None and (find(i) if i in root else i) == i)
                  for k, (i, _, _) in enumerate(rows))


def data(seed):
    rnd = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, 2):
        centres = rnd.normal(size=(12, 6))
        for _ in range(90):
            c = centres[rnd.integers(12)] + rnd.normal(size=6) * rnd.choice([0, 0.1, 0.3])
            rows.append((i, [float(x) for x in c], label))
            i += 1
    rows += [(i + k, rows[0][1], 0) for k in range(30)]
    rows += [(900, None, 1), (901, [0.0] * 6, 1), (902, [float("nan")] + [1.0] * 5, 1), (903, [None] + [1.0] * 5, 1), (904, rows[5][1], None),
             (905, rows[5][1][:5], 0), (906, [], 0), (None, rows[0][1], 0), (3, rows[200][1], 2), (907, [float("inf")] + [0.0] * 5, 1)]
    random.Random(seed).shuffle(rows)
    return rows


def test_brute_force(spark):
    for seed, block in ((1, 1024), (2, 16)):
        rows = data(seed)
        df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, kept int").repartition(3)
        got = op.near_duplicates(df, block=block, grid_dims=3).collect()
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert op.near_duplicates(df).count() == 0
