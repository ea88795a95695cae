"""Heavy-light Jaccard join against all pairs."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from tabsmith.llm import op02_jaccard_join as op  # noqa: E402
from tabsmith.llm.graph import components  # noqa: E402


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    rows, i = [], 0
    for size in [1, 2, 3, 4, 5, 8, 9, 10, 12, 15, 18, 22, 26, 30, 45, 60, 90]:
        for _ in range(3):
            base = [rnd.choice(vocab) for _ in range(size)]
            for _ in range(rnd.randint(1, 6)):
                w = list(base)
                for _ in range(rnd.randint(0, 2)):
                    k = rnd.random()
                    at = rnd.randrange(len(w))
                    if k < 0.3:
                        w[at] = rnd.choice(vocab)
                    elif k < 0.6:
                        w.append(rnd.choice(vocab))
                    elif len(w) > 1:
                        w.pop(0)
                t = " ".join(w)
                rows.append((i, t.upper() if rnd.random() < 0.2 else t))
                i += 1
    rnd.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    return rows + [(None, rows[0][1]), (None, None), (900, None), (901, ""), (902, " \n"), (3, rows[3][1]), (903, "A b"), (904, "a B")]


def result(spark, rows, **more):
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n int").repartition(4)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in op.jaccard_join(docs, **more).collect())


@pytest.mark.parametrize("seed,boundary", [(1, None), (2, 0), (3, 20), (4, 13)])
def test_brute_force(spark, seed, boundary):
    rows = corpus(seed)
    assert result(spark, rows, boundary=boundary, shard_bytes=3000) == brute.jaccard_components(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.jaccard_join(docs).count() == 0


def test_need_is_the_stated_threshold():
    for s in range(1, 80):
        for t in range(s, 80):
            assert op.need(s, t) == next(i for i in range(s + t) if 100 * i >= 85 * (s + t - i))
            if op.need(s, t) <= s:
                assert t in op.partners(s) and s in op.partners(t)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (200, 200)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}
