"""Exact deduplication against grouping by text in Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from tabsmith.llm import op11_exact_dedup as op

SCHEMA = "doc_id long, text string, digest string, n int, keep_id string"


def norm(t):
    return re.sub(r"[\x20\x09-\x0d]+", " ", t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((k for k in ids if k is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, "clash") for i, t in rows], SCHEMA)


def found(spark, rows, **kw):
    out = op.find_repeats(frame(spark, rows), **kw)
    size = kw.get("digest_bytes", 32)
    want = {(i, k, n, s, h[:2 * size]) for i, k, n, s, h in brute(rows)}
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in out.collect()]
    assert len(got) == len(rows) and set(got) == want
    return sorted(got, key=repr)


ROWS = [(5, "a b"), (3, "a  b"), (9, "a\tb"), (4, " a b"), (1, None), (2, ""), (7, "\n \n"), (8, " "), (None, "a b"), (None, "only null"),
        (None, "only null"), (6, "é x"), (10, "é x"), (6, "é x"), (11, "x" * 300_000), (12, "x" * 300_000), (13, "X" * 300_000)]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_nulls_ties_long_texts(spark, batches):
    assert found(spark, ROWS, batches=batches) == brute(ROWS)


def test_hot_group_and_random_texts(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot text", "hot  text"]) if i % 3 == 0 else f"text {rng.randrange(900)}") for i in range(3000)]
    rng.shuffle(rows)
    assert found(spark, rows, batches=3) == brute(rows)


def test_colliding_digests_are_told_apart_by_their_texts(spark):
    rng = random.Random(6)
    rows = [(i, f"t {rng.randrange(700)}") for i in range(1500)]
    found(spark, rows, digest_bytes=1)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_drop_repeats_keeps_columns(spark):
    docs = frame(spark, ROWS)
    out = op.drop_repeats(docs)
    assert out.columns == docs.columns
    want = sorted(((i, t) for i, t in ROWS if (i, t) not in [(5, "a b"), (9, "a\tb"), (2, ""), (8, " "), (12, "x" * 300_000), (None, "a b")]), key=repr)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == want


def test_perfect_hash_is_minimal_and_full_digests_reject_others():
    rng = np.random.default_rng(1)
    for n in (1, 2, 700, 20_000):
        d = np.unique(rng.integers(0, 256, (n, 32), dtype=np.uint8), axis=0)
        mph = op.PerfectHash.build(d)
        assert sorted(mph.slots(d).tolist()) == list(range(len(d)))
        other = rng.integers(0, 256, (500, 32), dtype=np.uint8)
        slot = mph.slots(other)
        assert slot.max() < len(d) and not (d[np.argsort(mph.slots(d))][slot] == other).all(1).any()


def test_perfect_hash_with_equal_words():
    d = np.zeros((40, 32), np.uint8)
    d[:, 31] = np.arange(40)          # the words in use are all equal
    assert sorted(op.PerfectHash.build(d).slots(d).tolist()) == list(range(40))


def test_lookup_of_a_later_batch(spark):
    """Members point to the winner of an earlier batch, nonmembers make the next generation."""
    first = spark.createDataFrame([("a", 4), ("b", 2)], "text string, doc_id long").select(op.digest(op.F.col("text")).alias("digest"), "doc_id")
    later = spark.createDataFrame([("a", 9), ("c", 8), ("c", 7)], "text string, doc_id long").select(op.digest(op.F.col("text")).alias("digest"), "doc_id")
    history = op.History(spark, 3)
    history.add(op.grouped(first))
    got = history.lookup(op.grouped(later))
    assert sorted((r.doc_id, r.n, r.member, r.winner) for r in got.collect()) == [(7, 2, False, None), (9, 1, True, 4)]
    history.add(got.filter("not member").select("digest", "doc_id", "n"))
    assert all(r.member for r in history.lookup(op.grouped(later.union(first))).collect())
