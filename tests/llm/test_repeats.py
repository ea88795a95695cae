"""Byte and word substring dedup against brute force."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from tabsmith.llm import op03_phrases, op07_suffix_trees  # noqa: E402


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocab = ["the", "of", "and", "zu", "ñandú", "x", "12", "a.", " b"]
    line = lambda k: rnd.choice([" ", "  ", "\n", "\t"]).join(rnd.choice(vocab) for _ in range(k))
    shared = [line(rnd.randint(10, 40)) for _ in range(6)]
    base = [line(rnd.randint(30, 90)) for _ in range(5)]
    rows = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.3:
            t = line(rnd.randint(0, 60))
        elif kind < 0.6:
            t = line(rnd.randint(0, 20)) + " " + rnd.choice(shared) + " " + line(rnd.randint(0, 20)) + rnd.choice(shared)
        elif kind < 0.8:
            w = rnd.choice(base).split(" ")
            w[rnd.randrange(len(w))] = "edit"
            t = " ".join(w)
        else:
            t = rnd.choice(base)
        rows.append((rnd.randint(0, n), t))  # ids repeat
    return rows + [(None, base[0]), (None, base[0]), (3, None), (4, ""), (90, "ab" * 300), (91, "ba" * 300), (92, "a" * 200),
                   (93, " ".join(["the"] * 100)), (94, " ".join(["the"] * 50)), (95, "x" * 49), (96, "x" * 49), (97, "x" * 50), (98, "x" * 50)]


def check(spark, rows, parts, hot=2048, shard_bytes=4 << 20):
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n_removed int").repartition(parts)
    got = op03_phrases.dedup_bytes(docs, hot=hot, shard_bytes=shard_bytes).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in got) == brute.bytes_dedup(rows)
    got = op07_suffix_trees.dedup_substrings(docs, group_suffixes=200, shard_bytes=shard_bytes).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, brute.sha(bytes(r.kept))) for r in got) == brute.words_dedup(rows)
    assert all(sum(x["last"] - x["first"] + 1 for x in r.repeats) == r.n_removed for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    check(spark, corpus(seed), 5)


def test_small_shards_and_hot_triggers(spark):
    check(spark, corpus(7), 3, hot=3, shard_bytes=900)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op03_phrases.dedup_bytes(docs).count() == 0
    assert op07_suffix_trees.dedup_substrings(docs).count() == 0
