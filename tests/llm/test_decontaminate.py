"""Suffix-array matches against brute force, with odd inputs."""

import random
import re

from pyspark.sql import functions as F

from tabsmith.llm import op10_decontaminate as op

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))


def brute(docs, items, window=13):
    out = []
    for d, t in docs:
        w = split(t)
        hit, names = set(), set()
        for item, text in items:
            v = split(text)
            n = min(len(v), window)
            for i in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[i:i + n]:
                        hit.update(range(p, p + n))
                        names.add(str(item))
        out.append((str(d), len(w), len(hit), ",".join(sorted(names))))
    return sorted(out)


def data(seed):
    rnd = random.Random(seed)
    vocab = ["the", "a", "of", "Ünd", "x1", "go"]
    line = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, line(n)) for i, n in enumerate([1, 2, 3, 12, 13, 14, 20, 30])] + [(50, None), (51, "!!"), (1, line(15))]
    docs = [(i, line(rnd.randint(0, 40))) for i in range(40)]
    docs += [(100, line(5) + " " + items[6][1].upper() + ", " + line(5)), (101, items[7][1] * 3), (102, None), (102, ""),
             (None, items[5][1]), (103, " ".join(["a"] * 60)), (103, " ".join(["a"] * 60))]
    return docs, items


def result(found):
    return sorted((str(r.doc_id), r.n_words, r.n, ",".join(r["items"])) for r in
                  found.withColumn("n", op.hit_words()).collect())


def test_brute_force(spark):
    for seed in range(3):
        docs, items = data(seed)
        d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, spans string").repartition(4)
        b = spark.createDataFrame(items, "item_id long, text string")
        assert result(op.find_matches(d, b)) == brute(docs, items)


def test_blocks_of_the_benchmark_give_the_same(spark):
    docs, items = data(9)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert result(op.find_matches(d, b, block_bytes=60, slice_bytes=100)) == brute(docs, items)


def test_empty_tables_and_removal(spark):
    docs, items = data(2)
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert op.find_matches(d.limit(0), b).count() == 0
    assert result(op.find_matches(d, b.limit(0))) == brute(docs, [])
    kept = op.decontaminate(d, b)
    assert kept.columns == d.columns
    want = [x for x in brute(docs, items) if not (x[2] > 0 and 20 * x[2] >= x[1])]
    assert kept.agg(F.count("*")).first()[0] == len(want)


def test_search_gives_the_longest_match():
    import numpy as np
    block = op.test_block([(1, "a b c d"), (2, "q r")], 4)
    words, _ = op._word_hashes(np.frombuffer(b"z a b c x q", np.uint8), np.array([0, 11]))
    padded = np.concatenate([words, np.zeros(5, np.uint64)])
    sa = op.suffix_array(padded, np.arange(len(words)), 4)
    first, last, longest = op.search(padded, sa, block)
    assert (first == last).all()
    assert longest.tolist() == [3, 1]
