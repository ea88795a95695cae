"""Merge replay against the tiktoken library, and exact round trips."""

import random

import pytest

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from pyspark.sql import functions as F  # noqa: E402

from tabsmith.llm import op01_bpe  # noqa: E402


@pytest.fixture(scope="module")
def vocabulary():
    return op01_bpe.Vocabulary(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def texts():
    rnd = random.Random(5)
    odd = [32, 10, 9, 0x1C, 0x85, 97, 98, 99, 233, 0x4E00, 0x1F600, 0x661, 0x200B, 0x3000, 39]
    return (["", " ", "a", "it's we'll I'D", "a" * 5000, "<|endoftext|>", "x" * 70_000]
            + ["".join(chr(rnd.choice(odd)) for _ in range(rnd.randint(1, 400))) for _ in range(150)]
            + ["".join(rnd.choice("ab") for _ in range(900)) for _ in range(5)])


def test_matches_library_and_round_trip(spark, vocabulary, library):
    given = texts()
    rows = [(i, t, 1) for i, t in enumerate(given)] + [(None, "null id", 2), (7, None, 3), (0, given[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    got = op01_bpe.encode_decode(docs, vocabulary).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), ",".join(map(str, library.encode_ordinary(t or ""))), (t or "").encode()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens == (len(r.ids.split(",")) if r.ids else 0) for r in got)
    enc = op01_bpe.encode(docs, vocabulary)
    dec = op01_bpe.decode(enc, vocabulary)
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in dec.collect()) == sorted((a, c) for a, _, c in want)


def test_bounded_memory_gives_the_same(vocabulary, library, monkeypatch):
    monkeypatch.setattr(op01_bpe, "REMEMBERED", 10)
    bpe = op01_bpe.MergeReplay(vocabulary.ranks, vocabulary.pattern)
    for t in texts():
        assert bpe.encode([t, t + " z"])[0] == ",".join(map(str, library.encode_ordinary(t)))


def test_empty_table(spark, vocabulary):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op01_bpe.encode_decode(docs, vocabulary).agg(F.count("*")).first()[0] == 0
