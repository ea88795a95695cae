"""Alignment against a plain walk over both token lists."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest

from tabsmith.llm import op12_alignment as op

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def brute(rows):
    """Contract's columns by sets of ends, document by document."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = op.byte_letters()

    def of_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    docs, pairs = [], Counter()
    for i, t in rows:
        x = y = groups = links = []
        if t:
            x = a.encode(" " + t, add_special_tokens=False).ids
            y = b.encode(t)
            bx = [bytes(letters[c] for c in a.id_to_token(k)) for k in x]
            by = [of_b(k) for k in y]
            if b"".join(bx) != (" " + t).encode() or b"".join(by) != (" " + t).encode():
                x = y = []
            else:
                ex, ey = np.cumsum([len(k) for k in bx]).tolist(), np.cumsum([len(k) for k in by]).tolist()
                both = sorted(set(ex) & set(ey))
                of_x, of_y = dict(zip(ex, x)), dict(zip(ey, y))
                links = [(of_x[e], of_y[e]) for e in both]
                groups = []
                for lo, hi in zip([0, *both], both):
                    groups.append(([of_x[e] for e in range(lo + 1, hi + 1) if e in of_x], [of_y[e] for e in range(lo + 1, hi + 1) if e in of_y]))
        pairs.update(links)
        docs.append((i, x, y, groups, links))
    top = {}
    for (p, q), n in pairs.items():
        top[q] = max(top.get(q, 0), n)
    out = []
    for i, x, y, groups, links in docs:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((i, len(x), len(y), len(groups), len(links), sum(pairs[k] == top[k[1]] for k in links),
                    sum(pairs[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def found(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, links string, n_a int")
    out = op.align(docs, A, B).withColumn("groups_sha256", op.groups_sha256()).drop("groups")
    out = op.count_links(out, **kw)
    cols = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in cols) for r in out.collect()), key=repr)


ROWS = [(1, "The quick brown fox jumps over the lazy dog."), (2, "The quick brown fox jumps over the lazy dog."), (3, None), (4, ""),
        (5, " "), (6, "  two  blanks \n\n\t lines "), (7, "naïve café — 梦想 \U0001f600 é"), (8, "a ▁ mark"),
        (9, "<|endoftext|><s></s><0x41>"), (None, "no id"), (2, "another text with id 2"), (10, "word " * 400 + "x" * 3000), (11, "\x00\x01"),
        (12, "ﬁ   nbsp"), (13, "\r\n" * 5), (14, "The The The the THE")]


@pytest.mark.parametrize("sent", [op.SENT_PAIRS, 20, 0])
def test_against_brute_force(spark, sent):
    assert found(spark, ROWS, sent_pairs=sent) == brute(ROWS)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_texts_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == brute(rows)


def test_gallop_finds_every_place():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 300):
        t = np.unique(rng.integers(0, 500, n))
        key = rng.integers(-5, 510, 200)
        start = rng.integers(0, n, 200)
        assert (op.gallop(t, key, start) == np.searchsorted(t, key)).all()


def test_rank_encoder_equals_the_files_library():
    """Every code point between letters, digits, marks and blanks."""
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    fast = op.ByteLevel(op.read_file(A))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 16_384):
        texts = [f"a{c}b {c} 1{c}2 .{c}, {c}{c}" for c in points[i:i + 16_384:7]]
        assert [x.ids for x in own.encode_batch([" " + t for t in texts], add_special_tokens=False)] == fast.ids(texts)
