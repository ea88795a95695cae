"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text (character classes, words, lines, repetition),
vectorised over a batch.  The trees are fitted on at most ``train_rows`` labelled
documents, those with the smallest hash of their id (the documented bound of the
fit), and every document is scored by descending the flattened trees in its task.

Defined results: null and empty texts have all statistics 0 and are scored like
others; documents of several label rows take their mean label (0.5 and more is 1), null
labels are skipped; without labels, or with one label only, the score is the share of
label 1, smoothed; repeated rows are scored each; a null id is never held out.
Labels, lang, source and ids are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .trees import Forest, boost

TRAIN_ROWS = 20_000
SLICE_BYTES = 2 << 20

# Byte classes whose shares are statistics.
CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": b" \t", "line": b"\n\r", "stop": b".,;:?",
    "bang": b"!", "pipe": b"|", "money": b"$", "percent": b"%", "hash": b"#", "amp": b"&", "star": b"*", "bracket": b"()[]{}<>",
    "quote": b"\"'`", "dash": b"-_=+~^/\\@", "high": range(128, 256), "control": [*range(9), 11, 12, *range(14, 32), 127],
}
STATISTICS = [*CLASSES, "log_bytes", "log_words", "word_length", "word_spread", "longest_word", "distinct_words", "top_word",
              "same_as_last", "short_words", "odd_ends", "capital_words", "digit_words", "distinct_pairs", "lines", "line_words",
              "repeated_lines", "sentence_words", "class_changes"]
_CLASS = np.zeros(256, np.uint8)
for _i, _c in enumerate(CLASSES.values()):
    _CLASS[list(_c)] = _i
_CODE = {name: i for i, name in enumerate(CLASSES)}
_SPACE = tk.space_words()
_LINES = np.ones(256, bool)
_LINES[[10, 13]] = False


def _sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask, dtype=np.float64)])
    return c[off[1:]] - c[off[:-1]]


def _distinct(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the largest count of one value, per text."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((h, row))
    v, r = h[order], row[order]
    head = np.ones(len(v), bool)
    head[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(head)
    n = np.diff(np.concatenate([at, [len(v)]]))
    most = np.zeros(len(off) - 1)
    np.maximum.at(most, r[at], n)
    return np.bincount(r[at], minlength=len(off) - 1).astype(float), most


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, STATISTICS) of a batch."""
    n = np.diff(off).astype(float)
    size = np.maximum(n, 1)
    cls = _CLASS[buf]
    out = {name: _sums(cls == i, off) / size for i, name in enumerate(CLASSES)}
    start, end, woff = tk.words(buf, off, _SPACE)
    h = tk.span_hashes(buf, start, end, tk.BYTE_SYMBOL)
    words = np.diff(woff).astype(float)
    some = np.maximum(words, 1)
    length = (end - start).astype(float)
    out["log_bytes"], out["log_words"] = np.log1p(n), np.log1p(words)
    out["word_length"] = _sums(length, woff) / some
    out["word_spread"] = np.sqrt(np.maximum(0, _sums(length ** 2, woff) / some - out["word_length"] ** 2))
    longest = np.zeros(len(n))
    row = np.repeat(np.arange(len(n)), np.diff(woff))
    np.maximum.at(longest, row, length)
    out["longest_word"] = np.log1p(longest)
    distinct, most = _distinct(h, woff)
    out["distinct_words"], out["top_word"] = distinct / some, most / some
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    out["same_as_last"] = _sums(same, woff) / some
    out["short_words"] = _sums(length <= 3, woff) / some
    head, last = (cls[start], cls[end - 1]) if len(start) else (cls[:0], cls[:0])
    odd = np.isin(last, [_CODE[k] for k in ("bang", "pipe", "money", "percent", "hash", "amp", "star", "dash", "control")])
    out["odd_ends"] = _sums(odd, woff) / some
    out["capital_words"] = _sums(head == _CODE["upper"], woff) / some
    digits = np.concatenate([[0], np.cumsum(cls == _CODE["digit"])])
    out["digit_words"] = _sums(digits[end] > digits[start], woff) / some
    pair = np.where(np.concatenate([row[1:] == row[:-1], [False]]), tk.mix64(h * np.uint64(3) + np.concatenate([h[1:], h[:1]])), np.uint64(0)) if len(h) else h
    out["distinct_pairs"] = _distinct(pair, woff)[0] / some
    ls, le, loff = tk.words(buf, off, _LINES)
    lines = np.diff(loff).astype(float)
    out["lines"] = np.log1p(lines)
    out["line_words"] = words / np.maximum(lines, 1)
    out["repeated_lines"] = 1 - _distinct(tk.span_hashes(buf, ls, le, tk.BYTE_SYMBOL), loff)[0] / np.maximum(lines, 1)
    stops = _sums(np.isin(last, [_CODE["stop"], _CODE["bang"]]), woff)
    out["sentence_words"] = words / np.maximum(stops, 1)
    change = np.zeros(len(buf), bool)
    change[1:] = cls[1:] != cls[:-1]
    out["class_changes"] = _sums(change, off) / size
    return np.stack([out[k] for k in STATISTICS], axis=1)


def _slices(off: np.ndarray):
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
        yield i, j
        i = j


def document_statistics(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """``keep`` and an array column ``x`` of statistics."""
    src = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)
    kept = src.schema.fields[1:]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "x array<double>"])

    def run(batches):
        for b in batches:
            buf, off, _ = tk.texts(b.column(0))
            for i, j in _slices(off):
                x = statistics(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(k + 1).slice(i, j - i) for k in range(len(kept))), flat],
                                                 names=[*(f.name for f in kept), "x"])
        tk.release()

    return src.mapInArrow(run, schema)


def held_out(id_col: str) -> Column:
    """Documents whose labels are never learnt from: crc32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        train_rows: int = TRAIN_ROWS) -> Forest:
    """Boosted trees on at most ``train_rows`` labelled documents outside the held-out third."""
    picked = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
              .filter("_id is not null and _y is not null").filter(~held_out("_id"))
              .groupBy("_id").agg((F.avg("_y") >= 0.5).cast("double").alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(train_rows))
    seen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(picked), "_id")  # train_rows at most
    rows = document_statistics(seen, "_t", [F.col("_id"), F.col("_y")])
    # An id may stand in several rows: the bound holds for rows as well.
    table = rows.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("x")).limit(train_rows).toPandas()
    if not len(table):
        return boost(np.zeros((0, len(STATISTICS))), np.zeros(0))
    return boost(np.stack(table["x"].to_numpy()).astype(float), table["_y"].to_numpy(float))


def score(docs: DataFrame, model: Forest, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, score) of every row, with the columns ``keep``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("doc_id"),
                      *[F.col(c) for c in keep or []])
    kept = src.schema.fields[1:]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"])

    def run(batches):
        for b in batches:
            buf, off, _ = tk.texts(b.column(0))
            for i, j in _slices(off):
                raw = sent.value.raw(statistics(buf[off[i]:off[j]], off[i:j + 1] - off[i]))
                yield pa.RecordBatch.from_arrays([*(b.column(k + 1).slice(i, j - i) for k in range(len(kept))),
                                                  pa.array(1 / (1 + np.exp(-raw)))], names=[*(f.name for f in kept), "score"])
        tk.release()

    return src.mapInArrow(run, schema)
