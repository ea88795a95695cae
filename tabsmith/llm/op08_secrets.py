"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a run of key characters (printable ASCII without quotes, brackets and list
marks) of some length that holds digits or mixed case in an unusual amount (a wide net), in
words of any length and beside any byte.  Issuer formats, private key blocks and values
assigned to names of secrets are candidates of their own at any length, wherever they stand
in a word; they are cut out of the run around them, so candidates don't overlap.  A word that
passes the net with no such run of 8 bytes is a candidate as a whole.  The forest sees its length, its character transitions (under
letter-pair counts of all documents), the share that dictionary words cover (common
short words of all documents), whether it looks like a path or address, and the
words beside it.  It learns from labelled findings: issuer formats and assignments to
names of secrets are secrets, whatever harmless form they have otherwise (a link but for its
own parts); addresses, numbers, dates and links are not; candidates without a label are left
to the forest, and a labelled secret stays one whatever the forest says.  It is fitted on at most ``train_rows``
findings, those with the smallest hash (the documented bound of the fit); counts cover
all documents.

Defined results: null or empty texts have no candidates; equal findings score alike;
repeated rows are scanned each; other columns are kept as they are by ``redact`` and
not read otherwise; without labelled findings of both kinds the labels themselves decide.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import materialize
from . import textkit as tk
from .trees import Forest, random_forest

TRAIN_ROWS = 20_000
DICTIONARY = 4096        # most common short words that may be sent to all tasks
SHORTEST = 12            # bytes of a word in the wide net; its value may have 4 less
CONTEXT = 64             # bytes that are read of a word beside a candidate, and of a name
SLICE_BYTES = 2 << 20
REDACTED = "[SECRET]"

# Formats that issuers publish, and names that secrets are assigned to.
ISSUED = re.compile(rb"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
                    rb"|AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9])|[sr]k_live_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{20,}"
                    rb"|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_.-]{10,}"
                    rb"|-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----)[^\0])*-----END (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----"
                    rb"|(?:(?:\\[rn]|\s)*[A-Za-z0-9+/=]{16,})+)")
ISSUED_HEADS = [b"AKIA", b"ASIA", *(b"gh%c_" % c for c in b"pousr"), *(b"xox%c-" % c for c in b"abprs"), b"AIza", b"sk_live_", b"rk_live_",
                b"glpat-", b"eyJ", b"-----BEGIN "]
NAMES = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)$", re.I)
HARMLESS = [re.compile(p) for p in (
    r"[\w.+-]+@[\w-]+(\.[\w-]+)+", r"[+(]?[\d().\s+-]+", r"\d{1,3}(\.\d{1,3}){3}(:\d+)?", r"\d{4}-\d{2}-\d{2}.*", r"(https?|ftp)://.*",
    r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", r"[^\W\d_]+", r"(\w+[.,;:!?]+)+\w*", r"(/[\w.-]+)+/?")]
FEATURES = ["length", "digits", "upper", "lower", "other", "distinct", "entropy", "hex", "kinds_change", "letter_pairs", "rare_pairs",
            "dictionary", "longest_word", "path", "address", "quoted", "assigned", "secret_name_before", "secret_name_in", "digit_before",
            "word_before_known", "word_after_known", "longest_digits"]
_SPACE = tk.space_words()
_TRIM = "\"'`,;:()[]{}<>"
_KEY = np.zeros(256, bool)
_KEY[33:127] = True
_KEY[list(b"\"'`,;(){}[]<>|&?")] = False
_QUOTE = rb"\\?[\"'`]|\xe2\x80[\x98-\x9f]"
_LEFT = re.compile(rb"([A-Za-z_][\w-]*)(?:" + _QUOTE + rb"|[\])])*[ \t]*$")
_RIGHT = re.compile(rb"(?::=|=>|[=:]+)(?!//)([ \t]*)(" + _QUOTE + rb")?")
_CLOSED = {b'"': rb'(?:[^"\\\r\n]|\\[^\r\n])+', b"'": rb"(?:[^'\\\r\n]|\\[^\r\n])+", b"`": rb"[^`\r\n]+"}
_CLOSED = {k: re.compile(v + rb"(?=" + k + rb")") for k, v in _CLOSED.items()}
_CLOSED_ESCAPED = re.compile(rb"[^\"'`\\\r\n]+(?=\\[\"'`])")
_CLOSED_CURLY = re.compile(rb"(?:(?!\xe2\x80[\x98-\x9f])[^\r\n])+(?=\xe2\x80[\x98-\x9f])")
# An open value of a secret's name: ASCII but blanks, quotes and list marks, and Latin letters with accents.
_OPEN = re.compile(rb"(?:[!#-%(-+\--:<-_a-~]|[\xc3-\xc9][\x80-\xbf])+")


@dataclass
class Statistics:
    """Letter-pair log probabilities (27 x 27, the last is any other byte) and common short words."""
    pairs: np.ndarray
    dictionary: set[bytes] = field(default_factory=set)


def _letter(buf: np.ndarray) -> np.ndarray:
    low = tk.LOWER[buf]
    return np.where((low >= 97) & (low <= 122), low.astype(np.int64) - 97, 26)


def gather(docs: DataFrame, text_col: str = "text") -> Statistics:
    """Counts over all documents: letter pairs, and words of 3 to 6 small letters."""
    def count(batches):
        pairs = np.zeros(27 * 27, np.int64)
        for b in batches:
            buf, off, _ = tk.texts(b.column(0))
            for i, j in _slices(off):
                part, po = buf[off[i]:off[j]], off[i:j + 1] - off[i]
                if not len(part):
                    continue
                c = _letter(part)
                pairs += np.bincount(c[:-1] * 27 + c[1:], minlength=27 * 27)
                start, end, _ = tk.words(part, po, _SPACE)
                small = np.concatenate([[0], np.cumsum((part >= 97) & (part <= 122))])
                n = end - start
                pick = np.flatnonzero((n >= 3) & (n <= 6) & (small[end] - small[start] == n))
                if not len(pick):
                    continue
                padded = np.concatenate([part, np.zeros(6, np.uint8)])
                word = padded[start[pick][:, None] + np.arange(6)]
                word[np.arange(6) >= n[pick][:, None]] = 0
                key = (word.astype(np.int64) << (8 * np.arange(6))).sum(1)
                u, k = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u + 1_000), pa.array(k, pa.int64())], names=["key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(27 * 27)), pa.array(pairs)], names=["key", "n"])

    counts = materialize(docs.select(F.col(text_col).cast("string")).mapInArrow(count, "key long, n long")
                         .groupBy("key").agg(F.sum("n").alias("n")), "letter_counts")
    pairs = np.ones((27, 27))
    for r in counts.filter("key < 1000").collect():  # 729 at most
        pairs[divmod(r.key, 27)] += r.n
    common = counts.filter("key >= 1000").orderBy(F.desc("n"), "key").limit(DICTIONARY).collect()  # the bound above
    words = {int(r.key - 1_000).to_bytes(6, "little").rstrip(b"\0") for r in common}
    return Statistics(np.log(pairs / pairs.sum(1, keepdims=True)), words)


def _slices(off: np.ndarray):
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
        yield i, j
        i = j


@dataclass
class Candidate:
    text: int          # number of the text in its batch
    start: int         # byte position of the value in the text
    value: str
    name: str          # name that it is assigned to, if any
    quoted: bool
    before: list[str]  # up to two words before
    after: str


def _issued(raw: bytes, off: np.ndarray) -> list[tuple[int, int]]:
    """Spans of issuer formats, in order and apart from each other; none reaches out of its text."""
    heads = []
    for head in ISSUED_HEADS:
        at = raw.find(head)
        while at >= 0:
            heads.append(at)
            at = raw.find(head, at + 1)
    out: list[tuple[int, int]] = []
    for at in sorted(heads):
        if (not out or at >= out[-1][1]) and (m := ISSUED.match(raw, at, int(off[np.searchsorted(off, at, "right")]))):
            out.append((at, at + len(m[0].rstrip(b"."))))
    return out


def _assigned(raw: bytes, at: int, low: int, high: int):
    """(name, start of the name, start and end of the value, quoted, blank) of the pair whose sign stands at ``at``;
    the value of another name than a secret's has no end."""
    left = _LEFT.search(raw, max(low, at - 2 * CONTEXT), at)
    right = _RIGHT.match(raw, at, high)
    if not left or not right or right.end() >= high:
        return None
    name, start, quote = left[1].decode(), right.end(), right[2]
    end = None
    if NAMES.search(name):
        m = None
        if quote:
            m = (_CLOSED_CURLY if quote[0] > 127 else _CLOSED_ESCAPED if len(quote) > 1 else _CLOSED[quote]).match(raw, start, high)
        if m is None and (m := _OPEN.match(raw, start, high)):
            value = m[0].decode("utf-8", "replace").rstrip(_TRIM + ".!?")
            start += len(m[0]) - len(m[0].lstrip(_TRIM.encode()))
            end = m.start() + len(value.encode())
        elif m:
            end = m.end()
        if end is not None and (end <= start or raw[start:start + 2] == b"//" or re.match(rb"(https?|ftp)://", raw[start:end])):
            end = None
    return name, left.start(), start, end, bool(quote), bool(right[1])


def candidates(buf: np.ndarray, off: np.ndarray) -> list[Candidate]:
    start, end, woff = tk.words(buf, off, _SPACE)
    if not len(start):
        return []
    raw = buf.tobytes()
    digits, upper, lower, high = (np.concatenate([[0], np.cumsum(m)]) for m in (
        (buf >= 48) & (buf <= 57), (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122), buf >= 128))

    def net(i, j):
        d, u, w = (s[j] - s[i] for s in (digits, upper, lower))
        return (d >= 2) | ((u >= 3) & (w >= 3)) | ((u >= 10) & (d >= 1))

    fixed = [(i, j, "", False) for i, j in _issued(raw, off)]     # candidates whatever their form
    named: dict[int, tuple[str, int, bool]] = {}             # start of a value: its name, start of the name, quoted
    ops: list[tuple[int, int]] = []                          # signs and quotes between a name and its value in one word
    sign = np.flatnonzero((buf == 58) | (buf == 61))
    if len(sign):
        sign = sign[np.concatenate([[True], sign[1:] != sign[:-1] + 1])]
        text = np.searchsorted(off, sign, "right") - 1
        for at, lo, hi in zip(sign.tolist(), off[text].tolist(), off[text + 1].tolist(), strict=True):
            pair = _assigned(raw, at, lo, hi)
            if pair is None:
                continue
            name, left, first, last, quoted, blank = pair
            named[first] = (name, left, quoted)
            if last is not None:
                fixed.append((first, last, name, quoted))
            if not blank:
                ops.append((at, first))
    taken: list[tuple[int, int, str, bool]] = []             # apart from each other, the earlier and longer first
    for i, j, name, quoted in sorted(fixed, key=lambda x: (x[0], -x[1], -len(x[2]))):
        if not taken or i >= taken[-1][1]:
            taken.append((i, j, name, quoted))
        elif j > taken[-1][1]:
            k = taken[-1]
            taken[-1] = (k[0], j, k[2], k[3])

    # Runs of key characters: cut at pair signs and at what is taken.
    key = _KEY[buf]
    for i, j in ops:
        key[i:j] = False
    for i, j, _, _ in taken:
        key[i:j] = False
    n = end - start
    pick = (n >= SHORTEST) & net(start, end)
    rs, re_, _ = tk.words(np.where(key, buf, np.uint8(32)), off, _SPACE)
    word = np.searchsorted(start, rs, "right") - 1
    use = (re_ - rs >= SHORTEST - 4) & pick[word] if len(rs) else np.zeros(0, bool)
    rs, re_, word = rs[use], re_[use], word[use]
    many = np.bincount(word, minlength=len(start))
    touched = np.zeros(len(start), bool)
    for i, j, _, _ in taken:
        touched[max(0, int(np.searchsorted(start, i, "right")) - 1):int(np.searchsorted(start, j, "left"))] = True
    found = [(i, j, name, quoted, False) for i, j, name, quoted in taken]
    for i, j, w in zip(rs.tolist(), re_.tolist(), word.tolist(), strict=True):
        name, left, quoted = named.get(i, ("", i, i > 0 and raw[i - 1:i] in (b'"', b"'", b"`")))
        if many[w] == 1 and not touched[w] or net(max(left, int(start[w])), j) and j - max(left, int(start[w])) >= SHORTEST - 4:
            found.append((i, j, name, quoted, True))
    for w in np.flatnonzero(pick & (many == 0) & ~touched & (high[end] == high[start])).tolist():
        found.append((int(start[w]), int(end[w]), "", raw[start[w]:start[w] + 1] in (b'"', b"'", b"`"), True))

    def context(w, last):
        return (raw[max(start[w], end[w] - CONTEXT):end[w]] if last else raw[start[w]:min(end[w], start[w] + CONTEXT)]).decode("utf-8", "replace")

    out = []
    for i, j, name, quoted, free in sorted(found):
        value = raw[i:j].decode("utf-8", "replace")
        if free:
            lead = len(value) - len(value.lstrip(_TRIM))
            value = value.strip(_TRIM).rstrip(".!?")
            i += lead
            if len(value) < SHORTEST - 4:
                continue
        d = int(np.searchsorted(off, i, "right")) - 1
        w = int(np.searchsorted(start, i, "right")) - 1
        z = max(w, int(np.searchsorted(start, i + len(value.encode()), "left")) - 1)
        before = [context(k, True) for k in range(max(int(woff[d]), w - 2), w)]
        if not name:
            if len(before) == 2 and before[1] in ("=", ":", ":=", "=>"):
                name = before[0].strip(_TRIM)
            elif before and before[-1][-1:] in "=:" and before[-1][-1:]:
                name = before[-1].rstrip("=:").strip(_TRIM)
        out.append(Candidate(d, i - int(off[d]), value, name, quoted, before, context(z + 1, False) if z + 1 < woff[d + 1] else ""))
    return out


def label(c: Candidate) -> int:
    """Labelled findings: 1 a secret, 0 harmless, -1 unknown."""
    if ISSUED.fullmatch(c.value.encode()):
        return 1
    if NAMES.search(c.name) and len(c.value) >= 6 and re.search(r"\d", c.value) and re.search(r"[A-Za-z]", c.value) \
            and not re.match(r"(https?|ftp)://", c.value):
        return 1
    if NAMES.search(c.name) and c.quoted:
        return -1
    if any(p.fullmatch(c.value) for p in HARMLESS):
        return 0
    return -1


def features(c: Candidate, stats: Statistics) -> list[float]:
    v = c.value
    n = len(v)
    b = v.encode()
    kinds = ["d" if x.isdigit() else "u" if x.isupper() else "l" if x.islower() else "o" for x in v]
    share = [kinds.count(k) / n for k in "dulo"]
    count = np.array([v.count(x) for x in set(v)]) / n
    letters = _letter(np.frombuffer(b, np.uint8))
    step = stats.pairs[letters[:-1], letters[1:]]
    runs = [r for r in re.findall(rb"[a-z]+", b.lower())]
    covered = longest = 0
    for r in runs:
        i = 0
        while i < len(r):
            for k in range(min(6, len(r) - i), 2, -1):
                if r[i:i + k] in stats.dictionary:
                    covered, longest, i = covered + k, max(longest, k), i + k
                    break
            else:
                i += 1
    known = lambda w: float(w.lower().strip(_TRIM + ".").encode() in stats.dictionary)
    last = c.before[-1] if c.before else ""
    return [n, *share, len(set(v)) / n, float(-(count * np.log2(count)).sum()), float(re.fullmatch(r"[0-9a-fA-F]+", v) is not None),
            sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)) / n, float(step.mean()) if n > 1 else 0.0, float((step < -5).mean()) if n > 1 else 0.0,
            covered / n, longest, v.count("/") + v.count("\\"), float("@" in v) + v.count(".") / n, float(c.quoted), float(bool(c.name)),
            float(any(NAMES.search(w.strip(_TRIM + "=")) is not None for w in c.before)), float(NAMES.search(c.name) is not None),
            float(any(x.isdigit() for x in last)), known(last), known(c.after), max((len(x) for x in re.findall(r"\d+", v)), default=0)]


def findings(docs: DataFrame, stats: Statistics, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, value, label, x): every candidate with its features; label -1 where unknown."""
    sent = docs.sparkSession.sparkContext.broadcast(stats)

    def run(batches):
        for b in batches:
            buf, off, _ = tk.texts(b.column(1))
            ids = b.column(0).to_pylist()
            for i, j in _slices(off):
                c = candidates(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i + x.text] for x in c], pa.int64()), pa.array([x.start for x in c], pa.int64()),
                     pa.array([x.value for x in c], pa.string()), pa.array([label(x) for x in c], pa.int32()),
                     pa.array([features(x, sent.value) for x in c], pa.list_(pa.float64()))],
                    names=["doc_id", "start", "value", "label", "x"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, start long, value string, label int, x array<double>")


@dataclass
class Model:
    forest: Forest | None
    stats: Statistics

    def scores(self, found: list[Candidate]) -> np.ndarray:
        if not found:
            return np.zeros(0)
        if self.forest is None:
            return np.array([float(label(c) == 1) for c in found])
        sure = np.array([float(label(c) == 1) for c in found])
        return np.maximum(sure, np.clip(self.forest.raw(np.array([features(c, self.stats) for c in found], float)), 0, 1))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """Forest on at most ``train_rows`` distinct labelled findings, half of each kind at most."""
    stats = gather(docs, text_col)
    seen = findings(docs, stats, id_col, text_col).filter("label >= 0").dropDuplicates(["value", "x"])
    seen = materialize(seen.select("label", "x", F.xxhash64("value", "x").alias("h")), "findings")
    half = [seen.filter(F.col("label") == k).orderBy("h").limit(train_rows // 2).toPandas() for k in (0, 1)]
    if not all(len(h) for h in half):
        return Model(None, stats)
    x = np.concatenate([np.stack(h["x"].to_numpy()).astype(float) for h in half])
    y = np.concatenate([h["label"].to_numpy(float) for h in half])
    return Model(random_forest(x, y), stats)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("value", pa.string()), ("score", pa.float64()), ("label", pa.int32())]))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_candidates, secrets): secrets are the candidates that score 0.5 or more, with byte position and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            buf, off, _ = tk.texts(b.column(1))
            for i, j in _slices(off):
                c = candidates(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                n, got = np.zeros(j - i, np.int64), [[] for _ in range(j - i)]
                for x, s in zip(c, sent.value.scores(c), strict=True):
                    n[x.text] += 1
                    if s >= 0.5:
                        got[x.text].append({"start": x.start, "value": x.value, "score": float(s), "label": label(x)})
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(got, _SPANS)],
                                                 names=["doc_id", "n_candidates", "secrets"])
        tk.release()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, n_candidates long, secrets array<struct<start:long,value:string,score:double,label:int>>")


def redact(docs: DataFrame, model: Model, text_col: str = "text", put: str = REDACTED) -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced; other rows and columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)
    mark = put.encode()

    def run(batches):
        for b in batches:
            buf, off, nulls = tk.texts(b.column(at))
            for i, j in _slices(off):
                part, po = buf[off[i]:off[j]], off[i:j + 1] - off[i]
                c = candidates(part, po)
                text = b.column(at).slice(i, j - i)
                hits = [(x, s) for x, s in zip(c, sent.value.scores(c), strict=True) if s >= 0.5]
                if hits:
                    new = text.to_pylist()
                    by: dict[int, list[Candidate]] = {}
                    for x, _ in hits:
                        by.setdefault(x.text, []).append(x)
                    for d, own in by.items():
                        raw = part[po[d]:po[d + 1]].tobytes()
                        for x in sorted(own, key=lambda x: -x.start):
                            raw = raw[:x.start] + mark + raw[x.start + len(x.value.encode()):]
                        new[d] = raw.decode()
                    text = pa.array(new, b.column(at).type)
                cols = [text if k == at else b.column(k).slice(i, j - i) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols, schema=b.schema)
        tk.release()

    return docs.mapInArrow(run, docs.schema)
