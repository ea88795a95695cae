"""The pipeline's stages against brute force on a small fixture, and the guard of the entry module."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from test_decontaminate import brute as decontaminated  # noqa: E402
from test_scans import secret_docs  # noqa: E402

import corpus_pipeline as cp  # noqa: E402
from tabsmith.llm import op08_secrets  # noqa: E402


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rnd = random.Random(11)
    secret, _ = secret_docs(n=120)
    vocab = [f"{a}{b}" for a in ("mor", "tal", "ven", "shi") for b in ("an", "el", "or", "ing", "ed")]
    line = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(k, line(20)) for k in range(5)]
    rows = [(i, t) for i, t, _ in secret]
    base = [line(60) for _ in range(8)]
    for i in range(200, 320):
        w = rnd.choice(base).split()
        if rnd.random() < 0.6:
            w[rnd.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w)))
    rows += [(i, line(10) + " " + items[i % 5][1] + " " + line(30)) for i in range(400, 420)]
    rows += [(i, " ".join(x + "$$$" for x in line(40).split())) for i in range(500, 640)]
    rows += [(700, None), (701, ""), (None, line(30)), (200, rows[120][1])]
    docs = [(i, t, "en", f"s{i or 0}", len(t or "")) for i, t in rows]
    labels = [(i, int(not 500 <= i < 640), 0) for i, _ in rows if i is not None and i not in (700, 701)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows, items


def texts(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.collect())


def test_each_stage(spark, fixture):
    at, rows, items = fixture
    docs = spark.read.parquet(f"{at}/documents.parquet")
    first = cp.quality(spark, docs, at)
    ids = {r.doc_id for r in first.collect()}
    assert first.columns == docs.columns
    assert not [i for i in ids if i is not None and 500 <= i < 640]
    assert {i for i, _ in rows if i is not None and i < 420} <= ids

    kept = cp.near_dups(spark, docs, at)
    want = brute.jaccard_components(rows, shingle=5, num=80)
    smallest = {(i, c) for i, _, c in want}
    expected = sorted({(str(i), str(t)) for i, t in rows if i is None or (str(i), str(i)) in smallest})
    assert sorted(set(texts(kept))) == expected and kept.columns == docs.columns
    assert len(texts(kept)) == len(expected)

    clean = cp.benchmark(spark, docs, at)
    hit = {i for i, n, k, _ in decontaminated(rows, items) if k and 20 * k >= n}
    assert texts(clean) == sorted((str(i), str(t)) for i, t in rows if str(i) not in hit)
    assert clean.columns == docs.columns

    safe = {r.doc_id: r.text for r in cp.secrets(spark, docs, at).collect()}
    assert sum(op08_secrets.REDACTED in (t or "") for t in safe.values()) == 60


def test_run_and_empty_documents(spark, fixture):
    at, rows, _ = fixture
    out = cp.run(spark, at)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    got = {r.doc_id for r in out.collect()}
    assert got and not [i for i in got if i is not None and 500 <= i < 640]
    none = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, at).count() == 0


def test_entry_lists_the_queries():
    import __spark_entry__ as entry
    names = entry.queries()
    for n in range(1, 11):
        assert len([k for k in names if k.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
