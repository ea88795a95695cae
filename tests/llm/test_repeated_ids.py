"""An id that is repeated with different contents joins their classes, also when it isn't the smallest of them."""

from tabsmith.llm import op02_jaccard_join, op04_grid_join

IDS = [(3, 0), (5, 0), (5, 1), (7, 1), (9, 2), (7, None), (11, 3)]
WANT = {3: {3}, 5: {3}, 7: {3}, 9: {9}, 11: {11}}


def components(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], set()).add(r.component_id)
    return out


def test_documents(spark):
    text = lambda k: "" if k is None else " ".join(f"w{k}x{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text(k)) for i, k in IDS], "doc_id long, text string")
    assert components(op02_jaccard_join.jaccard_join(docs).collect(), "doc_id") == WANT


def test_vectors(spark):
    unit = lambda k: None if k is None else [1.0 if i == k else 0.0 for i in range(8)]
    rows = spark.createDataFrame([(i, unit(k), "l") for i, k in IDS], "vec_id long, embedding array<double>, label string")
    got = op04_grid_join.near_duplicates(rows).collect()
    assert components(got, "vec_id") == WANT
    assert {r.vec_id for r in got if r.kept} == {3, 9, 11}
