"""Licence scans, secret scans and HTML extraction on small inputs."""

import random

from pyspark.sql import functions as F

from tabsmith.llm import op06_licenses, op08_secrets, op09_html


def test_licences(spark):
    texts = [None, "", "Some words. Licensed under CC BY-NC 4.0.\nMore words", "Released under the MIT License.", "released   UNDER the mit-license!\n",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
             "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nx y z.\n"
             "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
             "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. Licensed under CC BY 4.0",
             "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: MIT", "the MIT License", "Neither. Nor. " * 2000]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, texts[3], "c"), (3, texts[3], "c")],
                                 "doc_id long, text string, licenses string")
    got = op06_licenses.scan_licenses(docs).collect()
    want = {0: [], 1: [], 2: ["CC-BY-NC-4.0"], 3: ["MIT"], 4: ["MIT"], 5: ["CC-BY-4.0", "GPL-3.0-or-later"], 6: ["MIT"], 7: [], 8: []}
    assert len(got) == len(texts) + 2
    assert all(r.licenses == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.sentence_ids for r in got if r.doc_id == 6] == [[29, 29]]
    assert {r.n_sentences for r in got if r.doc_id in (0, 1)} == {0}
    assert op06_licenses.scan_licenses(docs.limit(0)).count() == 0


def secret_docs(seed=3, n=600):
    rnd = random.Random(seed)
    stems = ["the", "tion", "and", "her", "ing", "for", "ent", "ment"]
    hexa = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    rows, secret = [], {}
    for i in range(n):
        w = ["".join(rnd.choice(stems) for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(0, 60))]
        kind = i % 6
        value = {0: f"password={hexa(18)}", 1: f'token = "{hexa(40)}"', 2: "AKIA" + "".join(rnd.choice("ABCDEFGH234567") for _ in range(16)),
                 3: f"{rnd.choice(stems)}.{rnd.randint(10, 99)}@mail{rnd.randint(1, 9)}.example.com", 4: str(rnd.randint(10 ** 15, 10 ** 16)), 5: ""}[kind]
        at = rnd.randint(0, len(w))
        rows.append((i, " ".join(w[:at] + [value] + w[at:]), "x"))
        if kind < 3:
            secret[i] = value.split("=")[-1].strip(' "')
    return rows, secret


def test_secrets_are_found_and_replaced(spark):
    rows, secret = secret_docs()
    rows += [(None, "password=0123456789abcdef01", "x"), (9000, None, "x"), (9001, "", "x"), (9002, "é" * 5000 + " word", "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets string").repartition(4)
    model = op08_secrets.fit(docs)
    got = op08_secrets.scan(docs, model).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: [x.value for x in r.secrets] for r in got if r.secrets and r.doc_id is not None}
    assert found == {k: [v] for k, v in secret.items()}
    clean = {r.doc_id: r.text for r in op08_secrets.redact(docs, model).collect() if r.doc_id is not None}
    for i, text, _ in rows:
        if i is not None:
            assert clean[i] == (text.replace(secret[i], op08_secrets.REDACTED) if i in secret else text)


def test_secrets_without_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "plain words only")], "doc_id long, text string")
    assert op08_secrets.fit(docs).forest is None
    assert op08_secrets.scan(docs, op08_secrets.fit(docs)).first().n_candidates == 0
    none = docs.limit(0)
    assert op08_secrets.redact(none, op08_secrets.fit(none)).count() == 0


def test_forest_generalises_to_unlabelled_findings(spark):
    rows, _ = secret_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets string")
    model = op08_secrets.fit(docs)
    c = op08_secrets.candidates
    import numpy as np
    text = b'use secret = "q7Gh3kLm9Zx2Wv8Bn4Rt6Yp1" now'
    own = c(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(own) == 1 and model.scores(own)[0] >= 0.5


PAGES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<ul><li>x<li>y<ol start=3><li>n<li>m</ol></ul>z", "* x\n* y\n 3. n\n 4. m\n\nz"),
    ("<table><tr><th>h1<th>long header<tr><td>1<br>2<td>q</table>", "h1  long header\n1   q\n2"),
    ("a<div hidden>no</div><span style='display: none'>no</span><script>if (a<b) x</script><b>b</b> c &amp; d", "ab c & d"),
    ("<pre> a\n   b</pre>", " a\n   b"),
    ("one\n  two<br>three", "one two\nthree"),
    ("<h1>T</h1><p>x <a href='q>r'>y</a></p></div></p>", "T\n\nx y"),
    ("<title>t</title><style>p{}</style>", ""),
    ("x < y <unclosed", "x < y <unclosed"),
    ("", ""), (None, ""),
]


def test_html(spark):
    for page, want in PAGES:
        assert op09_html.extract(page) == want, page
    deep = "<div>" * 20_000 + "in" + "</div>" * 20_000
    assert op09_html.extract(deep) == "in"
    pages = spark.createDataFrame([(i, p, "t") for i, (p, _) in enumerate(PAGES)] + [(None, "<p>n", "t")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in op09_html.extract_text(pages).collect()}
    assert got == {**{i: w for i, (_, w) in enumerate(PAGES)}, None: "n"}
    assert op09_html.extract_text(pages.limit(0)).count() == 0
    assert dict(op09_html.extract_text(pages.select(F.col("page_id").cast("string"), "html")).dtypes)["page_id"] == "string"
