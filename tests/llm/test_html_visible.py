"""Pages with formulas, drawings, fields, lists of options and object elements."""

from tabsmith.llm import op09_html

PAGES = [
    ("<p>a <span aria-hidden='true'>b</span> c", "a b c"),
    ("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation>x=\\frac12</annotation></semantics></math> holds",
     "so x= 1 2 holds"),
    ("<math><mtext>if <b>n</b></mtext><mi>y</mi></math>z", "if nyz"),
    ("<svg><title/><desc>no</desc>no<path d='M0'/><g><text x=1>one <tspan>two</tspan></text><text>three</text></g><defs><text>no</text></defs></svg><p>end",
     "one two\nthree\n\nend"),
    ("<svg><circle r=1/><foreignObject><div>in</div></foreignObject></svg>out", "in\nout"),
    ("<svg><path><p>left</p>", "left"),
    ("<textarea>\n a &lt; b\n  c</textarea>d", " a < b\n  c\nd"),
    ("x <select><option>A<option selected>B<option>C</select> y", "x B y"),
    ("x <select><option disabled>-<optgroup label=g><option>A</select> y", "x A y"),
    ("x<select multiple><optgroup label=g><option>A<option label=L>B</select>y", "x\ng\nA\nL\ny"),
    ("<object data=a.pdf><param name=p><p>see <a href=b>b</a></p></object>", "see b"),
    ("<input value=v><input type=hidden value=no><input type=password value=no><input type=submit><input placeholder='your name'>", "v Submit your name"),
    ("<svg hidden><text>no</text></svg><math style='display:none'><mi>no</mi></math><iframe>no</iframe>k", "k"),
]


def test_visible_text(spark):
    for page, want in PAGES:
        assert op09_html.extract(page) == want, page
    pages = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)], "page_id long, html string")
    assert {r.page_id: r.text for r in op09_html.extract_text(pages).collect()} == {i: w for i, (_, w) in enumerate(PAGES)}
    deep = "<svg>" + "<g>" * 20_000 + "<text>in</text>" + "</g>" * 20_000 + "</svg>"
    assert op09_html.extract(deep) == "in"
