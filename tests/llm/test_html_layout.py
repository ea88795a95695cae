"""Tables against a grid filled cell by cell, states of elements, and time in proportion on hostile pages."""

import random
import time

import pytest

from tabsmith.llm import op09_html as op


def filled(rows):
    """First column of each cell, by marking every slot."""
    taken, out = set(), []
    for r, row in enumerate(rows):
        at, starts = 0, []
        for columns, deep in row:
            while (r, at) in taken:
                at += 1
            starts.append(at)
            taken |= {(r + i, at + j) for i in range(deep) for j in range(columns)}
            at += columns
        out.append(starts)
    return out


def test_grid_against_marked_slots():
    rng = random.Random(3)
    for _ in range(300):
        rows = [[(1, rng.choice([1, 1, 2, 4])) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 7))]
        assert op.grid(rows) == filled(rows)
    assert op.grid([[(2, 2), (1, 1)], [(1, 1)], [(3, 1), (1, 1)]]) == [[0, 2], [2], [0, 3]]


CASES = [
    ("<table><tr><td rowspan=2>A<td>1<tr><td>2</table>", "A  1\n   2"),
    ("<table><tr><td colspan=2>long cell<td>z<tr><td>a<td>b<td>c</table>", "long cell  z\na  b       c"),
    ("<table><tfoot><tr><td>f<td>g</tfoot><tr><td>a<td>b</table>", "a  b\nf  g"),
    ("<table><tr><td>梦<td>x<tr><td>ab<td>y</table>", "梦  x\nab  y"),
    ("<table><tr><td>only</td></tr><tr><td>rows</td></tr></table>", "only\nrows"),
    ("<details><summary>S</summary>no</details>t", "S\nt"), ("<details open><summary>S</summary>yes</details>", "S\nyes"),
    ("a<dialog>no</dialog>b<dialog open>c</dialog>", "ab\nc"),
    ("<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b></p>", "yes"),
    ("<ol start=3 type=a><li>x<li value=27>y<li>z</ol>", "c. x\naa. y\nab. z"), ("<ol reversed type=I><li>x<li>y</ol>", "II. x\nI. y"),
    ("a<!-- x --!>b<!-->c", "abc"), ("<svg><text><![CDATA[c<d]]></text></svg>", "c<d"), ('t <a title="x>y', "t"), ("t <a title", "t <a title"),
    ('<a title="1>2" href=/x/>y</a><br/>z', "y\nz"), ("</ x>a</>b<?php x>c<!doctype y>d", "abcd"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_layout(page, want):
    assert op.extract(page) == want


HOSTILE = ['<a "', "<div>", "<a ", '<a x="', "<p><button><div>", "<ul><li>x", "<b><i>", "<!-", "<svg><![CDATA[", "<td rowspan=60000>x", "</p>", "<table><tr><td>x<td>",
           "<textarea>", "&amp<"]


@pytest.mark.parametrize("pattern", HOSTILE)
def test_time_grows_in_proportion(pattern):
    """Four times the page takes less than ten times the time (sixteen times, were it quadratic), or next to nothing."""
    took = []
    for n in (1500, 6000):
        page, best = pattern * n, 9e9
        for _ in range(2):
            start = time.process_time()
            op.extract(page)
            best = min(best, time.process_time() - start)
        took.append(best)
    assert took[1] < 0.2 or took[1] < 10 * took[0]
