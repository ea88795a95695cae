"""HTML extraction by layout-aware rendering.

Each page is parsed into a tree with the implied tags that browsers supply (void
elements, optional end tags of p, li, dt/dd, option, table parts), then all
visible text is rendered: hidden elements and attributes are skipped, blocks
are separated by line breaks (headings, paragraphs and tables by an empty line), lists
get bullets or numbers, table columns are aligned, white space is collapsed
outside pre.  Formulas (MathML), text elements of drawings (SVG), fields, the options that a
list shows and the content of object elements are visible; aria-hidden concerns screen
readers only.  Style sheets aren't read, so a formula that a page holds twice (MathML and
HTML) is rendered twice.  Spanning cells keep the columns and rows that they span; closed details show
their summary, dialogs show when open; list numbers follow start, value, reversed and type.  Pages are
independent: one map over the rows, no shuffle; the page is read once by a forward state machine, open
elements are found by name, and the tree is walked without recursion: time and memory follow the page's size.

Defined results: a null or empty page has an empty text; broken markup never fails (an
unclosed tag is text, an unclosed quote or comment swallows the rest, unknown end tags are dropped); indents stop at
``MAX_INDENT``; tables in more than ``MAX_TABLES`` others, and tables of one column, are rendered as blocks; repeated rows are rendered each; other columns are not read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head script style template noscript iframe canvas audio video datalist title".split())
UNSHOWN = set("defs symbol desc metadata clippath mask pattern marker annotation annotation-xml mphantom".split())  # in svg and math
LEAVES = set("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p
pre ruby s small span strong strike sub sup table tt u ul var""".split())  # these end svg and math
MATH_TEXT = set("mi mo mn ms mtext".split())
MATH_PARTS = set("mfrac msup msub msubsup munder mover munderover mroot mtr mmultiscripts".split())  # their children stand apart
FIELDS = set("text search tel url email number date month week time datetime-local button submit reset".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul""".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
LISTS = set("ul ol menu dir".split())
CELLS = {"td", "th"}
PARTS = {"thead", "tbody", "tfoot"}
# An opening tag closes these open elements, up to a boundary.
CLOSES = {"li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
          "tr": ({"tr", "caption", "colgroup"} | CELLS, {"table"}), "td": (CELLS | {"caption"}, {"tr", "table"}), "th": (CELLS | {"caption"}, {"tr", "table"}),
          **{p: (PARTS | {"tr"} | CELLS | {"caption", "colgroup"}, {"table"}) for p in PARTS}}
ENDS_P = BLOCK - {"body", "html"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SKIP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_IS = re.compile(r"\s*=\s*")
_PLAIN = re.compile(r"[^\s>]*")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_SIGHT = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_BLANK = re.compile(r"[ \t\n\r\f]+")
MAX_TABLES = 16     # tables around a table that is still aligned (each level copies the lines inside)
MAX_INDENT = 80     # columns; deeper lists and quotes aren't indented further


class Node:
    __slots__ = ("tag", "attrs", "children", "foreign")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.foreign = foreign  # "svg" outside its text elements, "text" inside, "math", or "" for HTML


def _foreign(tag: str, parent: Node) -> str:
    if tag in ("svg", "math"):
        return tag
    if tag == "foreignobject" or parent.foreign == "math" and parent.tag in MATH_TEXT:
        return ""
    return "text" if tag == "text" and parent.foreign == "svg" else parent.foreign


class Tokens:
    """Forward state machine over a page, after the HTML standard: every character is read once, so the time is in
    proportion to the page also where tags, quotes or comments never end (an unclosed tag is text, an unclosed quote or comment isn't)."""

    def __init__(self, page: str):
        self.page, self.at = page, 0

    def _after(self, what: str, start: int) -> int:
        end = self.page.find(what, start)
        return len(self.page) if end < 0 else end + len(what)

    def next(self, foreign: bool):
        """("text", text), ("open", tag, attributes, self-closing), ("close", tag), ("skip",) or None at the end."""
        page, at = self.page, self.at
        if at >= len(page):
            return None
        if page[at] != "<":
            end = page.find("<", at)
            self.at = len(page) if end < 0 else end
            return "text", html.unescape(page[at:self.at])
        after = page[at + 1:at + 2]
        if after == "!":
            if page.startswith("<!--", at):
                self.at = self._comment(at + 4)
            elif foreign and page.startswith("<![CDATA[", at):
                self.at = self._after("]]>", at + 9)
                text = page[at + 9:self.at]
                return "text", text.removesuffix("]]>")
            else:
                self.at = self._after(">", at)
            return ("skip",)
        if after == "?":
            self.at = self._after(">", at)
            return ("skip",)
        ends = after == "/"
        name = _NAME.match(page, at + 1 + ends)
        if name is None:
            if ends:
                self.at = self._after(">", at)
                return ("skip",)
            end = page.find("<", at + 1)
            self.at = len(page) if end < 0 else end
            return "text", html.unescape(page[at:self.at])
        attrs, closed = self._attributes(name.end())
        if attrs is None:       # closed says whether a quote is open
            return ("skip",) if closed else ("text", html.unescape(page[at:]))
        return ("close", name[0].lower()) if ends else ("open", name[0].lower(), attrs, closed)

    def _comment(self, start: int) -> int:
        for short in (">", "->"):
            if self.page.startswith(short, start):
                return start + len(short)
        end = re.compile("--!?>").search(self.page, start)
        return end.end() if end else len(self.page)

    def _attributes(self, at: int) -> tuple[dict[str, str] | None, bool]:
        """Attributes up to the tag's end and whether it closes itself; None where the page ends before, and whether in a quote."""
        page, out = self.page, {}
        while True:
            start, at = at, _SKIP.match(page, at).end()
            if at >= len(page):
                self.at = at
                return None, False
            if page[at] == ">":
                self.at = at + 1
                return out, at > start and page[at - 1] == "/"
            key = _KEY.match(page, at)
            at, value = key.end(), ""
            given = _IS.match(page, at)
            if given:
                at = given.end()
                quote = page[at:at + 1]
                if quote and quote in "\"'":
                    end = page.find(quote, at + 1)
                    if end < 0:
                        self.at = len(page)
                        return None, True
                    value, at = page[at + 1:end], end + 1
                else:
                    plain = _PLAIN.match(page, at)
                    value, at = plain[0], plain.end()
            out.setdefault(key[0].lower(), html.unescape(value))

    def raw(self, tag: str) -> str:
        """Text up to the end tag of a raw element, which is passed over."""
        start = self.at
        end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.page, start)
        stop = end.start() if end else len(self.page)
        self.at = self._after(">", stop)
        return self.page[start:stop]


class Open:
    """The open elements, with the places of every name: no search walks over the stack."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, place: int) -> None:
        """Closes the elements from ``place`` on."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def last(self, names) -> int:
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def close(self, names: set[str], stop: set[str]) -> None:
        """Closes the outermost open element of ``names`` above the last boundary of ``stop``."""
        bound = self.last(stop)
        first = min((p[i] for n in names if (p := self.places.get(n)) and (i := bisect_right(p, bound)) < len(p)), default=0)
        if first:
            self.cut(first)

    def end(self, tag: str) -> None:
        """An end tag closes its element, but doesn't reach out of a cell unless it is a table's."""
        place = self.last((tag,))
        if place and (tag in TABLE_ENDS or place > self.last(CELL_BOUNDS)):
            self.cut(place)


CELL_BOUNDS = CELLS | {"table"}
TABLE_ENDS = CELLS | PARTS | {"table", "tr", "body", "html"}


def parse(page: str) -> Node:
    """Tree of a page; implied end tags are supplied."""
    root = Node("#root", {})
    tokens, opened = Tokens(page), Open(root)
    stack = opened.stack
    while (token := tokens.next(bool(stack[-1].foreign))) is not None:
        kind = token[0]
        if kind == "text":
            stack[-1].children.append(token[1])
        elif kind == "close":
            opened.end(token[1])
        elif kind == "open":
            _, tag, attrs, closed = token
            if tag in ENDS_P:
                opened.close({"p"}, {"table", "td", "th", "button"})
            if tag in CLOSES:
                opened.close(*CLOSES[tag])
            if tag in LEAVES and not (stack[-1].foreign == "math" and stack[-1].tag in MATH_TEXT):
                while stack[-1].foreign:
                    opened.cut(len(stack) - 1)
            node = Node(tag, attrs, _foreign(tag, stack[-1]))
            stack[-1].children.append(node)
            if tag in VOID or node.foreign and closed:
                continue
            if tag in RAW and not node.foreign:
                text = tokens.raw(tag)
                node.children.append(re.sub(r"^\r?\n", "", html.unescape(text)) if tag == "textarea" else text)
                continue
            opened.push(node)
    return root


def hidden(node: Node) -> bool:
    a = node.attrs
    return (node.tag in HIDDEN or "hidden" in a
            or bool(node.foreign) and (node.tag in UNSHOWN or a.get("display") == "none")
            or node.tag == "dialog" and "open" not in a
            or bool(_NONE.search(a.get("style", ""))) or node.tag == "input" and a.get("type", "").lower() == "hidden")


def sighted(node: Node, seen: bool) -> bool:
    """Whether the node's own content shows; visibility is inherited and can be set back inside."""
    own = _SIGHT.search(node.attrs.get("style", ""))
    word = own[1].lower() if own else node.attrs.get("visibility") if node.foreign else None
    return seen if word is None else word == "visible"


def _number(text: str | None, usual: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*-?\d{1,9}\s*", text) else usual


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


def _letters(n: int) -> str:
    out = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        out = chr(97 + k) + out
    return out


def item_mark(n: int, kind: str) -> str:
    """Number of a list item in the list's style; plain where the style has no such number."""
    made = _letters(n) if kind in "aA" and n > 0 else _roman(n) if kind in "iI" and 0 < n < 4000 else str(n)
    return (made.upper() if kind in "AI" else made) + ". "


class _List:
    """Number of the next item, step, style; None as style for bullets."""

    def __init__(self, node: Node):
        a = node.attrs
        self.kind = (a.get("type", "1") if a.get("type", "1") in ("1", "a", "A", "i", "I") else "1") if node.tag == "ol" else None
        self.step = -1 if "reversed" in a else 1
        items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if self.step < 0 else 1
        self.now = _number(a.get("start"), items)

    def mark(self, item: Node) -> str:
        if self.kind is None:
            return "* "
        self.now = _number(item.attrs.get("value"), self.now)
        n, self.now = self.now, self.now + self.step
        return item_mark(n, self.kind)


class _Lines:
    """Text that grows by words and breaks: collapses white space, keeps at most one empty line."""

    def __init__(self, level: int = 0):
        self.level = level    # tables around
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = False    # white space is due before the next word
        self.gap = 0          # line breaks due before the next word: 1 new line, 2 empty line
        self.indent = 0
        self.mark = ""

    def text(self, t: str, pre: bool) -> None:
        if pre:
            parts = t.replace("\r\n", "\n").split("\n")
            for i, p in enumerate(parts):
                if i:
                    self.flush(True)
                if p:
                    self.start()
                    self.now.append(p)
            return
        words = _BLANK.split(t)
        if len(words) == 1 and words[0]:
            self.word(words[0])
            return
        for i, w in enumerate(words):
            if i:
                self.blank = True
            if w:
                self.word(w)

    def word(self, w: str) -> None:
        self.start()
        if self.blank and self.now and self.now[-1].strip():
            self.now.append(" ")
        self.blank = False
        self.now.append(w)

    def start(self) -> None:
        """Before a word: breaks that are due, indent and list mark."""
        if self.gap:
            self.flush()
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
        if not self.now:
            pad = " " * min(self.indent, MAX_INDENT)
            if self.mark:
                pad = pad[:max(0, len(pad) - len(self.mark))] + self.mark
                self.mark = ""
            self.now.append(pad)
            self.blank = False

    def flush(self, even_empty: bool = False) -> None:
        line = "".join(self.now).rstrip()
        if line or even_empty:
            self.lines.append(line)
        self.now, self.blank = [], False

    def done(self) -> str:
        self.flush()
        return "\n".join(self.lines).strip("\n")


def shown_width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def grid(rows: list[list[tuple[int, int]]]) -> list[list[int]]:
    """First column of each cell of ``rows`` of (columns, rows) that cells span."""
    out, held = [], []      # held: (first, behind, last row) of cells from above, by column
    for r, row in enumerate(rows):
        held = [h for h in held if h[2] >= r]
        starts, at, k, new = [], 0, 0, []
        for columns, deep in row:
            while k < len(held) and held[k][0] <= at:
                at = max(at, held[k][1])
                k += 1
            starts.append(at)
            if deep > 1:
                new.append((at, at + columns, r + deep - 1))
            at += columns
        out.append(starts)
        held = sorted(held + new) if new else held
    return out


def _render_table(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Aligned columns of (text, columns, rows) cells; a cell of several lines takes several lines of its row."""
    starts = grid([[(c, d) for _, c, d in r] for r in rows])
    cut = [[text.split("\n") for text, _, _ in r] for r in rows]
    firsts = sorted({c for row in starts for c in row})
    place = {c: i for i, c in enumerate(firsts)}
    width = [0] * len(firsts)
    wide = []
    for r, row in enumerate(rows):
        for i, (_, columns, _) in enumerate(row):
            at, size = place[starts[r][i]], max(map(shown_width, cut[r][i]))
            behind = bisect_left(firsts, starts[r][i] + columns)
            if behind - at <= 1:
                width[at] = max(width[at], size)
            else:
                wide.append((at, behind, size))
    for at, behind, size in wide:       # what a spanning cell needs beyond its columns goes to the last of them
        width[behind - 1] += max(0, size - sum(width[at:behind]) - 2 * (behind - at - 1))
    left = [0]
    for w in width:
        left.append(left[-1] + w + 2)
    out = []
    for r, row in enumerate(cut):
        for k in range(max(len(c) for c in row) if row else 0):
            line, size = [], 0
            for i, c in enumerate(row):
                if k < len(c) and c[k]:
                    pad = max(left[place[starts[r][i]]] - size, 0)
                    line += [" " * pad, c[k]]
                    size += pad + shown_width(c[k])
            out.append("".join(line).rstrip())
    return out


def _options(node: Node) -> list:
    """What a select shows: the chosen option, or all options and group names of a list of several lines."""
    size = node.attrs.get("size", "")
    every = "multiple" in node.attrs or size.isdigit() and int(size) > 1
    shown: list = []
    chosen = first = None
    walk = [(c, False) for c in reversed(node.children)]
    while walk:
        n, off = walk.pop()
        if isinstance(n, str) or hidden(n):
            continue
        off = off or "disabled" in n.attrs
        if n.tag == "option":
            text = n.attrs.get("label")
            one = _wrap(text) if text else n
            shown.append(one)
            if "selected" in n.attrs:
                chosen = one
            if first is None and not off:
                first = one
        else:
            if n.tag == "optgroup" and n.attrs.get("label"):
                shown.append(_wrap(n.attrs["label"]))
            walk += [(c, off) for c in reversed(n.children)]
    if every:
        return shown
    one = chosen or first
    return [one] if one else []


def render(root: Node) -> str:
    """Visible text of a tree."""
    # Work items: (node or text or callable, lines, pre, list state, whether it shows)
    top = _Lines()
    todo: list = [("node", root, top, False, None, True)]
    while todo:
        item = todo.pop()
        if item[0] == "do":
            item[1]()
            continue
        _, node, out, pre, counter, seen = item
        if isinstance(node, str):
            if seen:
                out.text(node, pre)
            continue
        if hidden(node):
            continue
        tag, seen = node.tag, sighted(node, seen)
        if not seen and tag in ("img", "input", "select", "textarea", "br"):
            continue
        if tag == "br":
            out.start()
            out.flush(True)
            continue
        if tag == "table":
            _table(node, out, todo, seen)
            continue
        if tag == "img" and node.attrs.get("alt"):
            out.text(f" {node.attrs['alt']} ", False)
            continue
        if tag == "input":
            kind = node.attrs.get("type", "text").lower()
            name = {"submit": "Submit", "reset": "Reset"}.get(kind, "")
            if kind in FIELDS and (text := node.attrs.get("value", name) or node.attrs.get("placeholder")):
                out.text(f" {text} ", False)
            continue
        if tag == "select":
            shown = _options(node)
            for child in reversed(shown):
                if len(shown) > 1:
                    todo.append(("do", lambda out=out: setattr(out, "gap", max(out.gap, 1))))
                    todo.append(("node", child, out, False, None, seen))
                    todo.append(("do", lambda out=out: setattr(out, "gap", max(out.gap, 1))))
                else:
                    todo += [("node", " ", out, False, None, seen), *[("node", c, out, False, None, seen) for c in reversed(child.children)], ("node", " ", out, False, None, seen)]
            continue
        if tag == "textarea":
            text = "".join(node.children)
            if text.strip() or node.attrs.get("placeholder"):
                out.gap = max(out.gap, 1)
                out.text(text if text.strip() else node.attrs["placeholder"], True)
                out.gap = max(out.gap, 1)
            continue
        gap = 2 if tag in SPACED else 1 if tag in BLOCK or tag in CELLS or tag in ("tr", "caption") or node.foreign and tag in ("text", "mtr") else 0
        if tag in LISTS and counter is not None:
            gap = 1  # a list in a list
        deep = 2 if tag in LISTS or tag in ("blockquote", "dd") else 0
        inner = counter
        if tag in LISTS:
            inner = _List(node)
        out.gap = max(out.gap, gap)
        out.indent += deep
        if tag == "li" and counter is not None:
            out.mark = counter.mark(node) if seen else ""

        def leave(out=out, gap=gap, deep=deep, tag=tag):
            out.gap = max(out.gap, gap)
            out.indent -= deep
            if tag == "li":
                out.mark = ""

        todo.append(("do", leave))
        inside = [c for c in node.children if isinstance(c, Node)] if node.foreign == "svg" else node.children
        if tag == "details" and "open" not in node.attrs:
            inside = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
        for child in reversed(inside):
            todo.append(("node", child, out, pre or tag == "pre", inner, seen))
            if node.foreign == "math" and tag in MATH_PARTS:
                todo.append(("node", " ", out, False, None, seen))
    return top.done()


def _table(node: Node, out: _Lines, todo: list, seen: bool) -> None:
    """Renders the cells of a table on their own, then the aligned rows, heads first and feet last; other content
    stands before."""
    parts: dict[str, list[list[tuple[Node, _Lines]]]] = {"thead": [], "tbody": [], "tfoot": []}
    captions: list[Node] = []
    walk = [(node, "tbody")]
    while walk:
        n, part = walk.pop()
        for c in reversed(n.children):
            if isinstance(c, Node) and not hidden(c) and c.tag in PARTS | {"tr"}:
                walk.append((c, c.tag if c.tag in PARTS else part))
        if n.tag == "tr" or n is node:
            cells = [c for c in n.children if isinstance(c, Node) and c.tag in CELLS and not hidden(c)]
            if cells:
                parts[part].append([(c, _Lines(out.level + 1)) for c in cells])
        loose = [c for c in n.children if (c.strip() if isinstance(c, str) else c.tag not in PARTS | CELLS | {"tr", "col", "colgroup"})]
        captions += [c if isinstance(c, Node) else _wrap(c) for c in loose]
    rows = [*parts["thead"], *parts["tbody"], *parts["tfoot"]]

    def gap(least: int):
        return "do", lambda: setattr(out, "gap", max(out.gap, least))

    if out.level >= MAX_TABLES or max(map(len, rows), default=0) <= 1:
        todo.append(gap(2))
        for r in reversed(rows):
            for cell, _ in reversed(r):
                shows = sighted(cell, seen)
                todo += [gap(1), *[("node", child, out, False, None, shows) for child in reversed(cell.children)], gap(1)]
        todo.append(gap(2))
        todo += [("node", c, out, False, None, seen) for c in reversed(captions)]
        return

    def put():
        def spans(c: Node) -> tuple[int, int]:
            columns = min(max(_number(c.attrs.get("colspan"), 1), 1), 1000)      # the standard's bounds
            deep = _number(c.attrs.get("rowspan"), 1)
            return columns, len(rows) if deep == 0 else min(max(deep, 1), 65_534)

        text = _render_table([[(lines.done(), *spans(c)) for c, lines in r] for r in rows])
        out.gap = max(out.gap, 2)
        for line in text:
            out.start()
            out.now.append(line)
            out.flush(True)
        out.gap = max(out.gap, 2)

    todo.append(("do", put))
    for r in rows:
        for cell, lines in r:
            shows = sighted(cell, seen)
            for child in reversed(cell.children):
                todo.append(("node", child, lines, False, None, shows))
    for c in reversed(captions):
        todo.append(("node", c, out, False, None, seen))


def _wrap(text: str) -> Node:
    node = Node("div", {})
    node.children.append(text)
    return node


def extract(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text): all visible text of every page."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"))
    kind = src.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([extract(x) for x in part.column(1).to_pylist()], pa.string())],
                                                 names=["page_id", "text"])

    return src.mapInArrow(run, f"page_id {kind}, text string")
