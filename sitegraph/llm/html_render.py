"""HTML extraction by layout-aware rendering.

A tokenizer in one forward pass, a tree builder that supplies implied tags (html, head and body; the ends of p, li, dt,
dd, option, tr, td, th and table sections; tbody and tr; text that can't stand in a table goes before it), visibility rules,
and a renderer that lays visible text out as a text browser would: blocks on lines of their own, blank lines round
paragraphs, headings, lists and tables, list marks and numbers with indents, aligned table cells, preformatted text as it is.

Not visible: head, script, style, template and the fallbacks of embedded media; elements with ``hidden``, an inline style or
a simple rule of a style sheet (tag, .class or #id) that says display:none or visibility:hidden; closed dialogs; closed
details but for their summary; hidden inputs. Since no script runs, noscript is visible. Nothing visible is cut: a column is
as wide as its longest cell line, however long and deep, and colspan and rowspan count up to their limits in the HTML
standard (1000 and 65534).

Elements may be nested to any depth: open elements are found by tag, and the renderer keeps a stack of its own. Cost is linear
in the page but for the blanks of the layout, which have bounds that no text is lost by: indents stop growing at INDENT columns,
and where the blanks of a table would be more than sixteen times its text and a million, its widest columns are aligned to
a lesser width and their longer cells stand as they are.

Edge cases: null and empty pages give an empty text. Pages are rendered one by one, so null and repeated ids are harmless. An
empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import pieces

RENDERED = "page_id long, text string, n_lines long, n_tables long, n_items long"
INDENT = 400
WIDEST, TALLEST = 1000, 65_534  # colspan and rowspan at most, by the standard

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
UNSEEN = frozenset("head script style template title iframe noembed noframes audio video canvas datalist object map".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td textarea tfoot th thead tr "
    "ul xmp caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre figure fieldset hr xmp".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section summary table ul li dd dt xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTION = frozenset(("tbody", "thead", "tfoot"))
#: For a start tag: open elements it ends, and those the search for them stops at.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"tbody", "thead", "tfoot", "table"}),
    **{s: ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}) for s in ("tbody", "thead", "tfoot", "caption", "colgroup")},
}
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th script style template form input".split())

# A quote opens a value only right after the equals sign; elsewhere it's part of a name or of an unquoted value.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>))|(?!\s*+=)))*+)>")
_ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?)?")
_COMMENT = re.compile(r"<!--(?:-?>|(?s:.*?)--!?>)")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_RULE = re.compile(r"([^{}]++)\{([^{}]*+)\}")
_GONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SIMPLE = re.compile(r"[.#]?[\w-]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): text, raw, open, close; comments and declarations are left out."""
    at, size = 0, len(html)
    low = None
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], ""
            return
        if lt > at:
            yield "text", html[at:lt], ""
        after = html[lt + 1 : lt + 2]
        if after == "!" or after == "?" or html.startswith("</", lt) and not html[lt + 2 : lt + 3].isalpha():
            if html.startswith("<!--", lt):
                m = _COMMENT.match(html, lt)
                at = m.end() if m else size
            else:
                at = html.find(">", lt + 2) + 1 or size
            continue
        if not (after.isascii() and after.isalpha() or after == "/"):
            yield "text", "<", ""
            at = lt + 1
            continue
        m = _TAG.match(html, lt)
        if not m:  # the end of the page lies within the tag
            return
        name = m[2].lower()
        at = m.end()
        yield ("close" if m[1] else "open"), name, m[3]
        if not m[1] and name in RAW:
            if low is None:
                low = html.lower() if len(html.lower()) == size else html
            end = at
            while True:
                end = low.find("</" + name, end)
                if end < 0 or not (low[end + 2 + len(name) : end + 3 + len(name)] or ">").isalnum():
                    break
                end += 2
            if end < 0 or name == "plaintext":
                end = size
            yield "raw", html[at:end], name
            at = end


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        found.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return found


def build(html: str) -> tuple[Node, list[str]]:
    """The tree of a page, and the texts of its style sheets."""
    root = Node("html", {})
    body = Node("body", {})
    head = Node("head", {})
    root.children = [head, body]
    stack, sheets = [root, body], []
    started = False
    places: dict[str, list[int]] = {}  # where on the stack the open elements of a tag are, from the second on

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(to: int) -> None:
        while len(stack) > to:
            places[stack.pop().tag].pop()

    def top(tags) -> int:
        return max((own[-1] for t in tags if (own := places.get(t))), default=-1)

    def within(names, stops) -> int:
        at = top(names)
        return at if at >= 0 and at >= top(stops) else -1

    def place(item) -> None:
        last = stack[-1]
        if last.tag in ("table", "tbody", "thead", "tfoot", "tr") and not (isinstance(item, Node) and item.tag in TABLE_PARTS and (item.tag != "input" or item.attrs.get("type", "").lower() == "hidden")):
            if (i := top(("table",))) > 0:
                up = stack[i - 1].children
                at = next((k for k in range(len(up) - 1, -1, -1) if up[k] is stack[i]), len(up))
                up.insert(at, item)
                return
        last.children.append(item)

    def implied(tag: str) -> None:
        node = Node(tag, {})
        stack[-1].children.append(node)
        push(node)

    for kind, name, rest in tokens(html):
        if kind == "text":
            if name.strip(" \t\n\r\f"):
                started = True
                place(unescape(name) if "&" in name else name)
            elif stack[-1].tag not in ("table", "tbody", "thead", "tfoot", "tr", "colgroup"):
                stack[-1].children.append(name)
        elif kind == "raw":
            node = stack[-1] if stack[-1].tag == rest else None
            if node is not None:
                cut(len(stack) - 1)
            if rest == "style":
                sheets.append(name)
            elif node is not None and rest in ("textarea", "xmp", "plaintext"):
                node.children.append(unescape(name) if rest == "textarea" else name)
        elif kind == "open":
            if name in ("html", "head", "body"):
                target = {"html": root, "head": head, "body": body}[name]
                for k, v in attributes(rest).items():
                    target.attrs.setdefault(k, v)
                continue
            if name not in IN_HEAD:
                started = True
            if name in CLOSES_P and (i := within({"p"}, {"table", "td", "th", "caption", "button", "object"})) > 0:
                cut(i)
            if name in HEADINGS and stack[-1].tag in HEADINGS:
                cut(len(stack) - 1)
            if name in ENDS:
                names, stops = ENDS[name]
                while (i := within(names, stops)) > 0:
                    cut(i)
            if name in ("td", "th") and stack[-1].tag in ("table", *SECTION):
                if stack[-1].tag == "table":
                    implied("tbody")
                implied("tr")
            elif name == "tr" and stack[-1].tag == "table":
                implied("tbody")
            node = Node(name, attributes(rest) if rest.strip() else {})
            if name in IN_HEAD and not started and name not in ("noscript", "template"):
                head.children.append(node)
                if name in RAW:
                    push(node)
                continue
            place(node)
            if name == "form" and stack[-1].tag in ("table", *SECTION, "tr"):  # closed at once: cells stay the row's
                continue
            if name not in VOID and not (rest.endswith("/") and name in ("path", "circle", "rect", "use", "g", "line")):
                push(node)
        elif name == "br":
            place(Node("br", {}))
        elif name == "p" and within({"p"}, {"table", "td", "th", "button"}) < 0:
            place(Node("p", {}))
        elif name not in ("html", "body", "head"):
            names = HEADINGS if name in HEADINGS else {name}
            stops = () if name in ("table",) else ("table",) if name in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption") else ("td", "th", "table")
            if (i := within(names, stops)) > 1:
                cut(i)
    return root, sheets


def hidden_rules(sheets: list[str]) -> frozenset[str]:
    """Simple selectors whose rules hide."""
    found = set()
    for sheet in sheets:
        for m in _RULE.finditer(re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)):
            if _GONE.search(m[2]):
                found.update(s.strip() for s in m[1].split(",") if _SIMPLE.fullmatch(s.strip()))
    return frozenset(found)


class Layout:
    """Text in the making: lines, the open line, blank lines owed."""

    def __init__(self, indent: str = "") -> None:
        self.lines: list[str] = []
        self.line, self.first, self.indent, self.owed, self.gap = "", "", indent, 0, False

    def text(self, value: str) -> None:
        parts = _SPACE.split(value)
        if parts[0] == "" and len(parts) > 1:
            self.gap = True
        words = [p for p in parts if p]
        if words:
            self._begin()
            if self.gap and self.line and not self.line.endswith(" "):
                self.line += " "
            self.line += " ".join(words)
            self.gap = parts[-1] == ""

    def _begin(self) -> None:
        if not self.line and self.first:
            self.line, self.first = self.first, ""
        elif not self.line:
            self.line = self.indent

    def verbatim(self, value: str) -> None:
        first = True
        for part in value.replace("\r\n", "\n").split("\n"):
            if not first:
                self.end(keep=True)
            first = False
            if part:
                self._begin()
                self.line += part

    def end(self, keep: bool = False) -> None:
        """End the open line; an empty one is kept only if asked."""
        if self.line.strip():
            if self.owed and self.lines:
                self.lines += [""] * self.owed
            self.owed = 0
            self.lines.append(self.line.rstrip())
        elif keep and self.lines and not self.owed:
            self.lines.append("")
        self.line, self.gap = "", False

    def space(self) -> None:
        self.end()
        self.owed = 1 if self.lines else 0

    def block(self, lines: list[str]) -> None:
        self.end()
        for line in lines:
            self.line = self.indent + line
            if line.strip():
                self.end()
            else:
                self.line = ""
                self.lines.append("")

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Renderer:
    def __init__(self, rules: frozenset[str]) -> None:
        self.rules, self.tables, self.items = rules, 0, 0

    def unseen(self, node: Node) -> bool:
        tag, attrs = node.tag, node.attrs
        if tag in UNSEEN or "hidden" in attrs and attrs["hidden"].lower() != "until-found":
            return True
        if "style" in attrs and _GONE.search(attrs["style"]):
            return True
        if tag == "dialog" and "open" not in attrs:
            return True
        if self.rules and (tag in self.rules or "id" in attrs and "#" + attrs["id"] in self.rules or any("." + c in self.rules for c in attrs.get("class", "").split())):
            return True
        return False

    def walk(self, node: Node, out: Layout) -> None:
        """Lays the element out; each open element is a generator that hands on its children."""
        open_ = [self._walk(node, out)]
        while open_:
            inner = next(open_[-1], None)
            if inner is None:
                open_.pop()
            else:
                open_.append(inner)

    def _walk(self, node: Node, out: Layout, pre: bool = False) -> Iterator:
        number = 0
        if node.tag == "ol":
            start = node.attrs.get("start", "")
            number = int(start) - 1 if re.fullmatch(r"-?\d{1,6}", start) else 0
        closed = node.tag == "details" and "open" not in node.attrs
        for child in node.children:
            if isinstance(child, str):
                if not closed:
                    (out.verbatim if pre else out.text)(child)
                continue
            tag = child.tag
            if self.unseen(child) or closed and tag != "summary":
                continue
            if tag == "br":
                out.end(keep=True)
            elif tag == "input":
                if child.attrs.get("type", "").lower() in ("submit", "button", "reset") and child.attrs.get("value"):
                    out.text(" " + child.attrs["value"] + " ")
            elif tag == "table":
                yield self._table(child, out)
            elif tag == "li":
                number += 1
                value = child.attrs.get("value", "")
                if re.fullmatch(r"-?\d{1,6}", value):
                    number = int(value)
                mark = f"{number}. " if node.tag == "ol" else "- "
                out.end()
                self.items += 1
                held, lines = out.indent, len(out.lines)
                out.first, out.indent = held + mark, (held + " " * len(mark))[:INDENT]
                yield self._walk(child, out, pre)
                out.end()
                out.indent = held
                if out.first and len(out.lines) == lines:  # an empty item still has its mark
                    out.line = out.first
                    out.end()
                out.first = ""
            elif tag in ("blockquote", "dd"):
                (out.space if tag == "blockquote" else out.end)()
                held = out.indent
                out.indent = (held + "    ")[:INDENT]
                yield self._walk(child, out, pre)
                out.end()
                out.indent = held
                if tag == "blockquote":
                    out.space()
            elif tag in BLOCK:
                nested = tag in ("ul", "ol", "menu", "dir") and out.indent.endswith("  ")
                spaced = tag in SPACED and not nested and not (out.first and not out.line)
                (out.space if spaced else out.end)()
                yield self._walk(child, out, pre or tag in ("pre", "textarea", "xmp", "plaintext"))
                (out.space if tag in SPACED and not nested else out.end)()
            else:
                yield self._walk(child, out, pre)

    def _table(self, node: Node, out: Layout) -> Iterator:
        self.tables += 1
        captions, rows = [], []

        def gather(part: Node) -> None:
            for child in part.children:
                if not isinstance(child, Node) or self.unseen(child):
                    continue
                if child.tag == "caption":
                    captions.append(child)
                elif child.tag == "tr":
                    rows.append([c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and not self.unseen(c)])
                elif child.tag in ("tbody", "thead", "tfoot", "form"):
                    gather(child)

        gather(node)
        grid: list[list[tuple[int, list[str]]]] = []
        held: dict[int, int] = {}  # columns taken by a cell of an earlier row, and for how many rows
        for cells in rows:
            line, column, taken = [], 0, {}
            for cell in cells:
                while held.get(column, 0) > 0:
                    column += 1
                inner = Layout()
                yield self._walk(cell, inner)
                wide, tall = _span(cell.attrs.get("colspan"), WIDEST), _span(cell.attrs.get("rowspan"), TALLEST)
                line.append((column, inner.done()))
                if tall > 1:
                    taken.update({column + i: tall for i in range(wide)})
                column += wide
            held = {c: n - 1 for c, n in {**held, **taken}.items() if n > 1}
            grid.append(line)
        columns = sorted({c for line in grid for c, _ in line})
        width = dict.fromkeys(columns, 0)
        for line in grid:
            for c, text in line:
                width[c] = max(width[c], max(map(len, text), default=0))
        tall = sum(max((len(t) for _, t in line), default=0) for line in grid)
        room = (1 << 20) + 16 * sum(len(x) for line in grid for _, t in line for x in t)
        wide = max(width.values(), default=0)
        while tall * sum(min(w, wide) for w in width.values()) > room and wide:
            wide //= 2
        lines = []
        for line in grid:
            tall = max((len(t) for _, t in line), default=0)
            cells = dict(line)
            last = max(cells, default=-1)
            for i in range(tall):
                parts = [(cells[c][i] if c in cells and i < len(cells[c]) else "").ljust(min(width[c], wide)) for c in columns if c <= last]
                lines.append("  ".join(parts).rstrip())
        out.space()
        for caption in captions:
            yield self._walk(caption, out)
            out.end()
        out.block([x for x in lines if x])
        out.space()


def _span(value: str | None, most: int) -> int:
    return max(1, min(most, int(value))) if value and re.fullmatch(r"\d{1,6}", value) else 1


def render(html: str | None) -> tuple[str, int, int]:
    """(visible text, tables, list items) of a page."""
    if not html:
        return "", 0, 0
    root, sheets = build(html)
    r, out = Renderer(hidden_rules(sheets)), Layout()
    if not r.unseen(root):
        r.walk(root, out)
    return "\n".join(out.done()), r.tables, r.items


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """RENDERED: the visible text of every page; one narrow pass."""
    names = [x.split()[0] for x in RENDERED.split(", ")]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                found = [render(x.as_py()) for x in batch.column(1)]
                text = [t for t, _, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(text, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in text], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64())],
                    names=names,
                )

    return pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(rows, RENDERED)
