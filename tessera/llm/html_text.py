"""Visible text of web pages, laid out as a reader sees it.

A tokenizer feeds a tree builder that knows void elements, raw-text elements and implied end tags; the tree is rendered by
visibility rules. Blocks start on their own line, blocks with margins are parted by an empty line, list items carry their
marker and depth, preformatted text keeps its spaces, and the cells of a table are aligned in columns.

Visibility: what is not displayed (by its element, ``hidden``, or ``display`` in its ``style`` attribute) goes with all that
it holds; ``visibility`` is inherited and may be set visible again further in. Rules of style sheets are not applied.

The text's length is linear in the page's: a cell is aligned by at most ``MAX_PAD`` spaces, and where its column starts further
right than that (a wide cell stands in an earlier column of other rows) it follows the cell before it; columns from
``MAX_COLUMNS`` on are not aligned.

Defined cases: a null page gives an empty text; unclosed and unmatched tags are repaired; ``<`` that starts no tag is text;
nesting deeper than ``MAX_DEPTH`` is flattened without losing text; repeated rows are rendered each; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

MAX_DEPTH = 200
MAX_PAD = 60
MAX_COLUMNS = 1000

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes audio video canvas object svg math datalist title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul xmp".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir fieldset xmp".split())
#: A start tag closes an open element of these names, up to the nearest of the scope.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("tr", "td", "th", "caption", "colgroup"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), "body": ("head",),
    "thead": ("tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), "tfoot": ("tbody", "thead", "tr", "td", "th", "caption", "colgroup"),
}
SCOPE = {
    "li": ("ul", "ol", "menu", "dir", "table", "td", "th"), "dt": ("dl", "table", "td"), "dd": ("dl", "table", "td"), "option": ("select", "datalist"),
    "optgroup": ("select",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "body": ("html",),
}
P_SCOPE = frozenset("button table td th caption object template html".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # comment
    r"|<[!?][^>]*(?:>|\Z)"  # doctype and the like
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDES = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        """An attribute's value, '' if it has none, None if it is missing."""
        if not self.attributes:
            return None
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None

    def hidden(self) -> bool:
        if self.tag in HIDDEN:
            return True
        if self.tag == "dialog" and self.get("open") is None:
            return True
        if not self.attributes:
            return False
        lower = self.attributes.lower()
        if "hidden" in lower and (self.get("hidden") is not None or self.tag == "input" and (self.get("type") or "").lower() == "hidden"):
            return True
        return "style" in lower and bool(_HIDES.search(self.get("style") or ""))

    def visibility(self) -> bool | None:
        """Whether its own style makes it visible; None if it inherits."""
        if "visibility" not in self.attributes.lower():
            return None
        found = _VISIBILITY.findall(self.get("style") or "")
        return found[-1].lower() == "visible" if found else None


def without_invisible(node: Node, visible: bool = True) -> Node | None:
    """The tree without the text whose inherited visibility is hidden. Of a hidden element without visible content its place
    between blocks is left, or None."""
    own = node.visibility()
    visible = visible if own is None else own
    out = Node(node.tag, node.attributes)
    for child in node.children:
        if isinstance(child, str):
            kept = child if visible else None
        else:
            kept = without_invisible(child, visible)
        if kept is not None:
            out.children.append(kept)
    if visible or out.children:
        return out
    return Node("p" if node.tag in SPACED else "div") if node.tag in BLOCK else None


def parse(html: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    stack = [root]
    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            stack[-1].children.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            _close(stack, tag)
            continue
        _imply(stack, tag)
        node = Node(tag, m[3].strip())
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            text = html[at : stop.start()] if stop else html[at:]
            node.children.append(unescape(text) if tag in ("textarea", "title") else text)
            at = stop.start() if stop else end
            if stop:
                at = (html.find(">", at) + 1) or end
        elif tag not in VOID and len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


def _close(stack: list[Node], tag: str) -> None:
    """An end tag closes up to its start tag; without one it is ignored. Cells and tables keep inner end tags inside."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html"):
            return


def _imply(stack: list[Node], tag: str) -> None:
    """Close the elements whose end a start tag implies."""
    if tag in BLOCK and tag not in ("option", "optgroup", "legend", "summary"):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag in P_SCOPE:
                break
    names = CLOSES.get(tag)
    if names:
        scope = SCOPE[tag]
        lowest = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                lowest = i
            elif stack[i].tag in scope:
                break
        if lowest is not None:
            del stack[lowest:]


class _Lines:
    """Lines of a layout, with white space collapsed as they grow."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False  # a collapsed space waits
        self.gap = False  # an empty line waits

    def text(self, text: str) -> None:
        words = _SPACE.split(text)
        if len(words) == 1:
            if words[0]:
                self._put(words[0])
            return
        if words[0]:
            self._put(words[0])
        middle = " ".join(w for w in words[1:-1] if w)
        self.space = True
        if middle:
            self._put(middle)
            self.space = True
        if words[-1]:
            self._put(words[-1])

    def _put(self, text: str) -> None:
        if self.space and self.now:
            self.now.append(" ")
        self.space = False
        self.now.append(text)

    def line(self, force: bool = False) -> None:
        """End the line if it has text, or in any case."""
        if self.now or force:
            self.raw("".join(self.now))
        self.now, self.space = [], False

    def block(self, margin: bool) -> None:
        self.line()
        self.gap = self.gap or margin

    def raw(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line.rstrip())


def _render(node: Node, out: _Lines) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
            continue
        tag = child.tag
        if child.hidden():
            continue
        if tag == "br":
            out.line(force=True)
        elif tag == "table":
            out.block(True)
            for line in _table(child):
                out.raw(line)
            out.gap = True
        elif tag in ("ul", "ol", "menu", "dir"):
            nested = node.tag == "li"
            out.block(not nested)
            _list(child, out)
            out.block(not nested)
        elif tag in ("pre", "xmp"):
            out.block(True)
            for line in _preformatted(child).strip("\n").split("\n"):
                out.raw(line)
            out.gap = True
        elif tag == "details" and child.get("open") is None:
            out.block(False)
            closed = Node("div")
            closed.children = [c for c in child.children if not isinstance(c, str) and c.tag == "summary"]
            _render(closed, out)
            out.block(False)
        elif tag == "blockquote" or tag == "dd":
            out.block(tag == "blockquote")
            for line in _inner(child):
                out.raw(f"  {line}")
            out.block(tag == "blockquote")
        elif tag in BLOCK:
            out.block(tag in SPACED)
            _render(child, out)
            out.block(tag in SPACED)
        elif tag == "input":
            if (child.get("type") or "text").lower() in ("submit", "button", "reset"):
                out.text(f" {child.get('value') or ''} ")
        elif tag in ("td", "th"):  # outside a table
            out.text(" ")
            _render(child, out)
            out.text(" ")
        else:
            _render(child, out)


def _inner(node: Node) -> list[str]:
    out = _Lines()
    _render(node, out)
    out.line()
    return out.lines


def _preformatted(node: Node) -> str:
    parts = []
    for child in node.children:
        if isinstance(child, str):
            parts.append(child)
        elif not child.hidden():
            parts.append("\n" if child.tag == "br" else _preformatted(child))
    return "".join(parts).replace("\r\n", "\n")


def _list(node: Node, out: _Lines) -> None:
    number = 1
    if node.tag == "ol":
        start = node.get("start") or "1"
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                out.text(child)
            continue
        if child.hidden():
            continue
        if child.tag != "li":
            holder = Node(node.tag)
            holder.children = [child]
            _render(holder, out)
            continue
        out.line()
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        lines = _inner(child) or [""]
        out.raw(mark + lines[0])
        for line in lines[1:]:
            out.raw(" " * len(mark) + line)


def _rows(node: Node) -> Iterator[tuple[str, Node]]:
    """Rows of a table, and whatever else lies between them (captions, stray content), in order."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                stray = Node("div")
                stray.children = [child]
                yield "other", stray
        elif child.hidden():
            continue
        elif child.tag in ("tbody", "thead", "tfoot"):
            yield from _rows(child)
        elif child.tag == "tr":
            yield "row", child
        elif child.tag != "colgroup":
            stray = Node("div")
            stray.children = [child]
            yield "other", stray


def _table(node: Node) -> list[str]:
    """Lines of a table: cells of a column start at the same place; a cell of several lines keeps them below each other."""
    grid: list[tuple[str, list]] = []
    widths: dict[int, int] = {}
    below: dict[int, int] = {}  # rows that a cell above still covers
    for kind, row in _rows(node):
        if kind == "other":
            grid.append(("lines", _inner(row)))
            continue
        cells, column = [], 0
        for child in row.children:
            if isinstance(child, str):
                if not child.strip():
                    continue
                cell = Node("td")
                cell.children = [child]
            else:
                cell = child
            if cell.hidden():
                continue
            while below.get(column, 0) > 0:
                column += 1
            lines = _inner(cell)
            across, down = (_span(cell.get(name)) for name in ("colspan", "rowspan"))
            cells.append((min(column, MAX_COLUMNS), lines))
            if across == 1 and column < MAX_COLUMNS:
                widths[column] = max(widths.get(column, 0), *map(len, lines or [""]))
            for c in range(column, min(column + across, MAX_COLUMNS)):
                below[c] = max(below.get(c, 0), down)
            column += across
        below = {c: n - 1 for c, n in below.items() if n > 1}
        grid.append(("cells", cells))
    starts, place = {}, 0
    for column in range(max([*widths, *(c for k, r in grid if k == "cells" for c, _ in r)], default=-1) + 1):
        starts[column] = place
        place += widths.get(column, 0) + 2
    out = []
    for kind, row in grid:
        if kind == "lines":
            out += row
            continue
        for i in range(max((len(lines) for _, lines in row), default=0)):
            line = ""
            for column, lines in row:
                if i < len(lines):
                    gap = starts[column] - len(line)
                    line += " " * gap if gap <= MAX_PAD and (gap > 0 or not line) else "  "
                    line += lines[i]
            out.append(line.rstrip())
    return out


def _span(value: str | None) -> int:
    return min(max(int(value), 1), 1000) if value and re.fullmatch(r"\s*\d{1,4}\s*", value) else 1


def visible_text(html: str | None) -> str:
    """The text of a page as laid out."""
    if not html:
        return ""
    tree = parse(html)
    if "visibility" in html.lower():
        tree = without_invisible(tree) or Node("#root")
    lines = _inner(tree)
    return "\n".join(lines).strip("\n")


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """page_id and text of every row."""
    short_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([visible_text(h) for h in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["page_id", "text"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{html_col}`").cast("string").alias("h"))
    return rows.mapInArrow(run, "page_id long, text string")
