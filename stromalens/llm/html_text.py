"""Visible text of HTML pages, laid out as a reader sees it.

A page is cut into tags and text, a tree is built with the tags that HTML leaves implied, and
the tree is rendered: hidden parts give nothing, blocks stand on lines of their own with blank
lines where margins would be, lists carry bullets or numbers, and table cells line up.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: Comments, declarations, tags (quoted attributes may hold ">"), or a stray "<".
_TOKENS = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]+|<", re.S)
_ATTRIBUTES = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; all but the last two are not shown.
RAW = frozenset("script style xmp noembed noframes iframe textarea title".split())
UNSEEN = frozenset("head script style title template noembed noframes iframe datalist object audio video canvas noscript desc metadata defs".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody thead tfoot tr ul xmp""".split())
#: Blocks that are set off by a blank line.
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir xmp".split())
LISTS = frozenset("ul ol menu dir".split())
#: An open element that a start tag ends, and the elements beyond which it does not look.
_ENDS = {
    "li": (frozenset(["li"]), LISTS), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])), "tbody": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])), "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])), "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
#: What a paragraph cannot hold, so that it ends there.
_ENDS_P = BLOCKS - frozenset("body html li dd dt td th tr tbody thead tfoot caption legend option optgroup summary figcaption".split()) | frozenset(["li", "dd", "dt"])
#: Elements that a paragraph, or a closing tag, does not reach out of.
_WALLS = frozenset("table td th caption html object template button".split())
#: Open elements beyond which further ones hold nothing (their content goes on beside them), and
#: nesting beyond which elements are laid out as if they were inline. No text is lost.
MAX_OPEN, MAX_DEPTH = 512, 80
_IN_HEAD = frozenset("base link meta noscript script style template title".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "hidden")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.hidden = tag in UNSEEN or bool(attrs) and _hides(tag, attrs)


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTES.findall(source):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def _hides(tag: str, source: str) -> bool:
    low = source.lower()
    if "hidden" not in low and "none" not in low and "collapse" not in low and tag not in ("dialog", "details"):
        return False
    a = attributes(source)
    return "hidden" in a or tag == "input" and a.get("type", "").lower() == "hidden" or bool(_HIDING.search(a.get("style", "")))


def parse(source: str) -> Node:
    """The tree of a page, with implied ends and table rows."""
    root = Node("html")
    stack = [root]
    at = 0
    while at < len(source):
        m = _TOKENS.match(source, at)
        at = m.end()
        name = m.group(2)
        if name is None:
            text = m.group()
            if text[:2] in ("<!", "<?") and len(text) > 2:
                continue
            if stack[-1].tag == "head" and not text.isspace():
                stack.pop()
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
            continue
        tag = name.lower()
        if m.group(1):
            _close(stack, tag)
            continue
        if tag in ("html", "body"):
            if tag == "body" and any(n.tag == "head" for n in stack):
                _close(stack, "head")
            node = Node(tag, m.group(3))
            if node.hidden:
                stack[0].hidden = True
            continue
        if stack[-1].tag == "head" and tag not in _IN_HEAD:
            stack.pop()
        _imply(stack, tag)
        node = Node(tag, m.group(3))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(source, m.end())
            content = source[m.end():end.start() if end else len(source)]
            at = end.end() if end else len(source)  # a token may start inside and end beyond
            node.children.append(html.unescape(content) if tag in ("textarea", "title") else content)
        elif tag not in VOID and len(stack) < MAX_OPEN:
            stack.append(node)
    return root


def _imply(stack: list[Node], tag: str) -> None:
    if tag in _ENDS_P:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag in _WALLS:
                break
    if tag in _ENDS:
        ends, walls = _ENDS[tag]
        cut = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in walls:
                break
            if stack[i].tag in ends:
                cut = i
        if cut is not None:
            del stack[cut:]
    top = stack[-1].tag
    if tag in ("td", "th") and top in ("table", "thead", "tbody", "tfoot"):
        row = Node("tr")
        stack[-1].children.append(row)
        stack.append(row)


def _close(stack: list[Node], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in _WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
            return
    if tag in ("p", "br"):
        stack[-1].children.append(Node(tag))


class _Page:
    """Lines being written; ``blank`` if a blank line is due before the next one."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank, self.space = False, False

    def text(self, s: str) -> None:
        squeezed = _SPACES.sub(" ", s)
        if squeezed == " " or not squeezed:
            self.space = self.space or bool(squeezed) and bool(self.line)
            return
        if self.line and (self.space or squeezed[0] == " "):
            self.line.append(" ")
        self.line.append(squeezed.strip(" "))
        self.space = squeezed[-1] == " "

    def end_line(self, always: bool = False) -> None:
        if self.line or always:
            self._put("".join(self.line))
        self.line, self.space = [], False

    def _put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append(line)

    def block(self, lines: list[str]) -> None:
        self.end_line()
        for line in lines:
            self._put(line)

    def gap(self) -> None:
        self.end_line()
        self.blank = True


def width(s: str) -> int:
    """Columns that a string takes up: two for wide characters, none for combining ones."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _lines(children: list, depth: int = 0) -> list[str]:
    page = _Page()
    _render(children, page, depth)
    page.end_line()
    return page.lines


def _render(children: list, page: _Page, depth: int = 0) -> None:
    for child in children:
        if isinstance(child, str):
            page.text(child)
            continue
        tag = child.tag
        if child.hidden:
            continue
        if tag == "br":
            page.end_line(always=True)
        elif tag == "hr":
            page.gap()
        elif tag == "img":
            alt = attributes(child.attrs).get("alt", "") if "alt" in child.attrs.lower() else ""
            page.text(alt)
        elif tag == "input":
            kind = attributes(child.attrs)
            if kind.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url"):
                page.text(kind.get("value", ""))
        elif depth > MAX_DEPTH:
            _flat(child, page)
        elif tag in ("pre", "textarea", "xmp"):
            page.gap()
            page.block(_verbatim(child).strip("\n").split("\n"))
            page.gap()
        elif tag in LISTS:
            _list(child, page, depth)
        elif tag == "table":
            page.gap()
            page.block(_table(child, depth))
            page.gap()
        elif tag == "dd":
            page.end_line()
            page.block(["    " + x if x else x for x in _lines(child.children, depth + 1)])
        elif tag == "blockquote":
            page.gap()
            page.block(["> " + x if x else ">" for x in _lines(child.children, depth + 1)])
            page.gap()
        elif tag == "q":
            page.line.append(" " if page.space and page.line else "")
            page.line.append("“")
            page.space = False
            _render(child.children, page, depth + 1)
            page.line.append("”")
        elif tag in SPACED:
            page.gap()
            _render(child.children, page, depth + 1)
            page.gap()
        elif tag in BLOCKS:
            page.end_line()
            _render(child.children, page, depth + 1)
            page.end_line()
        elif tag in ("td", "th"):  # a cell outside a table
            page.text(" ")
            _render(child.children, page, depth + 1)
            page.text(" ")
        else:
            _render(child.children, page, depth + 1)


def _flat(node: Node, page: _Page) -> None:
    todo = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            page.text(x)
        elif not x.hidden:
            if x.tag in BLOCKS or x.tag == "br":
                page.text(" ")
            todo.extend(reversed(x.children))


def _verbatim(node: Node) -> str:
    out, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.hidden:
            if x.tag == "br":
                out.append("\n")
            todo.extend(reversed(x.children))
    return "".join(out).replace("\r\n", "\n").replace("\r", "\n")


def _list(node: Node, page: _Page, depth: int) -> None:
    outer = depth == 0 or not getattr(page, "in_item", False)
    if outer:
        page.gap()
    else:
        page.end_line()
    number = 1
    if node.tag == "ol":
        start = attributes(node.attrs).get("start", "1") if node.attrs else "1"
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            _render([child], page, depth + 1)
            continue
        if child.hidden:
            continue
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        inner = _Page()
        inner.in_item = True
        _render(child.children, inner, depth + 1)
        inner.end_line()
        lines = inner.lines or [""]
        page.block([(mark if i == 0 else " " * len(mark)) + x if x or i == 0 else x for i, x in enumerate(lines)])
    if outer:
        page.gap()


def _rows(node: Node) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node) and not child.hidden:
            if child.tag == "tr":
                yield child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child)


def _beside_rows(node: Node) -> Iterator[str | Node]:
    """What a table or a group of rows holds besides rows."""
    for child in node.children:
        if isinstance(child, str) or child.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup", "col"):
            yield child
        elif child.tag not in ("tr", "col") and not child.hidden:
            yield from _beside_rows(child)


def _span(node: Node, name: str) -> int:
    if name not in node.attrs.lower():
        return 1
    value = attributes(node.attrs).get(name, "1")
    return min(int(value), 100) if re.fullmatch(r"\d{1,6}", value) and int(value) else 1


def _table(node: Node, depth: int) -> list[str]:
    out: list[str] = []
    for child in _beside_rows(node):
        if isinstance(child, str):
            if not child.isspace():
                out.append(_SPACES.sub(" ", child).strip())
        elif child.tag == "caption" and not child.hidden:
            out += _lines(child.children, depth + 1)
        elif not child.hidden:
            out += _lines([child], depth + 1)
    grid: list[dict[int, list[str]]] = []
    taken: dict[int, int] = {}  # columns that a cell above still covers, and for how many rows
    wide: list[tuple[int, int, int, list[str]]] = []
    for r, row in enumerate(_rows(node)):
        cells: dict[int, list[str]] = {}
        c = 0
        for cell in row.children:
            if isinstance(cell, str) and cell.isspace() or isinstance(cell, Node) and cell.hidden:
                continue
            while taken.get(c, 0) > 0:
                c += 1
            lines = _lines(cell.children, depth + 1) if isinstance(cell, Node) and cell.tag in ("td", "th") else _lines([cell], depth + 1)
            lines = [x for x in lines if x]
            across, down = (_span(cell, "colspan"), _span(cell, "rowspan")) if isinstance(cell, Node) else (1, 1)
            cells[c] = lines
            if across > 1:
                wide.append((r, c, across, lines))
            for k in range(c, c + across):
                if down > 1:
                    taken[k] = down
            c += across
        taken = {k: v - 1 for k, v in taken.items() if v > 1}
        grid.append(cells)
    spread = {(r, c) for r, c, _, _ in wide}
    columns = max((max(row, default=-1) for row in grid), default=-1) + 1
    size = [0] * columns
    for r, row in enumerate(grid):
        for c, lines in row.items():
            if (r, c) not in spread:
                size[c] = max([size[c], *map(width, lines)])
    for r, row in enumerate(grid):
        for k in range(max((len(x) for x in row.values()), default=0)):
            line, at = "", 0
            for c in range(columns):
                lines = row.get(c, [])
                piece = lines[k] if k < len(lines) else ""
                if piece:
                    line += " " * max(at - width(line), 1 if line and not line.endswith(" ") else 0) + piece
                at += size[c] + 2 if size[c] else 0
            if line:
                out.append(line)
    return out


def visible_text(source: str) -> str:
    """What a page shows, as lines; an empty page gives an empty text."""
    root = parse(source)
    if root.hidden:
        return ""
    return "\n".join(x.rstrip() for x in _lines(root.children)).strip("\n")


def extract(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """key and text (the visible text) of every row; a null page gives an empty text.

    Repeated rows give rows each; other columns are not read.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "source"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([visible_text(x or "") for x in part.column(1).to_pylist()], pa.string())], [key, "text"])

    picked = pages.select(F.col(key).alias("key"), F.col(source).alias("source"))
    return picked.mapInArrow(rows, f"`{key}` {picked.schema['key'].dataType.simpleString()}, text string")
