"""HTML extraction by layout: all visible text, laid out as blocks, lists and tables.

A page is read into a tree, with the end tags that HTML lets authors leave out
(``p``, ``li``, ``dt``, ``dd``, ``tr``, ``td`` …) put in; subtrees that a browser
does not show are left out; the rest is laid out:

* blocks stand on lines of their own; paragraphs, headings, lists, tables, quotes
  and preformatted text have an empty line around them,
* runs of blanks collapse except inside ``pre`` and ``textarea``; ``br`` breaks the line,
* list items start with ``- `` or their number and are indented by depth,
* cells of a table are aligned in columns two spaces apart, a cell of several
  lines takes several lines of its row, and a ``colspan`` covers its columns.

Nothing is recursive, so any nesting depth of any page is read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of the HTML standard, in groups by their treatment here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style title template noscript iframe noembed noframes object audio video canvas datalist select area base "
    "link meta param source track input".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre figure listing xmp fieldset".split())
BLOCK = SPACED | frozenset(
    "html body div article section nav header footer main aside address form hgroup li dt dd details summary dialog center "
    "figcaption legend caption hr optgroup option search".split()
)
CLOSES_P = (BLOCK - frozenset("html body li dt dd caption legend optgroup option".split())) | frozenset({"plaintext"})
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
#: What an opening tag closes first: (tags to close, elements beyond which not to look).
IMPLIED = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset({"dl"})),
    "dd": (frozenset("dt dd".split()), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset("select datalist".split())),
    "td": (CELLS, frozenset("tr table".split())),
    "th": (CELLS, frozenset("tr table".split())),
    "tr": (frozenset({"tr", "caption", "colgroup"}), frozenset("thead tbody tfoot table".split())),
    "thead": (SECTIONS | {"caption", "colgroup"}, frozenset({"table"})),
    "tbody": (SECTIONS | {"caption", "colgroup"}, frozenset({"table"})),
    "tfoot": (SECTIONS | {"caption", "colgroup"}, frozenset({"table"})),
}
_ENDS_AT_CELL = frozenset("td th caption table".split())
#: In these a table stands inside the open one; anywhere else in a table it ends it.
_HOLDS_TABLE = frozenset("td th caption template noscript".split())

# As in HTML a quote opens a value only right after "="; one that is never closed is a character like any other, so no text is lost.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?>[\s/]++|[^\s/>][^\s/>=]*+(?>\s*+=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(text: str) -> dict[str, str]:
    found = {}
    if text and not text.isspace():
        for name, double, single, bare in _ATTRIBUTE.findall(text):
            found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


class TreeBuilder:
    """Open elements and the rules that close them."""

    def __init__(self):
        self.root = Node("", {})
        self.open = [self.root]

    def _close(self, tags: frozenset, beyond: frozenset) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at].tag
            if tag in tags:
                del self.open[at:]
                return
            if tag in beyond:
                return

    def text(self, text: str) -> None:
        self.open[-1].children.append(text)

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.open[:3]):
            return
        if tag in CLOSES_P:
            self._close(frozenset({"p"}), _ENDS_AT_CELL | {"button"})
        if tag == "table":
            self._close(frozenset({"table"}), _HOLDS_TABLE)
        if tag in IMPLIED:
            tags, beyond = IMPLIED[tag]
            if tag in ("tr", *SECTIONS):
                self._close(CELLS, frozenset({"table"}))
            if tag in SECTIONS:
                self._close(frozenset({"tr"}), frozenset({"table"}))
            self._close(tags, beyond)
            if tag in CELLS and self.open[-1].tag in SECTIONS | {"table"}:
                self._push("tr", {})
        self._push(tag, attributes)
        if tag in VOID:
            self.open.pop()

    def _push(self, tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes)
        self.open[-1].children.append(node)
        self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif tag not in VOID:
            beyond = frozenset({"table"}) if tag in CELLS | SECTIONS | {"tr", "caption"} else frozenset() if tag == "table" else _ENDS_AT_CELL - {tag}
            self._close(frozenset({tag}), beyond)


def tree(page: str | None) -> Node:
    """The tree of a page; its root has an empty tag."""
    page = page or ""
    built, at = TreeBuilder(), 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        if not found:
            built.text(html.unescape(page[at:]))
            break
        if found.start() > at:
            built.text(html.unescape(page[at : found.start()]))
        at = found.end()
        closing, tag, rest = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            built.end(tag)
            continue
        built.start(tag, _attributes(rest))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            inside = page[at : end.start()] if end else page[at:]
            built.text(html.unescape(inside) if tag in ("textarea", "title") else inside)
            at = end.end() if end else len(page)
            built.end(tag)
    return built.root


def is_seen(node: Node) -> bool:
    """Whether a browser shows the element (rules that need no style sheet)."""
    if node.tag in UNSEEN or "hidden" in node.attributes:
        return False
    if node.tag == "dialog" and "open" not in node.attributes:
        return False
    return not _HIDING.search(node.attributes.get("style", ""))


class _Lines:
    """Lines of one flow of text: the page, or a cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank_before = self.space = False
        self.prefix = ""  # marker of a list item whose first line has not begun
        self.indents: list[str] = []

    def word_space(self) -> None:
        if self.now:
            self.space = True

    def write(self, text: str) -> None:
        if not text:
            return
        if not self.now:
            if self.blank_before and self.lines:
                self.lines.append("")
            self.blank_before = False
            self.now.append((self.prefix or "".join(self.indents)))
            self.prefix = ""
        elif self.space:
            self.now.append(" ")
        self.space = False
        self.now.append(text)

    def end_line(self, spaced: bool = False) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now, self.space = [], False
        self.blank_before |= spaced

    def add_block(self, lines: list[str]) -> None:
        self.end_line(True)
        for line in lines:
            if line:
                self.write(line)
                self.end_line()
            else:
                self.lines.append("")
        self.end_line(True)


def _aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Lines of a table from rows of (lines, colspan) cells."""
    widths: list[int] = []
    for row in rows:
        at = 0
        for lines, span in row:
            widths += [0] * (at + span - len(widths))
            if span == 1:
                widths[at] = max(widths[at], max(map(len, lines), default=0))
            at += span
    for row in rows:
        at = 0
        for lines, span in row:
            missing = max(map(len, lines), default=0) - sum(widths[at : at + span]) - 2 * (span - 1)
            if span > 1 and missing > 0:
                widths[at + span - 1] += missing
            at += span
    out = []
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            at, cells = 0, []
            for lines, span in row:
                cells.append((lines[k] if k < len(lines) else "").ljust(sum(widths[at : at + span]) + 2 * (span - 1)))
                at += span
            line = "  ".join(cells).rstrip()
            if line:
                out.append(line)
    return out


def _span(node: Node) -> int:
    value = node.attributes.get("colspan", "1").strip()
    return min(max(int(value), 1), 1000) if value.isascii() and value.isdigit() else 1


def render(root: Node) -> str:
    """The visible text of a tree. A stack of steps stands for recursion."""
    flow = _Lines()
    flows: list[_Lines] = []
    tables: list[list[list[tuple[list[str], int]]]] = []
    lists: list[list] = []  # [kind, next number]
    keeps = 0  # open elements that keep blanks
    stack: list[tuple[str, object]] = [("open", root)]
    while stack:
        step, node = stack.pop()
        if step == "close":
            tag = node.tag
            if tag in ("pre", "listing", "xmp", "textarea"):
                keeps -= 1
            if tag == "table":
                rows = tables.pop()
                flow = flows.pop()
                _outer(flow, flows).add_block(_aligned(rows))
            elif tag in CELLS and tables:
                flow.end_line()
                tables[-1][-1].append((flow.lines, _span(node)))
                flow = flows.pop()
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                flow.end_line(not lists)
            elif tag == "li":
                if flow.prefix:
                    flow.prefix = ""
                flow.end_line()
                flow.indents.pop()
            elif tag in ("dd", "blockquote"):
                flow.end_line(tag == "blockquote")
                flow.indents.pop()
            elif tag in BLOCK:
                flow.end_line(tag in SPACED)
            continue
        if isinstance(node, str):
            target = _outer(flow, flows)  # text in a table but in no cell goes before the table
            if keeps:
                first, *more = node.split("\n")
                target.write(first)
                for line in more:
                    if not target.now:
                        target.lines.append("")
                    target.end_line()
                    target.write(line)
                continue
            if node[:1] in " \t\n\r\f":
                target.word_space()
            for word in _BLANKS.split(node.strip(" \t\n\r\f")):
                target.write(word)
                target.word_space()
            if node[-1:] not in " \t\n\r\f":
                target.space = False
            continue
        if node.tag and not is_seen(node):
            continue
        tag = node.tag
        if tag == "br":
            if not flow.now and flow.lines and not flow.blank_before:
                flow.blank_before = True
            flow.end_line()
            continue
        if tag in VOID:
            if tag == "hr":
                flow.end_line(True)
            continue
        if tag == "table":
            flow.end_line(True)
            flows.append(flow)
            flow = _TABLE
            tables.append([])
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in CELLS and tables:
            if not tables[-1]:
                tables[-1].append([])
            flows.append(flow)
            flow = _Lines()
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.end_line(not lists)
            start = node.attributes.get("start", "1").strip()
            lists.append([tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
        elif tag == "li":
            flow.end_line()
            if lists and lists[-1][0] == "ol":
                marker = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            else:
                marker = "- "
            flow.prefix = "".join(flow.indents) + marker
            flow.indents.append(" " * len(marker))
        elif tag in ("dd", "blockquote"):
            flow.end_line(tag == "blockquote")
            flow.indents.append("  ")
        elif tag in BLOCK:
            flow.end_line(tag in SPACED)
        if tag in ("pre", "listing", "xmp", "textarea"):
            keeps += 1
            if node.children and isinstance(node.children[0], str):
                node.children[0] = node.children[0].removeprefix("\n")
        children = node.children
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        stack.append(("close", node))
        stack.extend(("open", c) for c in reversed(children))
    flow.end_line()
    lines = flow.lines
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


class _Outside(_Lines):
    """The flow between the cells of a table: writes nothing by itself."""

    def write(self, text: str) -> None:
        pass

    def end_line(self, spaced: bool = False) -> None:
        pass


_TABLE = _Outside()


def _outer(flow: _Lines, flows: list[_Lines]) -> _Lines:
    """The flow itself, or the nearest one around it that is not between cells."""
    return flow if flow is not _TABLE else next(f for f in reversed(flows) if f is not _TABLE)


def visible_text(page: str | None) -> str:
    return render(tree(page))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the HTML column and with ``text``, its visible text.

    Null and empty pages give an empty text. All other columns pass through; a
    column ``text`` of the input is replaced. One pass, no shuffle.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(p.as_py()) for p in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, "text"])

    schema = pages.select(*kept).withColumn("text", F.lit("")).schema
    return pages.select(*kept, html_col).mapInArrow(apply, schema)
