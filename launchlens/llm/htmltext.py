"""HTML to text, laid out as a browser would show it.

A tag scanner feeds a tree builder that keeps the open elements and supplies the tags that HTML lets authors leave out.
What it opens and closes drives the layout: blocks start lines, some with a blank line around them, list items get
markers and indents, cells of a table are aligned in columns, preformatted text keeps its lines. Elements that are
never shown, or are hidden by attribute or style, and all below them show nothing. Nothing is recursive, so depth is not limited.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame

from launchlens.llm.common import map_texts

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)({_ATTRIBUTES}|[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACE = " \t\n\r\f"

# Fixed values of the HTML standard: element groups.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style template title noscript noembed noframes iframe object audio video canvas svg math datalist select".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption".split())
SPACED = set("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
             "hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SECTIONS = set("tbody thead tfoot".split())
#: A new element of the key closes an open one of the first group, unless one of the second stands between.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}), "dd": ({"dd", "dt"}, {"dl", "table", "td", "th"}),
    "dt": ({"dd", "dt"}, {"dl", "table", "td", "th"}), "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
}
#: Cells up to this width are padded to the width of their column.
ALIGN = 40


class _Flow:
    """Lines of one flow of content: the page, or a cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = self.space = False
        self.indents: list[str] = []
        self.marker = ""

    def words(self, text: str) -> None:
        pieces = text.split()
        if not pieces:
            self.space = self.space or (bool(text) and bool(self.parts))
            return
        if self.parts and (self.space or text[0] in _SPACE):
            self.parts.append(" ")
        self.parts.append(" ".join(pieces))
        self.space = text[-1] in _SPACE

    def exact(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self.parts.append(first)
        for line in rest:
            self.end_line(keep=True)
            self.parts.append(line)

    def end_line(self, keep: bool = False) -> None:
        line = "".join(self.parts)
        self.parts, self.space = [], False
        if not keep and not line.strip():
            return
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        indent = "".join(self.indents)
        if self.marker:
            indent = indent[:len(indent) - len(self.marker)] + self.marker if len(indent) >= len(self.marker) else self.marker
            self.marker = ""
        self.lines.append((indent + line).rstrip())

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.blank = self.blank or (spaced and bool(self.lines))


class _Table:
    def __init__(self):
        self.rows: list[list[tuple[str, int]]] = []

    def lines(self) -> list[str]:
        width: list[int] = []
        for row in self.rows:
            at = 0
            for text, span in row:
                width += [0] * (at + span - len(width))
                if span == 1 and len(text) <= ALIGN:
                    width[at] = max(width[at], len(text))
                at += span
        out = []
        for row in self.rows:
            at, line = 0, []
            for text, span in row:
                line.append(text.ljust(sum(width[at:at + span]) + 2 * (span - 1)))
                at += span
            out.append("  ".join(line).rstrip())
        return [x for x in out if x]


class _Element:
    __slots__ = ("hidden", "name", "number", "table")

    def __init__(self, name, hidden, table=None, number=0):
        self.name, self.hidden, self.table, self.number = name, hidden, table, number


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        out.setdefault(name.lower(), html.unescape(value))
    return out


def _number(value: str | None, default: int, most: int) -> int:
    return min(int(value), most) if value and value.isdecimal() and len(value) < 9 else default


class _Builder:
    def __init__(self):
        self.open: list[_Element] = []
        self.count: Counter = Counter()
        self.flows = [_Flow()]
        self.pre = 0

    @property
    def hidden(self) -> bool:
        return bool(self.open) and self.open[-1].hidden

    def text(self, data: str) -> None:
        if not data or self.hidden:
            return
        if "&" in data:
            data = html.unescape(data)
        if self.open and self.open[-1].name in ("table", "tr", *SECTIONS) and not data.strip():
            return
        flow = self.flows[-1]
        if self.pre:
            flow.exact(data)
        else:
            flow.words(data)

    def start(self, name: str, source: str) -> None:
        if name == "br":
            if not self.hidden:
                self.flows[-1].end_line(keep=bool(self.flows[-1].lines))
            return
        if name in ENDS_P and self.count["p"]:
            self.close({"p"}, {"table", "td", "th", "caption", "button"})
        if name in VOID:
            if name == "hr" and not self.hidden:
                self.flows[-1].block(True)
            return
        if name in HEADINGS and self.open and self.open[-1].name in HEADINGS:
            self.pop()
        if name in ("td", "th", "tr", *SECTIONS, "caption", "colgroup") and not self.count["table"]:
            return  # no table to belong to: the tag is dropped, its text is shown
        if name in ("tr", *SECTIONS):
            self.close({"td", "th"}, {"table"})
        if name in SECTIONS:
            self.close({"tr"}, {"table"})
        if rule := IMPLIED_END.get(name):
            self.close(*rule)
        if name in ("td", "th") and self.open[-1].name != "tr":
            self.start("tr", "")
        found = _attributes(source) if source and not source.isspace() else {}
        hidden = self.hidden or name in UNSEEN or "hidden" in found or ("style" in found and bool(_HIDING.search(found["style"])))
        element = _Element(name, hidden)
        self.open.append(element)
        self.count[name] += 1
        if hidden:
            return
        flow = self.flows[-1]
        if name in BLOCK:
            flow.block(name in SPACED and not (name in ("ul", "ol") and self.count["li"]))
        if name in ("ul", "ol", "menu", "dir"):
            element.number = _number(found.get("start"), 1, 10**8) if name == "ol" else 0
        elif name == "li":
            owner = next((e for e in reversed(self.open[:-1]) if e.name in ("ul", "ol", "menu", "dir")), None) if len(self.open) < 1000 else None
            flow.marker = "- "
            if owner and owner.name == "ol":
                flow.marker = f"{_number(found.get('value'), owner.number, 10**8)}. "
                owner.number = int(flow.marker[:-2]) + 1
            flow.indents.append(" " * len(flow.marker))
        elif name in ("blockquote", "dd"):
            flow.indents.append("  ")
        elif name == "pre":
            self.pre += 1
        elif name == "table":
            element.table = _Table()
        elif name == "tr":
            self.table().rows.append([])
        elif name in ("td", "th"):
            rows = self.table().rows
            if not rows:
                rows.append([])
            rows[-1].append(("", _number(found.get("colspan"), 1, 1000) or 1))
            self.flows.append(_Flow())

    def table(self) -> _Table:
        return next((e.table for e in reversed(self.open) if e.table), None) or _Table()

    def close(self, names: set[str], barriers: set[str]) -> None:
        """Close the innermost open element of names, with all inside it, if no barrier stands before it."""
        if not any(self.count[n] for n in names):
            return
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.open[depth].name
            if name in names:
                while len(self.open) > depth:
                    self.pop()
                return
            if name in barriers:
                return

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
        elif self.count[name]:
            barriers = {"table"} if name in ("tr", "td", "th", "caption", *SECTIONS) else set() if name in ("table", "body", "html") else {"td", "th", "caption"}
            self.close({name}, barriers - {name})
        elif name == "p" and not self.hidden:
            self.flows[-1].block(True)

    def pop(self) -> None:
        e = self.open.pop()
        self.count[e.name] -= 1
        if e.hidden:
            return
        if e.name in ("td", "th"):
            flow = self.flows.pop()
            flow.end_line()
            rows = self.table().rows
            if rows and rows[-1]:
                rows[-1][-1] = (" ".join(" ".join(flow.lines).split()), rows[-1][-1][1])
            return
        flow = self.flows[-1]
        if e.name == "pre":
            self.pre -= 1
        if e.name in BLOCK:
            flow.block(e.name in SPACED and not (e.name in ("ul", "ol") and self.count["li"]))
        if e.name == "li":
            if flow.marker:  # an empty item
                flow.marker = ""
            flow.indents and flow.indents.pop()
        elif e.name in ("blockquote", "dd"):
            flow.indents and flow.indents.pop()
        elif e.name == "table":
            for line in e.table.lines():
                flow.parts.append(line)
                flow.end_line()
            flow.block(True)

    def result(self) -> str:
        while self.open:
            self.pop()
        self.flows[0].end_line()
        lines = self.flows[0].lines
        while lines and not lines[-1]:
            lines.pop()
        return "\n".join(lines)


def to_text(page: str) -> str:
    """The visible text of a page."""
    builder, at, scan = _Builder(), 0, _TOKEN.search
    while m := scan(page, at):
        if m.start() > at:
            builder.text(page[at:m.start()])
        at = m.end()
        if m[2]:
            name = m[2].lower()
            builder.start(name, m[3])
            if name in RAW and not m[3].endswith("/"):
                stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                if name in ("textarea", "xmp"):
                    builder.text(page[at:stop.start() if stop else len(page)])
                at = stop.start() if stop else len(page)
        elif m[1]:
            builder.end(m[1].lower())
        elif m[0].startswith("<![CDATA["):
            builder.text(html.escape(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:]))
    builder.text(page[at:])
    return builder.result()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text, one row per row of pages; a null, empty or invisible page has empty text.

    Whole pages are read, broken markup is repaired as browsers do in the common cases, and a bare "<" stays text. Repeated
    rows are all rendered; other columns are not read."""
    def worker():
        return lambda pages: [[to_text(p) for p in pages]]

    return map_texts(pages, id_col, html_col, worker, "text string").withColumnRenamed("doc_id", "page_id")
