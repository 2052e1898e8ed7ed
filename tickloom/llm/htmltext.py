"""Visible text of web pages: tree with implied tags, visibility rules, layout-aware rendering."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import table
from tickloom.llm.registry import query

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("head script style template noscript title datalist iframe object audio video canvas noframes".split())
WIDE_BREAK = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
BLOCK = WIDE_BREAK | frozenset("address article aside body caption center dd details dialog div dt fieldset figcaption footer form header hgroup hr html legend li main menu nav option section search summary".split())
ENDS_P = BLOCK - frozenset("caption legend option body html".split())
#: A start tag of the first kind ends open elements of the second, up to one of the third.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "body": ({"head"}, set()),
}
#: What may stand in a head; any other start tag, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta title noscript noframes style script template".split())
FOREIGN = frozenset(("svg", "math"))
#: Elements of svg and math whose content is HTML again.
HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: HTML tags that end an svg or math around them.
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Parts of svg and math that are not drawn, or only where something refers to them.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split())
#: Elements of svg in which text is drawn; elsewhere in svg text is not.
SVG_TEXT = frozenset("text foreignobject".split())
MAX_DEPTH = 300  # deeper elements become siblings at that depth; no text is lost
SPACES = re.compile(r"[ \t\n\r\f]+")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children", "foreign")

    def __init__(self, tag: str, attrs: dict | None = None, foreign: bool = False):
        self.tag, self.attrs, self.children, self.foreign = tag, attrs or {}, [], foreign


#: Marked sections that the parser reads to their own end; any other is a comment up to the next >.
_SECTION = re.compile(r"<!\[(?:temp|cdata|ignore|include|rcdata|if|else|endif)(?![-_.a-z0-9])", re.I)


class TreeBuilder(HTMLParser):
    """Builds a tree of Nodes and strings; end tags without a start are passed over, open elements end with the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]

    def _close_through(self, tags: set, border: set) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in border:
                return
            if self.open[i].tag in tags:
                del self.open[i:]
                return self._close_through(tags, border)

    def _in_foreign(self) -> bool:
        top = self.open[-1]
        return top.foreign and top.tag not in HTML_INSIDE

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html" or (tag == "head" and len(self.open) > 1):
            return
        if self._in_foreign() and tag in ENDS_FOREIGN:
            while self._in_foreign():
                self.open.pop()
        if self._in_foreign() or tag in FOREIGN:
            if self.open[-1].tag == "head":
                self.open.pop()
            self._add(Node(tag, dict(attrs), True))
            return
        if tag in ENDS_P:
            self._close_through({"p"}, {"table", "td", "th", "button", "caption"})
        if tag not in IN_HEAD and self.open[-1].tag == "head":
            self.open.pop()
        if tag in IMPLIED_END:
            self._close_through(*IMPLIED_END[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._add(Node("tr"))
        node = Node(tag, dict(attrs))
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self._add(node)

    def _add(self, node: Node) -> None:
        if len(self.open) > MAX_DEPTH:
            self.open.pop()
        self.open[-1].children.append(node)
        self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.open[-1].foreign and self.open[-1].tag == tag:
            self.open.pop()  # the slash means nothing in HTML, but ends an element of svg or math

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.open[-1].children.append(Node("p"))
        if tag == "br":
            self.open[-1].children.append(Node("br"))
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip(" \t\n\r\f"):
            self.open.pop()
        self.open[-1].children.append(data)

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![", i) and not _SECTION.match(self.rawdata, i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA[") and self._in_foreign():
            self.handle_data(data[6:])


class Lines:
    """Collects text with collapsed white space and breaks; between blocks the widest wanted break holds."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line: list[str] = []
        self.wanted = 0
        self.space = False

    def text(self, s: str) -> None:
        s = SPACES.sub(" ", s)
        if s.startswith(" "):
            self.space = True
            s = s[1:]
        if not s:
            return
        self._flush()
        if self.space and self.line:
            self.line.append(" ")
        self.space = s.endswith(" ")
        self.line.append(s[:-1] if self.space else s)

    def kept(self, s: str) -> None:
        """Text whose white space counts."""
        self._flush()
        if self.space and self.line:
            self.line.append(" ")
        self.space = False
        first, *rest = s.split("\n")
        self.line.append(first)
        for x in rest:
            self.done.append("".join(self.line))
            self.line = [x]

    def newline(self) -> None:
        self._flush()
        self.done.append("".join(self.line))
        self.line, self.space = [], False

    def want(self, breaks: int) -> None:
        self.wanted, self.space = max(self.wanted, breaks), False

    def block(self, lines: list[str]) -> None:
        self.want(1)
        self._flush()
        self.done += lines
        self.want(1)

    def _flush(self) -> None:
        if self.wanted:
            if self.line:
                self.done.append("".join(self.line))
                self.line = []
            if self.wanted > 1 and self.done and self.done[-1]:
                self.done.append("")
            self.wanted = 0

    def finish(self) -> list[str]:
        if self.line:
            self.done.append("".join(self.line))
            self.line = []
        out = [x.rstrip() for x in self.done]
        while out and not out[0]:
            out.pop(0)
        while out and not out[-1]:
            out.pop()
        return out


def _shown(node: Node, seen: bool) -> tuple[bool, bool]:
    """Whether the element is laid out, and whether its own text is visible."""
    a = node.attrs
    if node.tag in UNSEEN or (node.foreign and node.tag in UNDRAWN) or "hidden" in a or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and (a.get("type") or "").lower() == "hidden"):
        return False, seen
    style = a.get("style") or ""
    if NO_DISPLAY.search(style):
        return False, seen
    rule = VISIBILITY.findall(style)
    if node.foreign:  # attributes of svg stand for style rules
        if (a.get("display") or "").strip().lower() == "none":
            return False, seen
        rule = rule or ([a["visibility"].strip()] if a.get("visibility") else [])
    return True, (rule[-1].lower() not in ("hidden", "collapse") if rule else seen)


def _width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _number(value: str | None, other: int) -> int:
    return int(value) if value and re.fullmatch(r"-?\d{1,9}", value.strip()) else other


def _walk(node: Node, out: Lines, seen: bool, pre: bool, drawn: bool = True) -> None:
    """drawn: False in svg, outside of its text."""
    number = _number(node.attrs.get("start"), 1)
    for child in node.children:
        if isinstance(child, str):
            if seen and drawn:
                out.kept(child) if pre else out.text(child)
            continue
        laid, visible = _shown(child, seen)
        if not laid:
            continue
        tag = child.tag
        if child.foreign:
            apart = tag in SVG_TEXT
            out.text(" ") if apart else None
            _walk(child, out, visible, pre, tag != "svg" and (drawn or apart))
            out.text(" ") if apart else None
            continue
        if tag == "br":
            out.newline()
            continue
        if tag == "input":
            if visible and (child.attrs.get("type") or "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "number"):
                out.text(f" {child.attrs.get('value') or ''} ")
            continue
        breaks = 2 if tag in WIDE_BREAK and not (tag in ("ul", "ol") and node.tag == "li") else 1 if tag in BLOCK else 0
        out.want(breaks) if breaks else None
        if tag == "li":
            ordered = node.tag == "ol"
            number = _number(child.attrs.get("value"), number)
            mark = f"{number}. " if ordered else "- "
            number += ordered
            inner = Lines()
            _walk(child, inner, visible, pre)
            lines = inner.finish()
            if lines:
                out.block([mark + lines[0], *[" " * len(mark) + x if x else "" for x in lines[1:]]])
        elif tag == "table":
            lines = _table(child, visible)
            if lines:
                out.block(lines)
        elif tag == "blockquote" or tag == "dd":
            inner = Lines()
            _walk(child, inner, visible, pre)
            lines = inner.finish()
            if lines:
                out.block(["  " + x if x else "" for x in lines])
        else:
            _walk(child, out, visible, pre or tag in ("pre", "textarea", "listing"))
        out.want(breaks) if breaks else None


def _cell(node: Node, seen: bool) -> list[str]:
    inner = Lines()
    _walk(node, inner, seen, False)
    return inner.finish()


def _table(node: Node, seen: bool) -> list[str]:
    """Rows of cells in aligned columns two spaces apart; spans leave the further places empty."""
    before, rows, held, order = [], [], {}, []

    def stray(x: Node | str, vis: bool) -> None:
        """What stands between rows and cells goes before the table."""
        if isinstance(x, Node):
            before.extend(_cell(_wrap(x), vis))
        elif vis and x.strip(" \t\n\r\f"):
            before.append(SPACES.sub(" ", x).strip(" "))

    for child in node.children:
        if isinstance(child, str) or child.tag not in ("thead", "tbody", "tfoot", "tr", "col", "colgroup"):
            stray(child, seen)
        elif child.tag == "tr":
            order.append((child, seen))
        else:
            laid, visible = _shown(child, seen)
            for x in child.children if laid else []:
                order.append((x, visible)) if isinstance(x, Node) and x.tag == "tr" else stray(x, visible)
    for tr, vis in order:
        laid, visible = _shown(tr, vis)
        if not laid:
            continue
        row, col = {}, 0
        for x in tr.children:
            if isinstance(x, str) or x.tag not in ("td", "th"):
                stray(x, visible)
                continue
            laid, shown = _shown(x, visible)
            if not laid:
                continue
            while held.get(col, 0) > 0:
                col += 1
            row[col] = _cell(x, shown)
            across, down = (min(max(_number(x.attrs.get(k), 1), 1), most) for k, most in (("colspan", 1000), ("rowspan", 65534)))
            for c in range(col, col + across):
                held[c] = max(held.get(c, 0), down)
            col += across
        held = {c: n - 1 for c, n in held.items() if n > 1}
        rows.append(row)
    rows = [r for r in rows if any(r.values())]
    widths: dict[int, int] = {}
    for r in rows:
        for c, lines in r.items():
            widths[c] = max([widths.get(c, 0), *map(_width, lines)])
    used = sorted(c for c, w in widths.items() if w)
    out = before
    for r in rows:
        for i in range(max(len(x) for x in r.values())):
            parts = []
            for c in used:
                s = r[c][i] if c in r and i < len(r[c]) else ""
                parts.append(s + " " * (widths[c] - _width(s)))
            out.append("  ".join(parts).rstrip())
    return out


def _wrap(node: Node) -> Node:
    out = Node("div")
    out.children.append(node)
    return out


def render(html: str | None) -> str:
    """Visible text of a page; lines end with a newline character between them only."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    out = Lines()
    _walk(builder.root, out, True, False)
    return "\n".join(out.finish())


def visible_text(html: str | Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([render(x) for x in b], dtype=object)

    return run(F.col(html) if isinstance(html, str) else html)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every page.

    Text: blocks on their own lines, paragraphs, headings, lists and tables between empty lines, list
    marks and numbers with nested indents, table cells in aligned columns, kept white space in pre.
    Text of svg and math shows in the line, without what they do not draw. Head, scripts, styles, templates and elements hidden by attribute or inline style give nothing; a
    visible child of a visibility:hidden parent shows. Null or empty html gives empty text; broken
    markup is closed as a browser would. Null ids and repeated rows each keep their row; empty
    table: no rows. Other columns are not read.
    """
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), visible_text(html_col).alias("text"))


@query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
