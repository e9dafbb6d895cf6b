"""Layout-aware text of HTML pages.

A tokeniser and tree builder apply HTML's implied tags (``html``, ``head``, ``body``, ``tbody``,
``tr``; end tags of ``p``, ``li``, ``dt``/``dd``, ``option``, table parts); visibility rules drop what a
browser does not show; a renderer emits the rest: blocks on lines of their own with blank lines where
they have margins, list items with markers and indents, tables with aligned columns, preformatted text as it is.

Visibility: nothing of ``head``, scripts, styles, templates, ``noscript``, embedded frames and data lists; nothing of an
element whose ``display`` is ``none`` by the cascade of its ``style`` and the page's style sheets (``affinis.llm.css`` says what is
read, and for which screen), of one with ``hidden`` or a ``dialog`` that isn't open unless the cascade shows it, or of a closed
``details`` but its summary; ``visibility: hidden`` is inherited and may be undone below. Of SVG the ``text`` elements (a line
each) and ``foreignObject`` are seen, of MathML all but annotations and phantoms, parts of fractions, scripts and rows
separated by spaces; text that only ``use`` would draw isn't. Input elements show their value, or else their placeholder, but passwords;
of a ``select`` all options are listed; what stands within an ``object`` is seen if it names no data. ``display`` may make a block of an inline
element, or the reverse.

Tables: a cell stands below the cells of its column, whatever spans of columns and rows go before it; a cell's lines begin in
its first row; a span that is longer than its columns widens the last of them.

Defined cases: a null page gives a null text; an empty page, or one without visible text, an empty text; broken
markup gives the text that the rules above yield, never an error; unclosed elements end with their parent; pages are
read whole, however long or deep; repeated rows each get their text; an empty table gives no rows;
other columns are not read. Runs of white space are one space outside ``pre`` and ``textarea``.
"""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from affinis.llm.common import col, slices, table
from affinis.llm.css import Cascade, Sheet

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset(("title", "textarea"))
HEAD = frozenset("base basefont bgsound link meta title script style noscript template noframes".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes datalist audio video canvas area param source track".split())
#: Unseen within svg or math.
FOREIGN_UNSEEN = frozenset("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml mphantom mprescripts".split())
#: MathML elements whose parts stand beside or above one another.
APART = frozenset("mfrac msup msub msubsup mroot munder mover munderover mmultiscripts mtr mlabeledtr".split())
#: Start tags that end svg and math, unless one of INTEGRATION is open within.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
FOREIGN = frozenset(("svg", "math"))
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu fieldset".split())
BLOCK = MARGIN | frozenset(
    "address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary tbody td tfoot th thead tr".split()
)
CLOSES_P = BLOCK - frozenset("body html caption li dd dt legend optgroup option tbody td tfoot th thead tr".split()) | frozenset(("li", "dd", "dt"))
#: Start tag -> (tags whose open element it ends, tags beyond which it doesn't look).
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir", "table", "td", "th"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (frozenset(("td", "th")), frozenset(("table",))),
    "th": (frozenset(("td", "th")), frozenset(("table",))),
    "tr": (frozenset(("td", "th", "tr", "caption", "colgroup")), frozenset(("table",))),
    **{x: (frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup")), frozenset(("table",))) for x in ("tbody", "thead", "tfoot", "caption", "colgroup")},
}
#: What means nothing outside a table.
PARTS = frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup", "col"))
#: Input elements whose value, or else placeholder, is shown as text.
TYPED = frozenset(("", "text", "search", "email", "url", "tel", "number", "date", "time", "datetime-local", "month", "week", "submit", "reset", "button"))
INPUTS = TYPED | frozenset(("password", "hidden", "checkbox", "radio", "file", "range", "color", "image"))
#: Values of display that make a block, or none.
AS_BLOCK = frozenset(("block", "flex", "grid", "list-item", "flow-root"))
AS_INLINE = frozenset(("inline", "inline-block", "inline-flex", "inline-grid", "contents"))
SCOPE = frozenset(("table", "td", "th", "caption", "button", "template"))
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs, [], parent


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if "=" in source or source.strip(" \t\n\r\f/"):
        for name, a, b, c in ATTRIBUTE.findall(source):
            found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


class Builder:
    """The tree of one page; css: media and text of its style sheets."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.open = [self.root]
        #: Places in ``open`` by tag, so that no look-up walks the open elements.
        self.at: dict[str, list[int]] = {"html": [0]}
        self.css: list[tuple[str, str]] = []

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs, self.open[-1])
        self.open[-1].kids.append(node)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(node)

    def pop(self) -> None:
        self.at[self.open.pop().tag].pop()

    def innermost(self, tags: frozenset[str] | set[str], but: frozenset[str] | set[str] = frozenset()) -> int:
        """Place of the innermost open element of these tags; 0: none."""
        return max((p[-1] for t in tags if (p := self.at.get(t)) and t not in but), default=0)

    def close(self, ends: frozenset[str] | set[str], stop: frozenset[str], all_of_them: bool = False) -> bool:
        """End the innermost (or all_of_them: the outermost) open element of ends that no element of stop encloses."""
        hit = self.innermost(ends)
        if not hit:
            return False
        wall = self.innermost(stop, ends)
        if hit < wall:
            return False
        if all_of_them:
            hit = min(p[i] for t in ends if (p := self.at.get(t)) and (i := bisect_right(p, wall)) < len(p))
        while len(self.open) > hit:
            self.pop()
        return True

    def leave_head(self) -> None:
        if self.at.get("head"):
            self.close({"head"}, frozenset())

    def text(self, s: str) -> None:
        if self.at.get("head") and self.open[-1].tag == "head":
            if not s.strip():
                return
            self.leave_head()
        self.open[-1].kids.append(s)

    def foreign(self) -> int:
        """Place of the svg or math that the next element would belong to; 0: none."""
        k = self.innermost(FOREIGN)
        return k if k and k > self.innermost(INTEGRATION) else 0

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in ("html", "body"):
            self.leave_head()
            if tag == "html":
                self.root.attrs = attrs | self.root.attrs
            elif not self.at.get("body"):
                self.push("body", attrs)
            return
        if tag == "head":
            if not self.at.get("body") and not self.at.get("head"):
                self.push("head", attrs)
            return
        while tag in BREAKOUT and (k := self.foreign()):
            while len(self.open) > k:
                self.pop()
        if self.open[-1].tag == "head" and tag not in HEAD:
            self.leave_head()
        if tag in PARTS and not self.at.get("table"):
            return
        if tag in CLOSES_P and self.at.get("p"):
            self.close({"p"}, SCOPE)
        if tag in ENDS:
            ends, stop = ENDS[tag]
            self.close(ends, stop, all_of_them=tag in ("tr", "tbody", "thead", "tfoot", "caption", "colgroup", "optgroup"))
        here = self.open[-1].tag
        if tag in ("td", "th") and here in ("table", "tbody", "thead", "tfoot"):
            if here == "table":
                self.push("tbody", {})
            self.push("tr", {})
        elif tag == "tr" and here == "table":
            self.push("tbody", {})
        alone = tag in VOID or (closed and (tag in ("svg", "math") or self.foreign() > 0))
        self.push(tag, attrs)
        if alone:
            self.pop()

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.start("br", {}, False)
        elif tag == "p" and not self.at.get("p"):
            self.start("p", {}, False)
            self.pop()
        elif tag in ("table", "tr", "tbody", "thead", "tfoot"):
            self.close({tag}, frozenset() if tag == "table" else frozenset(("table",)))
        else:
            self.close({tag}, SCOPE - {tag})


def parse(page: str) -> Builder:
    tree, at, n = Builder(), 0, len(page)
    search = TOKEN.search
    while at < n:
        m = search(page, at)
        if not m:
            tree.text(html.unescape(page[at:]))
            break
        if m.start() > at:
            tree.text(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m.group(2)
        if name is None:
            if page.startswith("<![CDATA[", m.start()):
                tree.text(page[m.start() + 9 : at].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m.group(1):
            tree.end(tag)
            continue
        source = m.group(3)
        attrs = attributes(source)
        tree.start(tag, attrs, source.endswith("/"))
        if (tag in RAW or tag in RCDATA) and tree.open[-1].tag == tag and tree.open[-1].attrs is attrs:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            body = page[at : stop.start() if stop else n]
            if tag == "style" and not (tree.at.get("noscript") or tree.at.get("template")) and attrs.get("type", "").strip().lower() in ("", "text/css"):
                tree.css.append((attrs.get("media", ""), body))
            if tag in RCDATA or tag == "xmp":
                tree.open[-1].kids.append(html.unescape(body) if tag in RCDATA else body)
            tree.pop()
            at = stop.end() if stop else n
    return tree


class Flow:
    """Lines of text under construction; want: newlines due before the next text (2: a blank line)."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.want, self.space = 0, False

    def flush(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def brk(self, margin: int) -> None:
        self.flush()
        self.want = max(self.want, margin)

    def settle(self) -> None:
        if self.want == 2 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.want = 0

    def newline(self) -> None:
        if self.line:
            self.flush()
        elif self.lines:
            self.want = 2
        self.space = False

    def text(self, s: str) -> None:
        words = SPACE.sub(" ", s)
        if words[:1] == " ":
            self.space = True
            words = words[1:]
        tail = words[-1:] == " "
        if tail:
            words = words[:-1]
        if words:
            if not self.line:
                self.settle()
            elif self.space:
                self.line.append(" ")
            self.line.append(words)
            self.space = False
        self.space |= tail

    def block(self, lines: list[str], margin: int) -> None:
        """Finished lines."""
        self.brk(margin)
        if any(lines):
            self.settle()
            self.lines += lines
        self.brk(margin)

    def done(self) -> list[str]:
        self.flush()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


class Renderer:
    def __init__(self, cascade: Cascade):
        self.cascade, self.depth, self.within = cascade, 0, ""
        self.node: Node | None = None
        self.styles: dict[str, str] = {}

    def style(self, node: Node, name: str) -> str:
        """The value that the cascade gives; empty where it says nothing."""
        if node is not self.node:
            self.node, self.styles = node, self.cascade.values(node) if node.attrs or self.cascade.sheet.rules else {}
        value = self.styles.get(name, "")
        return "" if value.startswith("revert") else value

    def gone(self, node: Node) -> bool:
        tag, attrs = node.tag, node.attrs
        if tag in UNSEEN or (self.within and tag in FOREIGN_UNSEEN) or (tag == "input" and attrs.get("type", "").lower() == "hidden") or (tag == "object" and "data" in attrs):
            return True
        display = self.style(node, "display")
        if display:
            return display == "none"
        return "hidden" in attrs or (tag == "dialog" and "open" not in attrs) or (self.within == "svg" and attrs.get("display") == "none")

    def seen(self, node: Node, seen: bool) -> bool:
        value = self.style(node, "visibility") or (node.attrs.get("visibility", "") if self.within == "svg" else "")
        return False if value in ("hidden", "collapse") else True if value in ("visible", "initial") else seen

    def foreign(self, node: Node, flow: Flow, seen: bool, pre: bool) -> None:
        """An svg or math element, or one within."""
        tag, before = node.tag, self.within
        if tag in ("svg", "math"):
            self.within = tag
            block = tag == "math" and node.attrs.get("display", "").lower() == "block"
            if block:
                flow.brk(1)
            self.kids(node, flow, seen, False)
            if block:
                flow.brk(1)
        elif before == "svg" and tag in ("text", "foreignobject"):
            flow.brk(1)
            self.within = "text" if tag == "text" else ""
            self.kids(node, flow, seen, pre)
            flow.brk(1)
        elif before == "math" and tag in APART:
            row = tag in ("mtr", "mlabeledtr")
            if row:
                flow.brk(1)
            for kid in node.kids:
                flow.space = True
                self.kid(kid, flow, seen, pre)
                flow.space = True
            if row:
                flow.brk(1)
        else:
            self.kids(node, flow, seen, pre)
        self.within = before

    def kids(self, node: Node, flow: Flow, seen: bool, pre: bool) -> None:
        for kid in node.kids:
            self.kid(kid, flow, seen, pre)

    def kid(self, kid: Node | str, flow: Flow, seen: bool, pre: bool) -> None:
        if isinstance(kid, str):
            if seen and self.within != "svg":
                self.raw(kid, flow) if pre else flow.text(kid)
        elif not self.gone(kid):
            self.element(kid, flow, self.seen(kid, seen), pre)

    def raw(self, s: str, flow: Flow) -> None:
        for k, line in enumerate(s.replace("\r\n", "\n").split("\n")):
            if k:
                if not flow.line:
                    flow.settle()
                    flow.line = [""]
                flow.flush()
            if line:
                if not flow.line:
                    flow.settle()
                flow.line.append(line)

    def element(self, node: Node, flow: Flow, seen: bool, pre: bool) -> None:
        tag, attrs, display = node.tag, node.attrs, self.style(node, "display")
        if tag in ("svg", "math") or self.within:
            self.foreign(node, flow, seen, pre)
        elif tag == "br":
            flow.newline()
        elif tag in ("ul", "ol", "menu", "dir"):
            self.list(node, flow, seen)
        elif tag == "table":
            self.table(node, flow, seen)
        elif tag == "details" and "open" not in node.attrs:
            flow.brk(1)
            for kid in [k for k in node.kids if isinstance(k, Node) and k.tag == "summary"][:1]:
                self.element(kid, flow, self.seen(kid, seen), pre)
            flow.brk(1)
        elif tag in ("blockquote", "dd"):
            inner = Flow()
            self.kids(node, inner, seen, pre)
            flow.block(["  " + x if x else x for x in inner.done()], 2 if tag == "blockquote" else 1)
        elif tag in ("pre", "textarea", "xmp"):
            inner = Flow()
            self.kids(node, inner, seen, True)
            flow.block(inner.done(), 2)
        elif tag == "input":
            kind = attrs.get("type", "").strip().lower()
            if seen and (kind in TYPED or kind not in INPUTS):
                flow.text(attrs.get("value") or attrs.get("placeholder", ""))
        elif (display in AS_BLOCK) or (tag in BLOCK and display not in AS_INLINE):
            margin = 2 if tag in MARGIN else 1
            flow.brk(margin)
            self.kids(node, flow, seen, pre)
            flow.brk(margin)
        else:
            self.kids(node, flow, seen, pre)

    def list(self, node: Node, flow: Flow, seen: bool) -> None:
        start = node.attrs.get("start", "1")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        lines: list[str] = []
        self.depth += 1
        for kid in node.kids:
            inner = Flow()
            if isinstance(kid, str):
                if seen:
                    inner.text(kid)
                item = False
            elif self.gone(kid):
                continue
            else:
                item = kid.tag == "li"
                if item:
                    self.kids(kid, inner, self.seen(kid, seen), False)
                else:
                    self.element(kid, inner, self.seen(kid, seen), False)
            got = inner.done()
            mark = "  "
            if item:
                value = kid.attrs.get("value", "")
                number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
            if any(got):
                lines.append(mark + got[0])
                lines += [" " * len(mark) + x if x else x for x in got[1:]]
        self.depth -= 1
        flow.block(lines, 1 if self.depth else 2)

    def table(self, node: Node, flow: Flow, seen: bool) -> None:
        rows: list[list[tuple[int, int, list[str]]]] = []
        heads: list[list[str]] = []

        def collect(part: Node, seen: bool) -> None:
            for kid in part.kids:
                if isinstance(kid, str):
                    if seen and kid.strip():
                        heads.append([SPACE.sub(" ", kid).strip()])
                    continue
                if self.gone(kid):
                    continue
                shown = self.seen(kid, seen)
                if kid.tag in ("tbody", "thead", "tfoot"):
                    collect(kid, shown)
                elif kid.tag == "tr":
                    row: list[tuple[int, int, list[str]]] = []
                    for cell in kid.kids:
                        inner = Flow()
                        wide = high = 1
                        if isinstance(cell, str):
                            if not (shown and cell.strip()):
                                continue
                            inner.text(cell)
                        elif self.gone(cell):
                            continue
                        else:
                            wide, high = number(cell, "colspan", 1, 1000), number(cell, "rowspan", 0, 65534)
                            self.kids(cell, inner, self.seen(cell, shown), False)
                        row.append((wide, high, inner.done()))
                    rows.append(row)
                else:
                    inner = Flow()
                    self.element(kid, inner, shown, False)
                    heads.append(inner.done())

        collect(node, seen)
        flow.block([x for h in heads for x in h] + aligned(rows), 2)


def number(node: Node, name: str, least: int, most: int) -> int:
    value = node.attrs.get(name, "1").strip()
    return min(most, max(least, int(value))) if re.fullmatch(r"\d{1,6}", value) else 1


def aligned(rows: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """Lines of a table of (columns, rows, lines) cells. A cell takes the first column that no cell from above reaches into; 0 rows: all that follow."""
    placed: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}  # column -> rows that a cell from above still takes
    for row in rows:
        at, out, below = 0, [], {}
        for wide, high, cell in row:
            while at in taken:
                at += 1
            out.append((at, at + wide, cell))
            if high != 1:
                below |= dict.fromkeys(range(at, at + wide), high - 1 if high else len(rows))
            at += wide
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | below
        placed.append(out)
    starts = sorted({at for row in placed for at, _, _ in row})
    width = [0] * len(starts)
    index = {at: i for i, at in enumerate(starts)}
    spans: list[tuple[int, int, int]] = []
    for row in placed:
        for at, end, cell in row:
            first, last, size = index[at], bisect_left(starts, end) - 1, max(map(len, cell), default=0)
            if first == last:
                width[first] = max(width[first], size)
            else:
                spans.append((last, first, size))
    for last, first, size in sorted(spans):
        width[last] = max(width[last], size - sum(width[first:last]) - 2 * (last - first))
    offset, lines = [0], []
    for w in width:
        offset.append(offset[-1] + w + 2)
    for row in placed:
        for k in range(max((len(c) for _, _, c in row), default=0)):
            line = ""
            for at, _, cell in row:
                if k < len(cell) and cell[k]:
                    line = line.ljust(offset[index[at]]) + cell[k]
            lines.append(line.rstrip())
    return lines


def page_text(page: str | None) -> str | None:
    if page is None:
        return None
    if sys.getrecursionlimit() < 1_000_000:
        sys.setrecursionlimit(1_000_000)
    tree = parse(page)
    flow, render = Flow(), Renderer(Cascade(Sheet(tree.css)))
    render.kids(tree.root, flow, True, False)
    return "\n".join(flow.done())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column(2)):
                text = pa.array([page_text(p) for p in batch.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=[id_col, url_col, "text"])

    rows = pages.select(col(id_col), col(url_col).cast("string"), col(html_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, `{url_col}` string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
