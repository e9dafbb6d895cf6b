from __future__ import annotations

import random
import re
import time
from html.parser import HTMLParser

import pytest

from affinis.llm.html_text import extract, page_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, None), ("", ""), ("  \n ", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<div>a</div><div>b</div>c", "a\nb\nc"), ("<ul><li>one<li>two<ul><li>in</ul></ul>", "- one\n- two\n  - in"), ('<ol start=3><li>x<li value="9">y<li>z', "3. x\n9. y\n10. z"),
        ("<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3<tr><td>Fig<td>12</table>", "Name       Qty\nApple pie  3\nFig        12"), ("<td>x</td><td>y", "x y".replace(" ", "")),
        ("<table><td colspan=2>wide<tr><td>a<td>b</table>", "wide\na  b"), ("<pre>  a\n   b</pre>", "  a\n   b"), ("<head><title>t</title></head><body>x", "x"), ("<title>t</title>x", "x"),
        ("<script>var a='</p>';</script>x<style>p{}</style>y<!-- z -->", "xy"), ("<p hidden>a</p>b", "b"), ('<div style="display: none">a<p>b</p></div>c', "c"),
        ('<p style="visibility:hidden">a<span style="visibility:visible">b</span></p>', "b"), ("<style>.x{display:none}#i,em{visibility:hidden}</style><b class='y x'>1</b><i id=i>2</i><em>3</em>4", "4"),
        ("<details><summary>s</summary>d</details>", "s"), ("<details open><summary>s</summary>d</details>", "s\nd"), ("<dialog>a</dialog>b", "b"), ("<template>a</template><noscript>b</noscript>c", "c"),
        ("<dl><dt>T<dd>D<dt>U", "T\n  D\nU"), ("<blockquote>q</blockquote>r", "  q\n\nr"), ("<select><option>a<option>b</select>", "a\nb"), ("<b><i>x</b>y</i>", "xy"),
        ("<p>a<table><tr><td>b</table>c", "a\n\nb\n\nc"), ("<", "<"), ("<a", ""), ("<!--", ""), ("</p></br>z", "z"), ("<![CDATA[a<b]]>", "a<b"), ("<textarea> a\n b</textarea>", " a\n b"),
    ],
)
def test_pages(page, text):
    assert page_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<style>@media print{.nav{display:none}}</style><p class=nav>menu", "menu"), ("<style media=print>p{display:none}</style><p>a", "a"), ("<style>@media not print{.x{display:none}}</style><p class=x>a</p>b", "b"),
        ("<style>@media (max-width:600px){.x{display:none}}@media screen and (min-width:600px){.y{display:none}}</style><p class=x>a</p><p class=y>b", "a"),
        ("<style>.x{display:none}</style><p class=x style='display:block'>a", "a"), ("<style>.x{display:none}.x{display:block}</style><p class=x>a", "a"), ("<style>.x{display:none!important}p.x{display:block}</style><p class=x>a</p>b", "b"),
        ("<style>#i{display:none}.x{display:block}</style><p class=x id=i>a</p>b", "b"), (r"<style>.hidden{display:none}@media (min-width:768px){.md\:block{display:block}}</style><p class='hidden md:block'>a", "a"),
        ("<style>.m{display:none}.open .m{display:block}</style><div class=open><i><p class=m>a</p></i></div><p class=m>b", "a"), ("<style>a > b{display:none}</style><a><b>1</b><i><b>2</b></i></a>", "2"),
        ("<style>.x{display:flex}</style><p class=x hidden>a", "a"), ("<noscript><style>p{display:none}</style></noscript><p>a", "a"), ("<style>em{visibility:hidden}div em{visibility:visible}</style><div><em>1</em></div><em>2", "1"),
        ("so <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> ok", "so x= 1 2 ok"), ("<math><semantics><mi>a</mi><annotation>x</annotation></semantics></math>", "a"),
        ("<svg><title>t</title><text>lab<tspan>el</tspan></text><text>two</text><defs><text>no</text></defs></svg>z", "label\ntwo\nz"), ("<svg><title/><path/></svg>z", "z"), ("<svg><path><p>out</p>z", "out\n\nz"),
    ],
)
def test_cascade_and_foreign_elements(page, text):
    assert page_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"), ("<table><tr><td colspan=2>a wide one<td>x<tr><td>1<td>2<td>3</table>", "a wide one  x\n1  2        3"),
        ("<table><tr><td rowspan=0>r<td>1<tr><td>2<tr><td>3</table>", "r  1\n   2\n   3"), ("<table><tr><td colspan=2 rowspan=2>s<td>1<tr><td>2<tr><td>a<td>b<td>c</table>", "s     1\n      2\na  b  c"),
        ("<table><tr><td colspan=100>head<tr><td>a<td>b</table>", "head\na  b"), ("<input type=submit value=Send><input type=password value=p><input type=checkbox value=c>", "Send"), ("<input placeholder=Name> <input type=email value=a@b>", "Name a@b"),
        ("<object>seen</object><object data=x>not</object>", "seen"), ("a<span style='display:block'>b</span>c", "a\nb\nc"), ("<div style='display:inline'>a</div><div style='display:inline'>b</div>", "ab"),
    ],
)
def test_tables_and_controls(page, text):
    assert page_text(page) == text


def test_mis_nested_pages_take_linear_time():
    seconds = []
    for n in (2000, 16000):
        began = time.process_time()
        page_text("<span><button>" + "<div>" * n + "</span>" * n)
        page_text("<svg>" + "<g>" * n + "<td>" * n)
        page_text("<table>" + "<li>" * n + "<tr>" * n)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 8 * 4 * max(seconds[0], 0.05)


class Runs(HTMLParser):
    """Independent of the library: words by inline run, and tables as rows of cells, of well-formed pages."""

    BLOCKS = {"p", "div", "section", "h2", "ul", "ol", "li", "blockquote", "tr", "table"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.run, self.words, self.cells, self.cell = [], 0, [], [], None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "br":
            self.run += 1
            return
        shut = tag in ("script", "style", "template") or "hidden" in attrs or "display:none" in attrs.get("style", "")
        self.stack.append((tag, shut))
        self.run += tag in self.BLOCKS
        if tag == "td":
            self.cell = len(self.cells)
            self.cells.append([])

    def handle_endtag(self, tag):
        self.stack.pop()
        self.run += tag in self.BLOCKS
        if tag == "td":
            self.cell = None

    def handle_data(self, data):
        if not any(s for _, s in self.stack):
            for w in re.findall(r"w\d+", data):
                self.words.append((self.run, w))
                if self.cell is not None:
                    self.cells[self.cell].append(w)


def page(rnd):
    words = iter(f"w{i}" for i in range(10**6))

    def inline(deep):
        out = []
        for _ in range(rnd.randrange(1, 4)):
            kind = rnd.randrange(8) if deep < 3 else 0
            text = " " * rnd.randrange(2) + next(words) + rnd.choice((" ", "\n ", "&amp; ", "<!-- w9 --> "))
            out.append(text if kind < 4 else f"<b>{inline(deep + 1)}</b>" if kind == 4 else f"<i class='a'>{text}</i>" if kind == 5 else f"<span hidden>{text}</span>" if kind == 6 else text + "<script>var w = '</p>';</script>")
        return "".join(out)

    def block(deep):
        kind = rnd.randrange(9) if deep < 4 else 0
        inner = lambda: "".join(block(deep + 1) for _ in range(rnd.randrange(1, 4)))
        if kind < 3:
            return f"<p>{inline(0)}</p>"
        if kind == 3:
            return f"<div>{inner()}</div>"
        if kind == 4:
            return f"<{(x := rnd.choice(('ul', 'ol')))}>" + "".join(f"<li>{inline(0)}</li>\n" for _ in range(rnd.randrange(1, 4))) + f"</{x}>"
        if kind == 5:
            return f"<blockquote>{inner()}</blockquote>"
        if kind == 6:
            return f"<section style='display:none'>{inner()}</section>"
        if kind == 7:
            width = rnd.randrange(1, 4)
            return "<table>" + "".join("<tr>" + "".join(f"<td>{next(words)} {next(words)}</td>" for _ in range(width)) + "</tr>" for _ in range(rnd.randrange(1, 4))) + "</table>"
        return f"<h2>{inline(0)}</h2>\n"

    return "".join(block(0) for _ in range(rnd.randrange(1, 8)))


@pytest.mark.parametrize("seed", range(60))
def test_against_the_standard_parser(seed):
    source = page(random.Random(seed))
    want = Runs()
    want.feed(source)
    text = page_text(source)
    lines = [re.findall(r"w\d+", line) for line in text.split("\n")]
    assert [w for line in lines for w in line] == [w for _, w in want.words]
    runs = {}
    for run, w in want.words:
        runs.setdefault(run, []).append(w)
    assert [line for line in lines if line] == list(runs.values())
    # Each table's columns are aligned.
    at = {w: line.index(w) for line in text.split("\n") for w in re.findall(r"w\d+", line)}
    for part in re.findall(r"<table>(.*?)</table>", source):
        rows = [re.findall(r"<td>(w\d+)", r) for r in part.split("</tr>")[:-1]]
        if rows[0][0] in at:
            assert all(len({at[r[c]] for r in rows}) == 1 for c in range(len(rows[0])))


def test_deep_and_long_pages():
    assert page_text("<div>" * 30000 + "deep") == "deep"
    assert page_text("<p>x</p>" * 20000).count("x") == 20000
    assert page_text("<table><tr><td>" * 300 + "x").strip() == "x"


def test_query_form(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "t"), (1, "u", "<p>a</p>", "t"), (None, None, None, None), (2, None, "", "t")], "page_id bigint, url string, html string, text string")
    assert sorted(map(tuple, extract(df).collect()), key=str) == sorted([(1, "u", "a"), (1, "u", "a"), (None, None, None), (2, None, "")], key=str)
    assert extract(df.limit(0)).count() == 0
